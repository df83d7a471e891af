"""Operators against brute force and the boundary cases of their rules."""

import difflib
import hashlib
import os
import random
from datetime import datetime, timedelta, timezone
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import text as X
from tidemark.functions import udfs
from tidemark.functions import html
from tidemark.functions.udfs import change_stats
from tidemark.operators import log, outcomes, score, snapshot, transcripts, worlds
from tidemark.operators.outcomes import Outcome, State, step
from tidemark.plans.model import Rule


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.col("id")]).select(column).first()[0]


@pytest.mark.parametrize(
    "old,new,want",
    [
        ("a\nb\n", "a\nb\n", (0, 0)),
        (None, "abc", (3, 0)),
        ("abc", None, (0, 3)),
        ("a\nb\n", "a\nx\nb\n", (2, 0)),
        ("one line here\n", "one lime here\n", (1, 1)),
        ("x" * 2500 + "\n", "y" * 2499 + "\n", (2500, 2501)),
        ("x" * 2499 + "\nsame", "x" * 2498 + "q\nsame", (1, 1)),
        ("a", "a\n", (1, 0)),
    ],
)
def test_change_stats(old, new, want):
    assert change_stats(old, new) == want


def test_large_replaced_chunks_count_whole_lines():
    assert change_stats("a" * 2500 + "\n", "a" * 2500 + "b\n") == (2502, 2501)


@pytest.mark.parametrize("value,cap,want", [(None, 9, "null"), ('a"b\\c', 9, '"a\\"b\\\\c"'), ("  a \n\t b​ ", 9, '"a b"'), ("abcdef", 4, '"abc…"'), ("abcd", 4, '"abcd"'), ("", 4, '""')])
def test_quoted(spark, value, cap, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(X.quoted(F.col("x"), cap)).first()[0] == want


@pytest.mark.parametrize("s,want", [(-5, "0s"), (59, "59s"), (60, "1m"), (3599, "59m"), (3600, "1h"), (172799, "47h"), (172800, "2d")])
def test_age(spark, s, want):
    assert one(spark, X.age(F.lit(s))) == want


def test_schedules(spark):
    rows = [("every 15m", 900), ("every 10s", 10), ("every 9s", None), ("every 0m", None), ("15m", None), ("every 2d", 172800), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(X.schedule_seconds(F.col("t"))).collect()] == [w for _, w in rows]


def test_diff_is_type_aware_and_null_safe(spark):
    schema = "k long, a double, b string, c boolean"
    nan = float("nan")
    old = spark.createDataFrame([(1, nan, "x", True), (2, 1.0, None, None), (3, 1.0, "l" * 200, True), (4, 1.0, "l" * 201, True)], schema)
    new = spark.createDataFrame([(1, nan, "x", True), (2, 1.0, "", None), (3, 1.0, "m" * 200, False), (5, 0.0, "n", None), (4, 1.0, "l" * 200 + "m", True)], schema)
    got = {r.key: (r.kind, [tuple(c) for c in r.changes]) for r in snapshot.diff(old, new, "k").collect()}
    assert got == {
        2: ("modified", [("b", None, "", None, None)]),
        3: ("modified", [("b", "l" * 200, "m" * 200, None, None), ("c", "True", "False", None, None)]),
        4: ("modified", [("b", None, None, 1, 1)]),
        5: ("added", []),
    }


def test_map_diff_tells_types_apart_and_missing_from_null(spark):
    row = lambda k, h, **f: (k, {n: v for n, v in f.items()}, h)
    schema = "key string, fields map<string,struct<t:string,v:string>>, content_hash string"
    old = spark.createDataFrame([row("a", "1", x=("int", "1")), row("b", "2", x=("null", None)), row("c", "3", x=("str", "s"))], schema)
    new = spark.createDataFrame([row("a", "9", x=("float", "1")), row("b", "8"), row("c", "3", x=("str", "other"))], schema)
    got = {r.key: [c.field for c in r.changes] for r in snapshot.diff_maps(old, new).collect()}
    assert got == {"a": ["x"]}  # b: absent counts as null; c: equal hashes are not looked into
    assert {r.key for r in snapshot.delta(old, new).collect()} == {"a", "b"}


def test_keys_are_checked(spark):
    with pytest.raises(snapshot.CollectError, match="empty key"):
        snapshot.check_keys(spark.createDataFrame([(None,), ("a",)], "key string"))
    with pytest.raises(snapshot.CollectError, match="'a' 2 times"):
        snapshot.check_keys(spark.createDataFrame([("a",), ("a",), ("b",)], "key string"))
    snapshot.check_keys(spark.createDataFrame([], "key string"))
    names = lambda *ns: spark.createDataFrame([({n: 1},) for n in ns], "fields map<string,int>")
    for bad in ("", "x" * 65, "a\nb", "a\u200bb", "\u00a0"):
        with pytest.raises(snapshot.CollectError):
            snapshot.check_names(names("fine", bad))
    snapshot.check_names(names("fine", "x" * 64, "a b", "é台"))


def test_scores(spark):
    def value(kind, rules, fields, changes=()):
        df = spark.createDataFrame([(kind, "high", fields, [("f", c, None) for c in changes])], "kind string, priority string, m map<string,string>, ch array<struct<field:string,new:string,added_chars:int>>")
        at = lambda f: F.try_element_at("m", F.lit(f))
        return df.select(score.importance(F.col("priority"), F.col("kind"), F.col("ch"), rules, at)).first()[0]

    rule = Rule("f", "changed_to", "X")
    assert value("modified", [rule], {"f": "X"}, ["X"]) == 22
    assert value("modified", [rule], {"f": "X"}) == 12  # not among the changes
    assert value("added", [rule], {"f": "X"}, ["X"]) == 9
    assert value("modified", [rule, rule], {}, ["X"]) == 32  # equal rules each count
    assert value("removed", [Rule("f", "contains", "STRASSE", -3)], {"f": "Hauptstraße"}) == 9
    assert value("added", [Rule("f", "equals", "x", 5)], {"f": None}) == 9
    assert value("baseline", [Rule("f", "equals", "x", 5)], {"f": "x"}) == 3
    with pytest.raises(Exception, match="unknown kind"):
        value("other", [], {})


def test_sequence_numbers_agree_however_many_tasks_number(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("key"))
    want = {k: i for i, k in enumerate(sorted(str(i) for i in range(1000)), 41)}
    for limit in (100_000, 10):
        monkeypatch.setattr(log, "ONE_TASK", limit)
        assert {r.key: r.seq for r in log.with_seq(df, ["key"], 40).collect()} == want


T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def drive(*runs):
    state, out = State(), []
    for i, (kind, *rest) in enumerate(runs):
        o = Outcome(kind, T0 + timedelta(minutes=i), rest[0] if rest else kind, selectors=tuple(rest[1]) if len(rest) > 1 else (), fingerprint=rest[2] if len(rest) > 2 else None)
        state, events, _ = step(state, o)
        out += [k for k, _ in events]
    return out


@pytest.mark.parametrize(
    "runs,want",
    [
        ([("ok",)], ["baseline"]),
        ([("fail",), ("ok",)], ["source_error", "source_recovered", "baseline"]),
        ([("ok",), ("fail",), ("fail",), ("ok",)], ["baseline", "source_error", "source_recovered"]),
        ([("ok",), ("login", "l"), ("fail", "b"), ("login", "l")], ["baseline", "source_error"]),
        ([("ok",), ("fail", "f"), ("login", "l"), ("login", "m"), ("ok",)], ["baseline", "source_error", "source_error", "source_error", "source_recovered"]),
        ([("ok",), ("broken", "b", ["x"]), ("broken", "b", ["x"]), ("ok",)], ["baseline", "schema_changed", "source_recovered"]),
        ([("broken", "b", ["x"]), ("ok",)], ["source_error", "source_recovered", "baseline"]),
        ([("ok", "", [], "p"), ("ok", "", [], "q"), ("ok", "", [], "q")], ["baseline", "schema_changed"]),
    ],
)
def test_outcomes(runs, want):
    assert drive(*runs) == want


def test_late_results_are_strictly_older():
    s, _, _ = step(State(), Outcome("ok", T0))
    assert step(s, Outcome("ok", T0 - timedelta(seconds=1)))[2] is False
    assert step(s, Outcome("ok", T0 + timedelta(milliseconds=1)))[2] is True


def test_streaks_agree_with_the_machine(spark):
    random.seed(4)
    rows = [(f"s{random.randrange(5)}", i, random.random() < 0.4) for i in range(300)]
    want = []
    for s in {r[0] for r in rows}:
        state = State()
        for _, i, failed in (r for r in rows if r[0] == s):
            state, events, _ = step(state, Outcome("fail" if failed else "ok", T0 + timedelta(minutes=i), "m"))
            want += [(s, i, k, kind) for k, (kind, _) in enumerate(events)]
    got = outcomes.streaks(spark.createDataFrame(rows, "source_id string, run long, failed boolean")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_retention_keeps_what_events_refer_to(spark):
    events = spark.createDataFrame([(1, "s", "a", 10), (2, "s", "b", 20)], "seq long, source_id string, record_key string, created_at int")
    records = spark.createDataFrame([("s", "a", False), ("s", "b", False), ("s", "c", True), ("t", "b", False)], "source_id string, key string, present boolean")
    kept = log.prune(events, F.lit(20))
    assert [r.seq for r in kept.collect()] == [2]
    assert sorted(tuple(r)[:2] for r in log.prune_records(records, kept).select("source_id", "key").collect()) == [("s", "b"), ("s", "c")]
    assert log.pruned_through(events, F.lit(5), F.lit(7).cast("long")).first()[0] == 7


def test_grading_defaults(spark):
    empty, some = spark.createDataFrame([], "k string"), spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert tuple(worlds.grade(empty, empty, ["k"]).first()) == (0, 0, 0, 1.0, 0.0)
    assert tuple(worlds.grade(some, spark.createDataFrame([("a",), ("c",)], "k string"), ["k"]).first()) == (1, 1, 1, 0.5, 0.5)


def test_state_as_of_takes_the_last_change(spark):
    initial = spark.createDataFrame([("p", "Open", "e1")], "k string, status string, eta string")
    changes = spark.createDataFrame([("p", "status", "Shipped", 1, 1), ("p", "status", "Open", 1, 2), ("q", "status", "New", 2, 3), ("p", "eta", "e9", 5, 4)], "k string, field string, value string, t int, ord int")
    assert sorted(map(tuple, worlds.state_as_of(initial, changes, 3, ["k"]).collect())) == [("p", "Open", "e1"), ("q", "New", None)]


HTML = "<html><body><nav class='b a'><ul><li><a href=' /x '>One <b>two</b></a></li><li>none</li></ul></nav><script><p>no</p></script><p>t<br>u</p></body></html>"


def test_pages(spark):
    df = spark.createDataFrame([(1, HTML), (2, None)], "id int, html string")
    rows = {(r.id, r.row): r.fields for r in html.rows_of(df, ["id"], "nav.a li", {"t": "a", "h": "a@href"}).collect()}
    assert list(rows.values()) == [{"t": "One two", "h": "/x"}, {"t": None, "h": None}] and {i for i, _ in rows} == {1}
    every = html.elements(df, None).where("depth > 0").select("shown").collect()
    assert sorted(r.shown for r in every) == ["nav.a.b", "nav.a.b>ul", "nav.a.b>ul>li", "nav.a.b>ul>li>a", "nav.a.b>ul>li>a>b", "p", "p>br"]
    got = {r.id: r.fingerprint for r in html.fingerprints(df, ["id"], "nav li", 9).collect()}
    assert got == {1: hashlib.sha256("nav.a.b\nnav.a.b>ul\np\np>br".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    with pytest.raises(ValueError):
        html.parse_selector("a:hover")


def test_rows_within_rows_scripts_and_odd_facts(spark):
    page = "<div class=r id='a.b'><i>1</i><div class=r><i x='p\x02q'>2</i><script>no</script></div></div><i class='r'><b>3</b></i><div class=rr><i>4</i></div><div class='r'>" + "</div>"
    df = spark.createDataFrame([("é", page)], "k string, html string")
    rows = [(r.row, r.fields["i"], r.fields["x"]) for r in html.rows_of(df, ["k"], ".r", {"i": "i", "x": "i[x]@x"}).orderBy("row").collect()]
    assert rows == [(0, "1", "p\x02q"), (2, "2", "p\x02q"), (4, None, None), (8, None, None)]
    only = lambda s: [r.n for r in html.elements(df, [s]).where(html.matches(F.col("path"), s)).orderBy("n").collect()]
    assert only("div.r > i") == [1, 3] and only("div div i") == [3] and only("*.r b") == [5] and only("i[x='p q']") == [3]


def test_match_flags_of_many_pages(spark):
    page = lambda *rows: "<nav>" + "".join(f"<li>{r}</li>" for r in rows) + "</nav>"
    pages = [page("<a>1</a><b>x</b>", "<a></a>"), page("<b>x</b>"), page("<a> </a><b>x</b>"), page(), "<p>", None, page("<a>1</a>") + "<u></u>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    flags = lambda **o: {r.id: (r.n_rows, r.broken) for r in html.match_flags(df, ["id"], "nav li", {"k": "a", "v": "b", "w": "a"}, "k", **o).collect()}
    assert flags() == {0: (2, []), 1: (1, ["a"]), 2: (1, ["a"]), 3: (0, ["nav li"]), 4: (0, ["nav li"]), 5: (0, ["nav li"]), 6: (1, ["b"])}
    assert flags(optional=["v"], container="u") == {0: (2, ["u"]), 1: (1, ["u", "a"]), 2: (1, ["u", "a"]), 3: (0, ["u"]), 4: (0, ["u"]), 5: (0, ["u"]), 6: (1, [])}


def test_fingerprints_reach_eight_levels_below_body(spark, tmp_path):
    page = lambda n, extra="": "<html><head><title>t</title></head><body>" + "".join(f"<div class='l{k}'>" for k in range(1, n + 1)) + extra + "</div>" * n + "</body></html>"
    df = spark.createDataFrame([(0, page(10)), (1, "<title>t</title><p><b>x</b></p>")], "id int, html string")
    got = {r.id: r.fingerprint for r in html.fingerprints(df, ["id"]).collect()}
    deep = [">".join(f"div.l{k}" for k in range(1, n + 1)) for n in range(1, 9)]
    assert got == {i: hashlib.sha256("\n".join(x).encode()).hexdigest() for i, x in ((0, deep), (1, ["p", "p>b"]))}
    pages = [page(7), page(7, "<i></i>"), page(8), page(8, "<i></i>")]
    spark.createDataFrame([(i, "http://h/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id for r in catalog.structure_changed(spark, str(tmp_path)).collect()} == {1, 2}
    got = {r.page_id: r.fingerprint for r in catalog.page_fingerprint(spark, str(tmp_path)).collect()}
    assert got[0] != got[1] and got[2] == got[3] == hashlib.sha256("\n".join(deep).encode()).hexdigest()


def brute_stats(old, new):
    gained = lost = 0
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        was, now = "".join(a[i:j]), "".join(b[k:m])
        if op == "replace" and len(was) + len(now) <= 5000:
            for o, *at in difflib.SequenceMatcher(None, was, now, autojunk=False).get_opcodes():
                gained, lost = gained + (o != "equal") * (at[3] - at[2]), lost + (o != "equal") * (at[1] - at[0])
        elif op != "equal":
            gained, lost = gained + len(now), lost + len(was)
    return gained, lost


def test_text_change_stats_of_long_texts(spark, tmp_path):
    line = lambda i, n: " ".join(f"w{(i * k) % 97}" for k in range(n))
    texts = ["short", line(3, 500), line(5, 500) + "\n" + line(3, 500), line(7, 2000), "short\nend", "x" * 1499, "x" * 1500]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(90, line(2, 600), "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.added, r.removed) for r in catalog.text_change_stats(spark, str(tmp_path)).collect()}
    assert got == {i: brute_stats(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))}


def test_quoted_text_scrubs_the_whole_text(spark, tmp_path):
    texts = ["a" + " " * 3000 + "b", "\n\t" * 1500 + "end", "x " * 3000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.quoted for r in catalog.quoted_text(spark, str(tmp_path)).collect()}
    assert got == {0: '"a b"', 1: '"end"', 2: '"' + ("x " * 60)[:119] + '…"', 3: "null"}


def test_answers_are_read_as_they_stand(spark):
    """Fences, prose, keys in any order, braces in texts, entries that cannot be read, and what is no answer."""
    block = lambda body, tag="json": f"```{tag}\n{body}\n```"
    one = '{"items": [{"kind": "po", "ref": "4500108"}]}'
    found = [("po", "4500108")]
    cases = [
        (block(one), found),
        ("text {\"items\": 1} " + block('{"items": [{"kind": "x", "ref": "1"}]}') + " more " + block(one) + " bye {}", found),
        (block(one, "JSON"), found), (block(one, ""), found), (f"```json {one}```", found), (block(one).replace("\n", "\r\n"), found), (block("plain", "") + one, found),
        (block("x = {}", "python") + " " + one, found),
        (f"Done. {one} Thanks.", found),
        ('so {"note": "a \\"}{\\" b", "items": [{"kind": "PO", "ref": 4500108, "more": {"a": [{}]}}]} {"other": 1} {', found),
        ('{"items": [{"kind": "po", "ref": "1"}]} then {"n": {"items": []}, "items": [{"ref": "4500108", "kind": "po"}]}', []),  # the object that begins last, though it lies in another
        (block('[{"kind": "po", "ref": "4500108"}]'), found),
        (block('{"items": []}'), []),
        (block('{"items": [{"kind": "po", "ref": 4500108}, "4500111", {"kind": "po"}, {"kind": "po", "ref": null}, {"kind": "po", "ref": true}, {"kind": 3, "ref": "a"}, {"kind": "po", "ref": 1.5}]}'),
         [("po", "4500108"), ("?", '"4500111"'), ("?", '{"kind":"po"}'), ("?", '{"kind":"po","ref":null}'), ("?", '{"kind":"po","ref":true}'), ("?", '{"kind":3,"ref":"a"}'), ("?", '{"kind":"po","ref":1.5}')]),
        *((x, None) for x in (block('{"items": [{"kind": "po", "ref": "1"},]}'), block('{"items": '), block('{"things": []}'), block('{"items": "none"}'), "nothing to report", "", None, block(one) + block("{oops"), '{"items": [', "{" * 50)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.id: None if r.malformed else [tuple(x) for x in r["items"]] for r in transcripts.read_answers(df, "i", "t").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert transcripts.answers(df, "i", "t").where("kind = '?'").count() == 6


def test_transcripts_of_any_shape(spark):
    import json

    def call(n, mid, tokens, model="m", **block):
        return json.dumps({"type": "assistant", "message": {"id": mid, "model": model, "usage": {"input_tokens": tokens, "output_tokens": 1, "cache_read_input_tokens": None}, "content": [block] if block else "text"}})

    tool = lambda i, name="get": {"type": "tool_use", "id": i, "name": name}
    full = ['{"type": "system", "subtype": "init"}', "", "  ", call(1, "a", 5, **tool("t1")), call(2, "a", 9, **tool("t1")), call(3, "b", 4, **tool("t2", "ack")), call(4, "c", 99, "<synthetic>"), "not json", "[1]",
            json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "is_error": True}, {"type": "tool_result"}]}}),
            json.dumps({"type": "result", "subtype": "success", "is_error": False, "total_cost_usd": 0.5, "usage": {"input_tokens": 70, "output_tokens": 7}})]
    cut = [call(1, "a", 5), call(2, "b", 6, **tool("t1"))]
    bad = [json.dumps({"type": "result", "subtype": "error_max_turns", "is_error": True}), call(1, "a", 2)]
    df = spark.createDataFrame([(r, x) for r, xs in (("full", full), ("cut", cut), ("bad", bad)) for x in xs], "run string, line string")
    got = {r.run: r for r in transcripts.metrics(df, ["run"]).collect()}
    shown = lambda r: (r.status, r.usage_source, r.input_tokens, r.output_tokens, r.api_calls, r.tool_calls, r.tool_errors, r.tool_calls_by_name, r.cost_usd, r.bad_lines)
    assert shown(got["full"]) == ("ok", "result", 70, 7, 2, 2, 1, {"ack": 1, "get": 1}, 0.5, 2)
    assert shown(got["cut"]) == ("no_result", "assistant", 11, 2, 2, 1, 0, {"get": 1}, None, 0)
    assert shown(got["bad"]) == ("error_max_turns", "assistant", 2, 1, 1, 0, 0, None, None, 0)


def test_answers_and_ticks(spark, tmp_path):
    texts = [("a", 'x ```json\n{"items": [{"kind": "PO", "ref": "1"}]}\n``` y ```\n{"items": [{"kind": "Mail", "ref": "2"}]}\n```'), ("b", 'so {"items": [{"kind": "po", "ref": "3"}, {"kind": "system", "ref": "x"}]}'), ("c", "none"), ("d", None)]
    got = transcripts.answers(spark.createDataFrame(texts, "id string, t string"), "id", "t").collect()
    assert sorted(map(tuple, got)) == [("a", "mail", "2"), ("b", "po", "3"), ("b", "system", "x")]
    start = datetime(2026, 1, 1)
    got = [r.t for r in worlds.ticks(spark, start, start + timedelta(hours=5), 2, [start + timedelta(hours=3), start]).collect()]
    assert got == [start + timedelta(hours=h) for h in (0, 2, 3, 4)]
    refs = spark.createDataFrame([("PO", "no. 45 "), ("po", "1 2"), ("system", "login expired")], "k string, r string")
    assert [r[0] for r in refs.select(X.reference(F.col("k"), F.col("r"))).collect()] == ["45", "1 2", "LOGIN-EXPIRED"]
    worlds.notes_csv(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), str(tmp_path / "n"), ["k"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "n")).count() == 2


# --- pages, computed again from a tree -----------------------------------------------------------------------------------


class Tree(HTMLParser):
    """Nodes (tag, classes, attributes, children, texts in order), closed as the tags say."""

    EMPTY = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html):
        super().__init__()
        self.root = ("", [], {}, [])
        self.open = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = (tag, sorted((dict(attrs).get("class") or "").split()), dict(attrs), [])
        self.open[-1][3].append(node)
        if tag not in self.EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][3].append(data)


def nodes(node, above=()):
    """Every element with the elements above it, in the order of the page."""
    for child in node[3]:
        if not isinstance(child, str):
            yield child, above
            yield from nodes(child, (*above, child))


def text_of(node):
    return "".join(c if isinstance(c, str) else text_of(c) for c in node[3])


def is_row(n, above):
    tags = [a[0] for a in above]
    return n[0] == "li" and "ul" in tags and "nav" in tags[: len(tags) - 1 - tags[::-1].index("ul")]


def brute_paths(html):
    skipped, out = {"script", "style", "noscript", "template"}, set()
    for n, above in nodes(Tree(html).root):
        chain = [*above, n]
        tags = [c[0] for c in chain]
        if skipped & set(tags) or any(is_row(c, chain[:i]) for i, c in enumerate(chain)):
            continue
        if "body" in tags:
            chain = chain[tags.index("body") + 1 :]
        else:
            chain = chain[tags[0] == "html" :]
            if chain and chain[0][0] in ("head", "title", "meta", "link", "base"):
                continue
        if 0 < len(chain) <= 8:
            out.add(">".join(".".join([c[0], *c[1]]) for c in chain))
    return sorted(out)


PAGES = [
    "<html><head><title>t</title><script>var a='<b>';</script></head><body><nav><ul><li><a href='/x'>One <b>two</b></a></li><li>none</li></ul></nav><p class='z a'>x<br>y</p></body></html>",
    "<p>loose<nav><div><ul class=m><li><a>no href</a><a href=u> first  one </a><a href=v>second</a></li></ul></div></nav>",
    "<body><ul><li><a href=q>not in nav</a></li></ul><nav><ul><ol><li><a href=w>not a child of ul</a></li></ol></ul></nav></body>",
    "",
    None,
]


def test_page_queries_by_brute_force(spark, tmp_path):
    pages = PAGES + [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:60]] if os.path.exists("/root/testdata/sf0.001/pages.parquet") else PAGES
    rows = [(i, f"http://h{i % 3}/p", h) for i, h in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    paths = {i: hashlib.sha256("\n".join(brute_paths(h) if h else []).encode()).hexdigest() for i, _, h in rows}
    assert {r.page_id: r.fingerprint for r in catalog.page_fingerprint(spark, str(tmp_path)).collect()} == paths
    moved = {(i, f"h{i % 3}") for i in paths if i >= 3 and paths[i] != paths[i - 3]}
    assert {tuple(r) for r in catalog.structure_changed(spark, str(tmp_path)).collect()} == moved
    links = set()
    for i, _, h in rows:
        row = -1
        for n, above in nodes(Tree(h or "").root):
            if is_row(n, above) and above[-1][0] == "ul":
                row += 1
                inner = [m for m, _ in nodes(n)]
                text = next((" ".join(text_of(m).split()) for m in inner if m[0] == "a"), None)
                href = next((" ".join((m[2]["href"] or "").split()) for m in inner if m[0] == "a" and "href" in m[2]), None)
                links.add((i, row, text, href))
    broken = {}
    for i, _, h in rows:
        every = list(nodes(Tree(h or "").root))
        inner = [[m for m, _ in nodes(n)] for n, above in every if is_row(n, above) and above[-1][0] == "ul"]
        tags = {m[0] for row in inner for m in row}
        said = [] if any(n[0] == "nav" for n, _ in every) else ["nav"]
        if inner:
            first = [next((" ".join(text_of(m).split()) for m in row if m[0] == "a"), "") for row in inner]
            said += ["a"] * (not any(first)) + ["a[href]@href"] * (not any(m[0] == "a" and "href" in m[2] for row in inner for m in row)) + ["strong"] * ("strong" not in tags)
        broken[i] = (len(inner), ", ".join(said))
    assert {r.page_id: (r.n_rows, r.broken) for r in catalog.broken_selectors(spark, str(tmp_path)).collect()} == broken and len(set(broken.values())) > 2
    got = {tuple(r) for r in catalog.page_links(spark, str(tmp_path)).collect()}
    assert got == links and {x[:2] for x in links} >= {(0, 0), (0, 1), (1, 0)}


@pytest.mark.parametrize("limit", [100_000, 7])
def test_ranks_and_neighbours_agree_however_many_tasks_number(spark, monkeypatch, limit):
    monkeypatch.setattr(log, "ONE_TASK", limit)
    rows = [(i, None if i % 11 == 0 else f"s{i * i % 4}", (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, source_id string, effective int")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    want = {r[0]: (k + 1, 1 + sum(o[1] == r[1] for o in order[:k])) for k, r in enumerate(order)}
    assert {r.seq: (r["rank"], r.ordinal) for r in log.rank(df, ordinal=True).collect()} == want
    after = {r.seq: r["next"] and r["next"].seq for r in log.following(df, ["source_id"], ["seq"]).collect()}
    assert after == {s: next((o[0] for o in rows if o[1] == source and o[0] > s), None) for s, source, _ in rows}


def test_an_error_weighs_less_after_a_recovery_of_its_source(spark):
    rows = [(1, "a", "source_error", 15, None), (2, "a", "schema_changed", 15, []), (3, "a", "schema_changed", 15, ["x"]), (4, "a", "source_recovered", 3, None), (5, "a", "source_error", 15, None), (6, "b", "source_error", 10, None)]
    df = spark.createDataFrame([(*r[:4], (r[4],)) for r in rows], "seq long, source_id string, kind string, importance int, detail struct<selectors:array<string>>").withColumn("priority", F.lit("high"))
    got = log.effective_importance(df, F.col("priority"), score.priority_weight(F.col("priority")), score.kind_weight(F.col("kind"))).collect()
    assert {r.seq: (r.resolved, r.effective) for r in got} == {1: (True, 3), 2: (False, 15), 3: (True, 3), 4: (False, 3), 5: (False, 15), 6: (False, 10)}


def test_kept_characters_are_those_of_the_library(monkeypatch):
    r = random.Random(3)
    ref = lambda a, b: sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    for small in (0, 40, 10**9):
        monkeypatch.setattr(udfs, "SMALL_CHUNK", small)
        for _ in range(300):
            a, b = ("".join(r.choice("ab\ud800é😀") for _ in range(r.randint(0, 40))) for _ in range(2))
            assert udfs.kept_characters(a, b) == ref(a, b)
    monkeypatch.setattr(udfs, "SMALL_CHUNK", 1000)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(500))
    other = " ".join(w if r.random() < 0.8 else "new" for w in text.split())
    assert udfs.kept_characters(text, other) == ref(text, other)


def test_chunks_of_many_pairs_are_compared_together(monkeypatch):
    """The same counts as the library's, whatever is compared at once; ordinary texts are not gone through row by row."""
    words = random.Random(8)
    prose = lambda n: " ".join(words.choice(["the", "of", "and", "thon", "erst", "ining", "ré", "𝄞"]) for _ in range(n))
    texts = [prose(n) for n in (300, 320, 1, 280, 0, 310)] + [None, prose(3) + "\n" + prose(300), "x", "ab" * 20, "ba" * 9 + "\n"]
    pairs = [*zip(texts, texts[1:]), (texts[0], texts[0][700:] + texts[0][:700])]
    want = [brute_stats(a or "", b or "") for a, b in pairs]
    with monkeypatch.context() as m:
        m.setattr(udfs, "kept_characters", None)
        assert [udfs.change_stats(a, b) for a, b in pairs] == udfs.change_stats_of(pairs) == want
    ref = lambda a, b: sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    for most, characters in ((1 << 20, 1 << 17), (200, 1 << 17), (20, 300)):
        monkeypatch.setattr(udfs, "MOST_MATCHES", most)
        monkeypatch.setattr(udfs, "CHARACTERS", characters)
        chunks = [("".join(words.choices(a, k=words.choice([0, 1, 3, 40, 120]))), "".join(words.choices(a, k=words.choice([1, 2, 50, 100])))) for a in ["a", "ab", "abcd", "é𝄞\ud800z"] * 20]
        assert udfs.kept_of_chunks(chunks) == [ref(a, b) for a, b in chunks]
    assert udfs.kept_of_chunks([]) == [] == udfs.change_stats_of([])


def test_benchmark_additions(spark):
    day = lambda n: datetime(2026, 2, n)
    items = [("po", "12", day(1)), ("po", "7", day(9)), ("portal", "7", day(1)), ("portal", "8", day(5)), ("portal", "9", day(7)), ("portal", "77", day(9)), ("portal", "10", None), ("email", "DISK", day(1))]
    items += [("system", "portal-layout", None), ("system", "portal-login", day(8))]
    items = spark.createDataFrame(items, "kind string, ref string, at timestamp")
    texts = spark.createDataFrame([("order 12 and 77",), ("the login-page moved",)], "text string")
    texts = texts.unionByName(spark.createDataFrame([("! schema_changed: #77",), (None,)], "text string"))
    got = [(r.ref, r.observed, r.reason) for r in worlds.observability(items, texts, day(5), day(7)).orderBy("kind", "ref").collect()]
    lost, moved, other = "after login expiry", "after layout change", "other"
    assert got == [("DISK", False, other), ("12", True, ""), ("7", False, other), ("10", False, other), ("7", False, other), ("77", True, ""), ("8", False, moved), ("9", False, lost), ("portal-layout", True, ""), ("portal-login", False, other)]
    assert worlds.observability(items, texts.limit(0)).where("observed").count() == 0
    empty = spark.createDataFrame([], "id int, a boolean")
    assert worlds.recalls(empty, empty, ["id"], ["a"]).first() == (1.0, 1.0)
    t = lambda d: datetime(2026, 1, d)
    states = spark.createDataFrame([(t(1), "v1", False), (t(4), "v2", False), (t(6), "v2", True)], "t timestamp, layout string, login_expired boolean")
    rule = lambda a, b: [r.ref for r in worlds.system_rule(states, F.lit(t(a)), F.lit(t(b)), "v1").collect()]
    assert (rule(2, 5), rule(2, 9), rule(5, 9), rule(2, 3)) == (["LAYOUT"], ["LAYOUT", "LOGIN"], ["LOGIN"], [])


def test_text_helpers(spark):
    from tidemark.functions import text as X

    df = spark.createDataFrame([("a\x00b\u202ec\\d é",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(X.visible(F.col("x"))).collect()] == ["a\\u{00000000}b\\u{0000202e}c\\\\d é", "", None]
    assert [r[0] for r in df.select(X.log_line(F.col("x"))).collect()] == ["a b\u202ec\\d é", "", None]


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    from tidemark.plans import scratch

    class Fake:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Fake)


def test_scratch_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    from tidemark.plans import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
    here = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "tidemark").iterdir() if p.is_dir())
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        scratch.settled(spark.range(3), "gone")
        kept = scratch.outlasting(spark.range(3), "kept")
        assert here() == ["gone", "kept"]
        1 / 0
    assert here() == ["kept"] and kept.count() == 3
    scratch.drop(kept)
    assert here() == []
