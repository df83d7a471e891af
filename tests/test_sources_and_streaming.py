"""Connectors over local stand-ins, configuration, and the streamed state machine against the batch one."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes
from tidemark.operators.snapshot import CollectError, LoginRequired
from tidemark.sources.base import collector
from tidemark.sources.config import parse_config, parse_schedule
from tidemark.sources.tables import scrubbed
from tidemark.sources.tree import glob_regex, pruned
from tidemark.streaming.outcomes import RUNS, acknowledged, replay

NOW = datetime(2026, 3, 10, 12, tzinfo=timezone.utc)


def fields(got):
    return {r.key: {k: v.v for k, v in r.fields.items()} for r in got.records.collect()}


def test_directory(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y.txt").write_text("hé")
    (tmp_path / ".hidden").write_bytes(b"a\0b")
    (tmp_path / "big.txt").write_text("z" * 50)
    (tmp_path / "skip.log").write_text("no")
    got = fields(collector("dir", path=str(tmp_path), exclude=["**/*.log"], max_text_bytes=20).collect(spark, NOW))
    assert got["a b/x+y.txt"] == {"size": "3", "text": "hé"}
    assert set(got) == {"a b/x+y.txt", ".hidden", "big.txt"} and set(got["big.txt"]) == {"size", "sha256"} == set(got[".hidden"])
    with pytest.raises(CollectError):
        collector("dir", path=str(tmp_path / "none")).collect(spark, NOW)


def test_directory_prunes_and_tells_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "skip/deep").mkdir(parents=True)
    (tmp_path / "skip/deep/x").write_text("no")
    (tmp_path / "keep").mkdir()
    (tmp_path / "keep/.x").write_text("hid")
    (tmp_path / "keep/y").write_text("yes")
    (tmp_path / "stuck").symlink_to("/proc/self/mem")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "again").symlink_to(tmp_path / "keep")
    got = collector("dir", path=str(tmp_path), exclude=["skip/**"]).collect(spark, NOW)
    assert set(fields(got)) == {"keep/.x", "keep/y"} and [r.key for r in got.unavailable.collect()] == ["stuck"]
    got = collector("dir", path=str(tmp_path), exclude=["skip/**"], hidden=False).collect(spark, NOW)
    assert set(fields(got)) == {"keep/y"}
    assert pruned(["**", "a/**", "b/*"]) == [".*", "a"]


def grown(root, depth, width):
    """A tree of folders, two files in each; returns its keys."""
    keys = []
    for n in range(2):
        root.mkdir(exist_ok=True)
        (root / f"f{n}.txt").write_text(f"{root.name}{n}")
        keys.append(f"f{n}.txt")
    for k in range(width if depth else 0):
        keys += [f"d{k}/{x}" for x in grown(root / f"d{k}", depth - 1, width)]
    return keys


@pytest.mark.parametrize("folders", [1, 2, 7, 1000])
def test_tree_lists_every_file_once_however_it_is_dealt(spark, tmp_path, folders):
    from tidemark.sources import tree

    keys = grown(tmp_path / "t", 3, 3)
    (tmp_path / "t/skip/deep").mkdir(parents=True)
    (tmp_path / "t/skip/deep/z").write_text("no")
    reader = tree.TreeReader({"path": str(tmp_path / "t"), "exclude": '["skip/**", "**/f1.txt"]', "folders": str(folders)})
    shares = reader.partitions()
    assert len(shares) <= 5 * folders and not any("skip" in f for s in shares for f in s.folders)
    want = sorted(k for k in keys if not k.endswith("f1.txt"))
    assert sorted(k for s in shares for b in reader.read(s) for k in b.column(0).to_pylist()) == want
    listed = tree.registered(spark).read.format(tree.NAME).option("folders", folders).option("exclude", '["skip/**", "**/f1.txt"]').load(str(tmp_path / "t"))
    rows = listed.collect()
    assert sorted(r.key for r in rows) == want and all(open(r.path).read() and r.error is None for r in rows)
    assert listed.rdd.getNumPartitions() == len(shares)


def test_tree_deals_wide_levels_to_a_bounded_number_of_tasks(tmp_path):
    from tidemark.sources import tree

    for k in range(50):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/x").write_text("")
    reader = tree.TreeReader({"path": str(tmp_path), "folders": "3"})
    shares = reader.partitions()
    assert len(shares) == 13 and sorted(k for s in shares for b in reader.read(s) for k in b.column(0).to_pylist()) == sorted(f"d{k}/x" for k in range(50))


def test_a_folder_that_cannot_be_listed_fails_the_run(spark, tmp_path, monkeypatch):
    from tidemark.sources import tree

    (tmp_path / "a/b").mkdir(parents=True)
    real = tree.Disk.entries

    def entries(self, folder):
        if folder.rstrip("/").endswith("a/b"):
            raise PermissionError(13, "no")
        return real(self, folder)

    monkeypatch.setattr(tree.Disk, "entries", entries)
    reader = tree.TreeReader({"path": str(tmp_path)})
    assert [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()] == [{"key": "a/b", "path": None, "error": "PermissionError"}]

    class Stuck(tree.Tree):  # the planner is a process of its own
        def reader(self, schema):
            class Reader(tree.TreeReader):
                def read(self, share):
                    yield tree._batch([("z", "/z", None), ("a/b", None, "PermissionError")])

            return Reader(self.options)

    monkeypatch.setattr(tree, "registered", lambda spark: spark.dataSource.register(Stuck) or spark)
    with pytest.raises(CollectError, match="cannot list a/b: PermissionError"):
        collector("dir", path=str(tmp_path)).collect(spark, NOW)


def test_tree_writes_files_that_it_reads_back(spark, tmp_path):
    from tidemark.sources import tree

    rows = [(f"h{i % 3}/p {i}.html", bytes([i]) * i) for i in range(40)] + [(".dot/x+y", b"z"), ("é", b"")]
    out = str(tmp_path / "out")
    tree.registered(spark).createDataFrame(rows, tree.FILES).repartition(4).write.format(tree.NAME).mode("append").save(out)
    listed = {r.key: open(r.path, "rb").read() for r in spark.read.format(tree.NAME).load(out).collect()}
    assert listed == dict(rows)
    got = fields(collector("dir", path=out, max_text_bytes=10).collect(spark, NOW))
    assert got.keys() == dict(rows).keys() and all(int(got[k]["size"]) == len(v) for k, v in rows)
    for bad in ("../x", "/x", "a//b", "a/./b", ""):
        with pytest.raises(Exception, match="no path below a folder"):
            spark.createDataFrame([("fine", b"1"), (bad, b"2")], tree.FILES).write.format(tree.NAME).mode("append").save(str(tmp_path / "bad"))


def test_tree_in_a_store_that_arrow_knows(tmp_path):
    from pyarrow.fs import LocalFileSystem

    from tidemark.sources import tree

    store = tree.Remote(LocalFileSystem())
    for key in ("a/b.txt", "c.txt"):
        store.write(f"{tmp_path}/{key}", key.encode())
    assert sorted(store.entries(str(tmp_path))) == [("a", True), ("c.txt", False)] and (tmp_path / "a/b.txt").read_bytes() == b"a/b.txt"
    store.delete(f"{tmp_path}/c.txt")
    assert list(store.entries(str(tmp_path))) == [("a", True)]
    assert isinstance(tree.opened("file:///x/y/")[0], tree.Disk) and tree.opened("file:///x/y/")[1] == "/x/y" == tree.opened("/x/y")[1]


def test_directory_in_another_store(spark, tmp_path):
    """The way of stores that only Spark reads, on local files: names that begin with a dot are passed over there."""
    (tmp_path / "b").write_bytes(b"x\0y")
    (tmp_path / "c").write_text("z" * 30)
    (tmp_path / ".h").write_text("h")
    (tmp_path / "d e").mkdir()
    (tmp_path / "d e/t é").write_text("té")
    (tmp_path / "d e/g[a]*").write_text("g")
    (tmp_path / "no.log").write_text("g")
    (tmp_path / "stuck").symlink_to("/proc/self/mem")
    c = collector("dir", path=str(tmp_path), exclude=["*.log"])
    got = {r.key: (r["size"], r.text, bool(r.sha256), r.unread) for r in c._through_spark(spark, f"file:{tmp_path}", 20).collect()}
    stuck = got.pop("stuck", None)
    assert stuck is None or stuck[3] or stuck[0] == 0
    assert got == {"b": (3, None, True, False), "c": (30, None, True, False), "d e/t é": (3, "té", False, False), "d e/g[a]*": (1, "g", False, False)}


@pytest.mark.parametrize(
    "pattern,path,want",
    [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("a/**", "a/b/c", True), ("[!a]x", "/x", False), ("[!a]x", "bx", True), ("a[", "a[", True), ("?", "/", False), ("*", ".x", True)],
)
def test_globs(pattern, path, want):
    import re

    assert bool(re.fullmatch(glob_regex(pattern), path, re.S)) is want


def test_query(spark):
    spark.createDataFrame([(1, "x", 1.5, True)], "a int, b string, c double, d boolean").createOrReplaceTempView("q_rows")
    got = collector("sql", query="select a, b, c, d, cast(2.50 as decimal(5,2)) e, date'2026-01-02' f, binary('xy') g from q_rows", key=["a", "b"]).collect(spark, NOW)
    r = got.records.first()
    assert r.key == "1|x" and [r.fields[k].t for k in "abcdefg"] == ["int", "str", "float", "bool", "str", "str", "str"]
    assert (r.fields["d"].v, r.fields["e"].v, r.fields["f"].v) == ("True", "2.50", "2026-01-02")
    for bad in (dict(query="drop table x", key="a"), dict(query="select 1 a, 2 A", key="a"), dict(query="select 1 a", key="z"), dict(query="select array(1) a", key="a")):
        with pytest.raises(CollectError):
            collector("sql", **bad).collect(spark, NOW)
    assert scrubbed("bad db://me:pw@host\nmore", ["pw"]) == "bad db://***@host"


def test_any_format_is_a_source(spark, tmp_path, monkeypatch):
    from tidemark.sources import tree

    spark.createDataFrame([(1, "x", 2.5), (2, None, 1.0)], "a int, `b c` string, d double").write.option("header", "true").csv(str(tmp_path / "csv"))
    got = collector("format", format="csv", path=str(tmp_path / "csv"), schema="a int, `b c` string, d double", key=["a"], columns=["a", "b c"], **{"with": {"header": True}}).collect(spark, NOW)
    assert fields(got) == {"1": {"a": "1", "b c": "x"}, "2": {"a": "2", "b c": None}}
    (tmp_path / "t/u").mkdir(parents=True)
    (tmp_path / "t/u/v").write_text("1")
    tree.registered(spark)
    got = collector("format", format=tree.NAME, path=str(tmp_path / "t"), key="key", columns=["key", "error"]).collect(spark, NOW)
    assert fields(got) == {"u/v": {"key": "u/v", "error": None}}
    monkeypatch.setenv("TEST_HEADER", "hunter2")
    for bad in (dict(format="nope", key="a"), dict(format="csv", path=str(tmp_path / "csv"), key="z"), dict(format="csv", path=str(tmp_path), key="a", **{"with": {"multiLine_env": "TEST_NOT_SET"}})):
        with pytest.raises(CollectError):
            collector("format", **bad).collect(spark, NOW)
    with pytest.raises(CollectError) as e:
        collector("format", format="csv", path=str(tmp_path / "csv"), key="a", **{"with": {"header_env": "TEST_HEADER"}}).collect(spark, NOW)
    assert "hunter2" not in str(e.value)


def test_types_of_ones_own(spark):
    from tidemark.sources import base

    class Days(base.Collector):
        options, required, default_title, default_track = {"n": int}, ("n",), ("key",), ("id",)

        def collect(self, spark, now):
            rows = spark.range(self.given["n"])
            return base.Collected(base.as_records(rows, F.col("id")))

    base.add_type("days", Days)
    base.add_type("days", Days)
    assert len(fields(base.collector("days", n=3).collect(spark, NOW))) == 3
    assert parse_config("sources: [{id: d, type: days, n: 3}]")[0].options == {"n": 3}
    for kind, made in (("dir", Days), ("days", base.Collector)):
        with pytest.raises(ValueError):
            base.add_type(kind, made)


def test_retention_is_configured():
    from tidemark.sources.config import parse_settings

    assert parse_settings("") == ([], 30) and parse_settings("retention_days: 7").retention_days == 7
    for bad in ("retention_days: 0", "retention_days: true", "retention_days: 1.5", "retention_days: x", "days: 3"):
        with pytest.raises(ValueError):
            parse_settings(bad)
    for bad in ("{id: a, type: format, format: csv, key: a, with: {password: x}}", "{id: a, type: format, format: csv, key: a, with: {x_env: 'a b'}}"):
        with pytest.raises(ValueError):
            parse_config(f"sources: [{bad}]")


def test_secrets_are_named_by_environment_variable(spark, monkeypatch):
    options = dict(query="select 1 a", key="a", url_env="TEST_DB_URL", user_env="TEST_DB_USER", password_env="TEST_DB_PASSWORD")
    c = parse_config("sources: [{id: db, type: sql, query: select 1 a, key: a, url_env: TEST_DB_URL, user_env: TEST_DB_USER, password_env: TEST_DB_PASSWORD}]")[0]
    assert c.options == options
    with pytest.raises(CollectError, match="TEST_DB_URL is not set"):
        collector("sql", **c.options).collect(spark, NOW)
    for k, v in (("URL", "jdbc:nothing://h/x?password=hunter2"), ("USER", "me"), ("PASSWORD", "hunter2")):
        monkeypatch.setenv(f"TEST_DB_{k}", v)
    with pytest.raises(CollectError) as e:
        collector("sql", **c.options).collect(spark, NOW)
    assert "hunter2" not in str(e.value)


def test_float_texts(spark):
    from tidemark.functions.text import python_text
    from tidemark.operators.score import matches
    from tidemark.plans.model import Rule

    values = [1.0, 1e7, 1e15, 1e16, 1.5e-5, 0.1 + 0.2, -0.0, float("nan"), float("inf"), 2.0**-1074, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.t for r in df.select(python_text(F.col("x"), "double").alias("t")).collect()] == [None if v is None else str(v) for v in values]
    assert df.where(matches(Rule("x", "equals", "10000000.0"), F.lit("added"), F.array(), F.col("x"), "double")).count() == 1
    df.createOrReplaceTempView("floats")
    got = collector("sql", query="select monotonically_increasing_id() k, x from floats", key="k").collect(spark, NOW)
    assert sorted(r.fields["x"].v or "" for r in got.records.collect()) == sorted("" if v is None else str(v) for v in values)


def test_mail_headers(spark):
    from tidemark.sources.mail import clean_headers, folder_code, header_date

    assert [folder_code(n) for n in ("INBOX", "A&B", "台北", "a é&")] == ["INBOX", "A&-B", "&U,BTFw-", "a &AOk-&-"]
    assert header_date("Sun, 01 Mar 2026 10:00:00 +0200") == datetime(2026, 3, 1, 8, tzinfo=timezone.utc) == header_date("Sun, 01 Mar 2026 08:00:00 -0000")
    assert header_date("Sun, 01 Mar 1901 10:00:00 +0000") is header_date("soon") is header_date(None) is header_date("") is None
    rows = [("in", 1, " s ", "Sun, 01 Mar 2026 10:00:00 +0200", None), ("in", 2, None, "soon", datetime(2026, 3, 2)), ("in", 3, "x", None, None)]
    df = spark.createDataFrame(rows, "folder string, uid long, subject string, date string, received timestamp")
    got = [(r.uid, r.subject, r.date and r.date.isoformat(), r.received and r.received.isoformat()) for r in clean_headers(df).orderBy("uid").collect()]
    one, two = "2026-03-01T08:00:00", "2026-03-02T00:00:00"
    assert got == [(1, "s", one, one), (2, None, two, two), (3, "x", None, None)]


def test_option_ranges():
    for bad in (dict(view="v", folders=["in"], days=0), dict(view="v", folders=["in"], cap=5001), dict(view="v", folders=["in"], days=True)):
        with pytest.raises(ValueError):
            collector("imap", **bad)
    with pytest.raises(ValueError, match="between 0 and 32"):
        collector("web", view="v", url="u", rows="tr", fields={"k": "td"}, key="k", depth=33)


def test_mailbox_shortens_a_full_folder(spark):
    rows = [("in", i, f"m{i % 28}", f"2026-03-{1 + i // 3:02d} 08:00:00", f"s{i}") for i in range(30)] + [("out", 1, None, "2026-03-09 01:00:00", "o"), ("out", 2, "m27", "2026-03-09 02:00:00", "again")]
    df = spark.createDataFrame(rows, "folder string, uid long, message_id string, received string, subject string").withColumn("received", F.to_timestamp("received"))
    df.createOrReplaceTempView("mails")
    got = collector("imap", view="mails", folders=["in", "out"], days=30, cap=10).collect(spark, NOW)
    keys = fields(got)
    assert set(keys) == {"m21", "m22", "m23", "m24", "m25", "m26", "m27", "m0", "m1", "uid:out/1"} and keys["m27"]["subject"] == "s27"
    assert got.window.starts["in"].day == 9 and got.window.field == "received"


def test_page_and_broken_selectors(spark):
    html = "<table><tr class=r><td class=k>1</td><td class=s>Open</td></tr><tr class=r><td class=k></td></tr></table>"
    spark.createDataFrame([("u", html)], "url string, html string").createOrReplaceTempView("shots")
    o = dict(view="shots", url="u", rows="table tr.r", fields={"id": "td.k", "status": "td.s"}, key="id")
    got = collector("web", **o).collect(spark, NOW)
    assert fields(got) == {"1": {"id": "1", "status": "Open"}} and got.broken == [] and len(got.fingerprint) == 64
    assert collector("web", **o | {"fields": {"id": "td.k", "status": "td.z"}}).collect(spark, NOW).broken == ["td.z"]
    assert collector("web", **o | {"rows": "table tr.q"}).collect(spark, NOW).broken == ["table tr.q"]
    assert collector("web", **o, container="table.x").collect(spark, NOW).broken == ["table.x"] and collector("web", **o, depth=0).collect(spark, NOW).fingerprint is None
    assert fields(collector("web", **o | {"fields": {"id": "td.k", "status": "td.z"}}, optional=["status"]).collect(spark, NOW)) == {"1": {"id": "1", "status": ""}}
    with pytest.raises(CollectError, match="invalid selector in the configuration: 'td:hover'"):
        collector("web", **o | {"fields": {"id": "td:hover"}}).collect(spark, NOW)


def test_selectors(spark):
    from tidemark.functions.html import elements, matches, parse_selector

    html = '<div id=top><p class="a b">1<span data-k="x y">2</span></p><ul><li><a href=u>3</a></li><li class=a><p>4</p></li></ul></div>'
    page = spark.createDataFrame([(html,)], "html string")

    def texts(selector):
        return [r.text for r in elements(page, [selector]).where(matches(F.col("path"), selector)).orderBy("n").collect()]

    assert texts("#top > p") == ["12"] and texts("div#top span[data-k]") == ["2"] == texts('span[data-k="x y"]') == texts("p > span")
    assert texts("div > span") == [] and texts("ul > li.a") == ["4"] and texts("ul li") == ["3", "4"] and texts("[href=u]") == ["3"] and texts("p.b.a") == ["12"]
    assert texts("div > ul p") == ["4"] and texts("* > a") == ["3"]
    for bad in ("", "a:hover", "> a", "a >", "a,b", "a[", "#a#b", "a > > b"):
        with pytest.raises(ValueError):
            parse_selector(bad)
    spark.createDataFrame([("u", html)], "url string, html string").createOrReplaceTempView("logins")
    with pytest.raises(LoginRequired):
        collector("web", view="logins", url="u", rows="li", fields={"k": "a"}, key="k", login_selector="p > span[data-k]").collect(spark, NOW)


def test_watches(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"uuid":"a","url":"u","title":" ","page_title":"P","last_changed":0,"last_error":"false","tags":["t"]}\n{"uuid":"b","url":"v","last_changed":60,"last_error":"x","tags":[]}\n')
    got = fields(collector("changedetection", listing=str(tmp_path / "l.json")).collect(spark, NOW))
    assert got["a"]["title"] == "P" and got["a"]["last_changed"] is None and got["b"] == {"url": "v", "title": "v", "last_changed": "1970-01-01T00:01:00Z", "last_error": "x"}
    (tmp_path / "e.json").write_text('{"status":401}\n')
    with pytest.raises(LoginRequired):
        collector("changedetection", listing=str(tmp_path / "e.json")).collect(spark, NOW)


def test_config():
    c = parse_config("sources:\n- {id: po, type: sql, schedule: every 2m, priority: high, query: select 1, key: a, track: [x, x, y], highlight: [{field: s, equals: 'X', bonus: -2}]}\n")[0]
    assert (c.schedule, c.track, c.rules[0].bonus, c.options) == (120, ("x", "y"), -2, {"query": "select 1", "key": "a"})
    for bad in ("a: 1", "sources: [{id: '*', type: sql}]", "sources: [{id: a, type: no}]", "sources: [{id: a, type: sql, password: x}]", "sources: [{id: a, type: sql, highlight: [{field: s}]}]", "sources: [{id: A, type: sql}]", "sources: [{id: a.b, type: sql}]", "sources: [{id: a, type: sql, url: jdbc}]", "sources: [{id: a, type: sql, password_env: 'p w'}]", "sources: [{id: a, type: sql, highlight: [{field: s, equals: 1, bonus: true}]}]"):
        with pytest.raises(ValueError):
            parse_config(bad)
    with pytest.raises(ValueError):
        parse_schedule("every 9s")
    with pytest.raises(ValueError):
        collector("dir", path="x", nope=1)


def test_streamed_machine_agrees_with_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, "fail" if (i * 7) % 5 < 2 else "ok", f"2026-01-01 00:{i % 60:02d}:00", "m") for i in range(60)]
    for k in range(4):
        part = spark.createDataFrame([(*r, None, None, None, 1, None) for r in rows[k * 15 : k * 15 + 15]], RUNS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    replay(spark, str(tmp_path / "ticks"), str(tmp_path / "ckpt"), str(tmp_path / "sink"))
    got = sorted((r.source_id, r.run, r.step, r.kind) for r in spark.read.parquet(str(tmp_path / "sink")).collect())
    batch = outcomes.streaks(spark.createDataFrame([(s, i, k == "fail") for s, i, k, _, _ in rows], "source_id string, run long, failed boolean"))
    assert got == sorted(map(tuple, batch.collect()))


def test_due_sources_are_told_once_over_a_restart(spark, tmp_path):
    """By the timer or by the run that comes first, however runs are cut into batches; a run of no schedule is never due."""
    day = datetime(2026, 1, 1)
    minutes = {"quick": [0, 10, 30, 31, 59, 130], "slow": [0, 100, 220], "once": [5], "free": [0, 200]}
    schedule = {"quick": 1200, "slow": 6000, "once": 3600, "free": None}
    runs = sorted((m, s) for s, ms in minutes.items() for m in ms)
    rows = [(s, i, "ok", day.replace(hour=m // 60, minute=m % 60), None, None, None, None, 1, schedule[s]) for i, (m, s) in enumerate(runs)]
    for k, part in enumerate((rows[:4], rows[4:9], rows[9:])):
        spark.createDataFrame(part, RUNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        if k != 1:  # the second go reads two ticks, from the state of the first
            replay(spark, str(tmp_path / "ticks"), str(tmp_path / "ckpt"), str(tmp_path / "sink"))
    got = sorted((r.source_id, r.run, r.text) for r in spark.read.parquet(str(tmp_path / "sink")).where("kind = 'due'").collect())
    want, watermark = [], 220 - 60
    for s, ms in minutes.items():
        for m, after in zip(ms, [*ms[1:], None]):
            due = m + (schedule[s] or 10**9) / 60
            if due <= (after if after is not None else watermark):
                want.append((s, next(i for i, x in enumerate(runs) if x == (m, s)), f"2026-01-01T{int(due) // 60:02d}:{int(due) % 60:02d}:00Z"))
    assert got == sorted(want) and len(want) == 7


def test_streamed_states_of_every_kind(spark, tmp_path):
    """Logins, broken selectors, layouts and late runs, against the same steps taken one by one."""
    import random
    from collections import defaultdict

    r, rows, day = random.Random(5), [], datetime(2026, 1, 1, tzinfo=timezone.utc)
    for i in range(120):
        kind = r.choice(["ok", "ok", "fail", "login", "broken"])
        when = day.replace(hour=i // 6, minute=(i * 7) % 60)
        names = r.sample(["a.b", "td,x", "p"], 2) if kind == "broken" else None
        rows.append((f"s{i % 4}", i, kind, when, r.choice(["m", "n", ""]), "log in" if kind == "login" else None, names, r.choice(["f", "g", None]) if kind == "ok" else None, i))
    for k in range(4):
        part = spark.createDataFrame([(*x[:3], x[3].replace(tzinfo=None), *x[4:], None) for x in rows[k * 30 : k * 30 + 30]], RUNS)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    replay(spark, str(tmp_path / "ticks"), str(tmp_path / "ckpt"), str(tmp_path / "sink"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "sink")).collect()))
    states, want = defaultdict(outcomes.State), []
    for s, i, kind, when, message, hint, names, layout, n in rows:
        states[s], events, _ = outcomes.step(states[s], outcomes.Outcome(kind, when, message, hint, tuple(names or ()), layout, n))
        for j, (k, d) in enumerate(events):
            told = str(d["record_count"]) if k == "baseline" else ",".join(d["selectors"]) if k == "schema_changed" else "; ".join(filter(None, (d.get("error") or d.get("last_error"), d.get("hint"))))
            want.append((s, i, j, k, told))
    assert got == sorted(want) and {k for *_, k, _ in got} == {"baseline", "source_error", "source_recovered", "schema_changed"}
    assert any(k == "schema_changed" and t == "" for *_, k, t in got)
    events = spark.createDataFrame([(1, datetime(2026, 1, 1, 1)), (2, datetime(2026, 1, 1, 2)), (5, datetime(2026, 1, 1, 9))], "seq long, created_at timestamp")
    assert acknowledged(events, F.to_timestamp(F.lit("2026-01-01 02:00:00"))) == 2 and acknowledged(events, F.to_timestamp(F.lit("2025-01-01 02:00:00"))) == 0
