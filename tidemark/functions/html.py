"""HTML as rows: a table function gives a page's elements, selectors are regular expressions over their paths, and the rest is joins and aggregates.

An element's path holds, for each open element from the outermost to itself, its tag and facts: number, id, classes, and the attributes that a
selector asks for. So whether an element matches a selector is a column like any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that never hold others, whose content is no part of a page, and that belong into the head.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template".split())
HEAD = frozenset("head title meta link base".split())
#: Levels below body that a page's fingerprint covers.
FINGERPRINT_DEPTH = 8
#: What begins an element in a path, and what stands around each of its facts.
_ELEMENT, _FACT = "\x01", "\x02"


class _Reader(HTMLParser):
    """The elements of a page in the order in which they begin: (tag, path, shown, depth, begin and end of its text, attributes)."""

    def __init__(self, facts: Sequence[str], numbered: bool):
        super().__init__(convert_charrefs=True)
        self.facts, self.numbered = facts, numbered
        self.open: list[list] = []  # tag, path, classes shown, row
        self.rows: list[list] = []
        self.pieces: list[str] = []
        self.length = 0

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        classes = sorted(set((got.get("class") or "").split()))
        facts = [f"@{len(self.rows)}"] * self.numbered + [f"#{got.get('id')}"] * bool(got.get("id")) + [f".{c}" for c in classes]
        facts += [f"[{a}={got[a] or ''}" for a in self.facts if a in got]
        above = self.open[-1][1] if self.open else ""
        path = above + _ELEMENT + _FACT.join([tag, *(f.translate(_PLAIN) for f in facts), ""])
        row = None
        if tag not in SKIPPED and not any(e[0] in SKIPPED for e in self.open):
            self.open.append([tag, path, ".".join([tag, *classes]), None])
            below = self._below_body()
            row = [tag, path, ">".join(below), len(below), self.length, self.length, got]
            self.rows.append(row)
            self.open[-1][3] = row
        else:
            self.open.append([tag, path, tag, None])
        if tag in VOID:
            self._close()

    def _below_body(self) -> list[str]:
        """The open elements below body; where no body tag is open, it is implied around all but html and what belongs into the head."""
        tags = [e[0] for e in self.open]
        if "body" in tags:
            return [e[2] for e in self.open[tags.index("body") + 1 :]]
        rest = self.open[tags[0] == "html" :]
        return [] if rest and rest[0][0] in HEAD else [e[2] for e in rest]

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def _close(self):
        row = self.open.pop()[3]
        if row:
            row[5] = self.length

    def handle_data(self, data):
        if not any(e[0] in SKIPPED for e in self.open):
            self.pieces.append(data)
            self.length += len(data)

    def ended(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.rows


_PLAIN = str.maketrans({_ELEMENT: " ", _FACT: " "})
_STRINGS = T.ArrayType(T.StringType())
ELEMENT = T.StructType(
    [
        T.StructField("n", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("shown", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)


class Elements:
    """Table function (html, tags, facts, texts, shown): the elements of a page, those in scripts and styles left out.

    ``tags`` are the ones wanted (null: all), ``facts`` the attributes that paths hold, ``texts`` the tags whose text is wanted, white space collapsed, and ``shown``
    the attributes to return. With null ``texts`` elements have no numbers, and of equal ones there is one. A page without any gives a row of nulls.
    """

    def eval(self, html: str, tags: list, facts: list, texts: list, shown: list):
        yield from list(self._found(html or "", tags, facts, texts, shown)) or [(None,) * 6]

    def _found(self, html: str, tags, facts, texts, shown):
        reader = _Reader(facts, texts is not None)
        reader.feed(html)
        rows = reader.ended()
        if texts is None:
            for path, shown_path, depth in dict.fromkeys((r[1], r[2], r[3]) for r in rows if tags is None or r[0] in tags):
                yield None, path, shown_path, depth, None, None
            return
        whole = "".join(reader.pieces)
        for n, (tag, path, shown_path, depth, begin, end, got) in enumerate(rows):
            if tags is None or tag in tags:
                text = " ".join(whole[begin:end].split()) if tag in texts or "*" in texts else None
                yield n, path, shown_path, depth, text, {a: got[a] or "" for a in shown if a in got}


class Step(NamedTuple):
    """A compound of a selector: tag (or *), classes, id, attributes with or without a value; ``child`` of the step before it, or anywhere below."""

    tag: str
    classes: tuple
    ident: str | None = None
    attributes: tuple = ()
    child: bool = False


_NAME = r"[\w-]+"
_COMPOUND = re.compile(rf"(\*|{_NAME})?((?:\.{_NAME}|\#{_NAME}|\[\s*{_NAME}\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|{_NAME})\s*)?\])*)")
_PART = re.compile(rf"\.({_NAME})|\#({_NAME})|\[\s*({_NAME})\s*(?:=\s*(\"[^\"]*\"|'[^']*'|{_NAME})\s*)?\]")
_COMBINED = re.compile(r"\s*(>)\s*|\s+")
_ATTRIBUTE = re.compile(rf"(.*?)@({_NAME})\s*", re.S)


def parse_selector(text: str) -> tuple[list[Step], str | None]:
    """Steps of tag, .class, #id, [attribute] and [attribute=value], below one another or (>) children, and the attribute after @ if any."""
    m = _ATTRIBUTE.fullmatch(text)
    path, attribute = (m[1], m[2]) if m else (text, None)
    path, steps, at, child = path.strip(), [], 0, False
    if not path:
        raise ValueError(f"empty selector {text!r}")
    while at < len(path):
        m = _COMPOUND.match(path, at)
        if m.end() == at:
            raise ValueError(f"unsupported selector {text!r}")
        parts = _PART.findall(m[2])
        ids = [i for _, i, _, _ in parts if i]
        if len(ids) > 1:
            raise ValueError(f"unsupported selector {text!r}")
        attributes = tuple((k.lower(), (v[1:-1] if v[0] in "\"'" else v) if v else None) for _, _, k, v in parts if k)
        steps.append(Step((m[1] or "*").lower(), tuple(c for c, _, _, _ in parts if c), ids[0] if ids else None, attributes, child))
        at = m.end()
        if at < len(path):
            m = _COMBINED.match(path, at)
            if not m or m.end() == len(path):
                raise ValueError(f"unsupported selector {text!r}")
            at, child = m.end(), bool(m[1])
    return steps, attribute


def pattern(steps: Sequence[Step]) -> str:
    """The regular expression of the paths, from the outermost element on, of what a selector matches."""
    rest = f"[^{_ELEMENT}]*+"
    quoted = lambda s: re.sub(r"([^\w])", r"\\\1", s, flags=re.A) if s.isascii() else "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in s)
    fact = lambda s, open_end=False: f"(?=[^{_ELEMENT}]*{_FACT}{quoted(s.translate(_PLAIN))}{'' if open_end else _FACT})"
    out = []
    for step in steps:
        looks = "" if step.tag == "*" else f"(?={quoted(step.tag)}{_FACT})"
        looks += "".join(fact(f".{c}") for c in step.classes) + (fact(f"#{step.ident}") if step.ident is not None else "")
        looks += "".join(fact(f"[{k}={v or ''}", v is None) for k, v in step.attributes)
        out.append(("" if step.child else f"(?:{_ELEMENT}{rest})*") + _ELEMENT + looks + rest)
    return "^" + "".join(out)


def matches(path: Column, selector: str) -> Column:
    return path.rlike(pattern(parse_selector(selector)[0]) + "$")


def elements(pages: DataFrame, selectors: Sequence[str] | None, html: str = "html", keep: bool = False, asked: Sequence[str] = ()) -> DataFrame:
    """``pages`` without ``html``, joined with the elements that may match one of ``selectors`` (null: all, without numbers, with the facts that ``asked`` look at).

    ``keep`` keeps pages that have none.
    """
    parsed = [parse_selector(s) for s in selectors or ()]
    last = {(steps[-1].tag, attribute) for steps, attribute in parsed}
    strings = lambda xs: F.array(*map(F.lit, sorted(xs))).cast(_STRINGS)
    tags = F.lit(None).cast(_STRINGS) if selectors is None or any(t == "*" for t, _ in last) else strings({t for t, _ in last})
    texts = F.lit(None).cast(_STRINGS) if selectors is None else strings({t for t, a in last if a is None})
    facts = strings({k for steps, _ in [*parsed, *map(parse_selector, asked)] for s in steps for k, _ in s.attributes})
    table = F.udtf(Elements, returnType=ELEMENT)(F.col(html).outer(), tags, facts, texts, strings({a for _, a in last if a}))
    met = pages.lateralJoin(table).drop(html)
    return met if keep else met.where("path is not null")


def rows_of(pages: DataFrame, keys: Sequence[str], rows: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """(keys, row, fields): the elements that match ``rows`` by their number, and of each the value of the first element below it that matches a field's
    selector: its text, or the attribute named after @, empty if it has none. A field that matches nothing is null. A row may lie within another."""
    path, n = F.col("path"), F.col("n")
    none = F.lit(None).cast("string")
    row_pattern = F.lit(pattern(parse_selector(rows)[0]) + "$")
    parts = F.split(path, _ELEMENT)  # the first is empty
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), _ELEMENT))  # of the elements above; the first one's is empty
    above = F.transform(F.filter(prefixes, lambda p: F.regexp_like(p, row_pattern)), lambda p: F.regexp_extract(p, f"{_FACT}@(\\d+){_FACT}[^{_ELEMENT}]*$", 1).cast("int"))
    entry = lambda row, field, value: F.struct(row.alias("row"), field.alias("field"), n.alias("n"), value.alias("value"))
    each_above = lambda name, value: F.transform("above", lambda row: entry(row, F.lit(name), value))
    found = [F.when(matches(path, rows), F.array(entry(n, none, none)))]
    for name, selector in fields.items():
        attribute = parse_selector(selector)[1]
        value = F.coalesce(F.try_element_at("attributes", F.lit(attribute)), F.lit("")) if attribute else F.col("text")
        if attribute:
            value = F.trim(F.regexp_replace(value, r"\s+", " "))
        found.append(F.when(matches(path, selector), each_above(name, value)))
    every = elements(pages.select(*keys, html), [rows, *fields.values()], html).withColumn("above", above)
    each = every.select(*keys, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("e")).select(*keys, "e.*")
    is_field = {name: F.col("field") == name for name in fields}
    firsts = [F.min_by(F.when(is_field[name], F.col("value")), F.when(is_field[name], F.col("n"))).alias(f"f{k}") for k, name in enumerate(fields)]
    grouped = each.groupBy(*keys, "row").agg(*firsts)
    return grouped.select(*keys, "row", F.create_map(*(x for k, name in enumerate(fields) for x in (F.lit(name), F.col(f"f{k}")))).alias("fields"))


def match_flags(pages: DataFrame, keys: Sequence[str], rows: str, fields: dict[str, str], key: str, optional: Sequence[str] = (), container: str | None = None, html: str = "html") -> DataFrame:
    """(keys, n_rows, broken) of every page: how many rows it has, and the selectors that match nothing in it.

    A container, or without one the rows' selector, is broken if it matches nothing; a field's, unless it is ``optional``, if it matches in no row; the key's too if no row has a key.
    """
    found = rows_of(pages, keys, rows, fields, html)
    value = lambda f: F.try_element_at("fields", F.lit(f))
    flags = {f: F.coalesce(F.bool_or(value(f).isNotNull()), F.lit(False)).alias(f"m{k}") for k, f in enumerate(fields)}
    per_page = found.groupBy(*keys).agg(F.count("*").alias("n_rows"), *flags.values(), F.coalesce(F.bool_or(F.trim(value(key)) != ""), F.lit(False)).alias("keyed"))
    every = pages.select(*keys).distinct()
    same = lambda other: _same(every, other, keys)
    met = every.join(per_page, same(per_page), "left").select(*(every[k] for k in keys), "n_rows", "keyed", *(f"m{k}" for k in range(len(fields))))
    has, outer = F.coalesce("n_rows", F.lit(0)) > 0, F.coalesce("n_rows", F.lit(0)) == 0
    if container is not None:
        inside = elements(pages.select(*keys, html), [container], html).where(matches(F.col("path"), container)).groupBy(*keys).agg(F.lit(True).alias("contained"))
        met = met.join(inside, _same(met, inside, keys), "left").select(*(met[k] for k in keys), "n_rows", "keyed", "contained", *(f"m{k}" for k in range(len(fields))))
        outer = F.col("contained").isNull()
    broken = [F.when(outer, container if container is not None else rows)]
    for k, (name, selector) in enumerate(fields.items()):
        dead = ~F.col(f"m{k}") if name not in optional else F.lit(False)
        broken.append(F.when(has & (dead | (~F.col("keyed") if name == key else F.lit(False))), selector))
    return met.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.array_distinct(F.array_compact(F.array(*broken))).alias("broken"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def fingerprints(pages: DataFrame, keys: Sequence[str], rows: str | None = None, depth: int = FINGERPRINT_DEPTH, html: str = "html") -> DataFrame:
    """(keys, fingerprint) of every page: the hash of the distinct structural paths below body down to ``depth``, rows and what is in them left out."""
    every = elements(pages.select(*keys, html), None, html, True, [] if rows is None else [rows])
    kept = F.col("depth").between(1, depth)
    if rows is not None:
        kept = kept & ~F.col("path").rlike(f"{pattern(parse_selector(rows)[0])}(?:{_ELEMENT}|$)")
    paths = F.array_sort(F.collect_set(F.when(kept, F.col("shown"))))
    return every.groupBy(*keys).agg(F.sha2(F.array_join(paths, "\n"), 256).alias("fingerprint"))
