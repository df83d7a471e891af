"""Answers and transcripts of agent runs: semi-structured text read by JVM expressions and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind of a reported entry that cannot be read: it counts as reported, and as wrong.
UNREADABLE = "?"
# Usage counters of a message, and the model name of messages that no model made.
USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
SYNTHETIC = "<synthetic>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def balanced(chars: Column) -> Column:
    """Length of the object that begins with the first of ``chars`` (single characters), null if it never ends: a depth counter that passes over texts."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("end"))

    def step(s, c):
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        n = s["n"] + 1
        return F.struct(
            depth.alias("depth"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            n.alias("n"),
            F.coalesce(s["end"], F.when((depth == 0) & ~s["quoted"], n)).alias("end"),
        )

    return F.aggregate(chars, start, step)["end"]


def last_object(text: Column, key: str) -> Column:
    """The JSON object that begins last among those in ``text`` that have ``key`` at their top, wherever it stands; null if there is none."""

    def found(chars):
        places = F.filter(F.transform(chars, lambda c, i: F.when(c == "{", i + 1)), lambda i: i.isNotNull())
        bodies = F.transform(places, lambda i: _let(F.slice(chars, i, F.size(chars)), lambda rest: F.array_join(F.slice(rest, 1, F.coalesce(balanced(rest), F.lit(0))), "")))
        able = F.filter(bodies, lambda b: F.try_variant_get(F.try_parse_json(b), f"$.{key}", "variant").isNotNull())
        return F.try_element_at(able, F.lit(-1))

    return _let(F.split(text, ""), found)


def answer_block(text: Column) -> Column:
    """The JSON of an answer: the last fenced block that is tagged json, or is not tagged and looks like JSON, else the last object with ``items``."""
    fence = r"(?s)```[ \t]*([A-Za-z0-9_+-]*)[ \t]*\r?\n?(.*?)```"
    tags, bodies = (F.regexp_extract_all(text, F.lit(fence), F.lit(k)) for k in (1, 2))
    blocks = F.zip_with(tags, bodies, lambda tag, body: F.when((F.lower(tag) == "json") | (tag == "") & F.trim(body, F.lit(" \t\r\n")).rlike(r"^[{\[]"), F.trim(body, F.lit(" \t\r\n"))))
    blocks = F.filter(blocks, lambda b: b.isNotNull())
    return F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(last_object(text, "items"))


def read_answers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, malformed, items) of every answer; ``malformed`` if there is no list of items in it. An item that has no kind and ref is kept as UNREADABLE, with what it is."""
    data = F.try_parse_json(answer_block(F.coalesce(F.col(text_col), F.lit(""))))
    listed = F.when(F.schema_of_variant(data).startswith("OBJECT"), F.try_variant_get(data, "$.items", "variant")).otherwise(data)
    entries = F.when(F.schema_of_variant(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>"))

    def item(e):
        kind, ref = (F.try_variant_get(e, f"$.{k}", "variant") for k in ("kind", "ref"))
        able = (F.schema_of_variant(kind) == "STRING") & F.schema_of_variant(ref).rlike(r"^(STRING|BIGINT|DECIMAL\(\d+,0\))$")
        able = F.coalesce(able, F.lit(False)) & F.schema_of_variant(e).startswith("OBJECT")
        shown = F.substring(F.to_json(e), 1, 80)
        return F.struct(F.when(able, F.lower(F.try_variant_get(kind, "$", "string"))).otherwise(F.lit(UNREADABLE)).alias("kind"), F.when(able, F.try_variant_get(ref, "$", "string")).otherwise(shown).alias("ref"))

    none = F.array().cast("array<struct<kind:string,ref:string>>")
    found = texts.select(F.col(id_col).alias("id"), entries.alias("entries"))
    return found.select("id", F.col("entries").isNull().alias("malformed"), F.coalesce(F.transform("entries", item), none).alias("items"))


def answers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items (id, kind, ref) that answers report; a malformed answer reports none."""
    return read_answers(texts, id_col, text_col).select("id", F.explode("items").alias("i")).select("id", "i.kind", "i.ref")


def metrics(lines: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """Of each run (``by``) what its transcript says: status, calls, usage, tool calls by name, errors and lines that are no events.

    Lines are JSON objects of differing shapes, read as variants. Events that carry one message id are one message: of each usage counter the greatest value
    counts once, a tool call once by its id. Totals are the result event's usage if it has any, else the sum over messages of models. Lines may come in any
    order: a run has at most one result event, and of several the greatest JSON text counts.
    """
    v = F.try_parse_json(F.trim(F.col(line)))
    text = lambda path, x=None: F.try_variant_get(F.col("v") if x is None else x, path, "string")
    events = lines.where(F.trim(F.col(line)) != "").select(*by, v.alias("v"))
    events = events.withColumn("is_event", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))).withColumn("type", F.when(F.col("is_event"), text("$.type")))
    count = lambda x: F.coalesce(F.try_variant_get(F.col("v"), x, "long"), F.lit(0))
    message = events.where("type = 'assistant'").select(*by, F.coalesce(text("$.message.id"), F.to_json("v")).alias("id"), text("$.message.model").alias("model"), *(count(f"$.message.usage.{u}").alias(u) for u in USAGE))
    message = message.groupBy(*by, "id").agg(F.max("model").alias("model"), *(F.max(u).alias(u) for u in USAGE)).where(F.coalesce(F.col("model"), F.lit("")) != SYNTHETIC)
    turns = message.groupBy(*by).agg(F.count("*").alias("api_calls"), *(F.sum(u).alias(f"turn_{u}") for u in USAGE))
    blocks = events.where("type in ('assistant', 'user')").select(*by, "type", F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    b = F.col("b")
    tools = blocks.where((F.col("type") == "assistant") & (text("$.type", b) == "tool_use")).select(*by, F.coalesce(text("$.id", b), F.to_json(b)).alias("id"), F.coalesce(text("$.name", b), F.lit("?")).alias("name"))
    tools = tools.groupBy(*by, "id").agg(F.min("name").alias("name")).groupBy(*by, "name").agg(F.count("*").alias("n"))
    tools = tools.groupBy(*by).agg(F.sum("n").alias("tool_calls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("by_name"))  # a row for each tool
    failed = blocks.where((F.col("type") == "user") & (text("$.type", b) == "tool_result") & F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)))
    failed = failed.groupBy(*by).agg(F.count("*").alias("tool_errors"))
    ended = events.where("type = 'result'").select(*by, F.to_json("v").alias("j"), "v")
    error = F.coalesce(F.try_variant_get("v", "$.is_error", "boolean"), F.lit(False))
    subtype = F.coalesce(text("$.subtype"), F.lit(""))
    status = F.when(~error & subtype.isin("", "success"), "ok").when(~subtype.isin("", "success"), subtype).otherwise("error")
    has_usage = F.schema_of_variant(F.try_variant_get("v", "$.usage", "variant")).startswith("OBJECT")
    said = F.struct(F.col("j"), status.alias("status"), F.coalesce(has_usage, F.lit(False)).alias("has_usage"), F.try_variant_get("v", "$.total_cost_usd", "double").alias("cost"), *(count(f"$.usage.{u}").alias(u) for u in USAGE))
    result = ended.groupBy(*by).agg(F.max_by(said, "j").alias("result"))
    out = events.groupBy(*by).agg(F.count(F.when(~F.col("is_event"), 1)).alias("bad_lines"))
    for part in (turns, tools, failed, result):
        out = out.join(part, list(by), "left")
    told = F.coalesce(F.col("result.has_usage"), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        *by,
        F.coalesce(F.col("result.status"), F.lit("no_result")).alias("status"),
        F.when(told, "result").otherwise("assistant").alias("usage_source"),
        *(F.when(told, F.col(f"result.{u}")).otherwise(n(f"turn_{u}")).alias(u) for u in USAGE),
        n("api_calls").alias("api_calls"),
        n("tool_calls").alias("tool_calls"),
        n("tool_errors").alias("tool_errors"),
        F.col("by_name").alias("tool_calls_by_name"),
        F.col("result.cost").alias("cost_usd"),
        n("bad_lines").alias("bad_lines"),
    )
