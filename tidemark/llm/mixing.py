"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import one_of_each, written

#: Documents of a hash range as a mean, and bits by which ranges are grouped for their running totals: a task sums over 2^GROUP_BITS rows at a time.
RANGE, GROUP_BITS = 512, 9
#: Exponents tried at once in a pass over the source totals, and passes: each narrows the bracket PROBES-fold.
PROBES, PASSES = 32, 4


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def exponent(totals: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The largest exponent in [0, 1] whose shares p^a reach ``entropy`` (nats) and, no less, the smallest that repeats no source over ``repeats`` times.

    Entropy falls and the ratio of the most to the least repeated source falls as the exponent grows, so both are
    bracketed by repeated section. Each probe is an aggregate over the totals, so sources are never collected.
    """
    lo_cap = 0.0
    if repeats is not None:
        lo_cap = _bracket(totals, lambda stats: stats["ratio"] <= repeats, smallest=True)
    if entropy is None:
        return lo_cap
    return max(lo_cap, _bracket(totals, lambda stats: stats["entropy"] >= entropy, smallest=False))


def _bracket(totals: DataFrame, holds, smallest: bool) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / PROBES for i in range(PROBES + 1)]
        ok = [holds(s) for s in _probe(totals, grid)]
        if smallest:
            i = next((i for i, x in enumerate(ok) if x), PROBES)
            if i == 0:
                return grid[0]
            lo, hi = grid[i - 1], grid[i]
        else:
            i = next((i for i in range(PROBES, -1, -1) if ok[i]), 0)
            if i == PROBES:
                return grid[PROBES]
            lo, hi = grid[i], grid[i + 1]
    return hi if smallest else lo


def _probe(totals: DataFrame, grid: list[float]) -> list[dict]:
    """For each exponent: entropy of the shares, and how much more often the rarest source is repeated than the commonest."""
    top = totals.agg(F.max("tokens"), F.min("tokens")).first()
    x = totals.select(F.log(F.col("tokens") / F.lit(float(top[0]))).alias("x"))
    aggs = [e for i, a in enumerate(grid) for e in (F.sum(F.exp(F.lit(a) * F.col("x"))).alias(f"s{i}"), F.sum(F.exp(F.lit(a) * F.col("x")) * F.lit(a) * F.col("x")).alias(f"t{i}"))]
    r = x.agg(*aggs).first()
    return [{"entropy": math.log(r[f"s{i}"]) - r[f"t{i}"] / r[f"s{i}"], "ratio": (top[0] / top[1]) ** (1 - a)} for i, a in enumerate(grid)]


def schedule(
    docs: DataFrame,
    tokens: Column | None = None,
    entropy: float | None = None,
    repeats: float = 2.0,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 5,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """A row for each time a document is to be read: block, place, doc_id, source, epoch, tokens, weight, text_key.

    Source shares p of tokens (``tokens`` is their column; words between white space by default) become weights p^a, normalised; the
    exponent is the flattest that repeats no source more than ``repeats`` times, or as ``entropy`` asks. The token
    budget of a source is its weight's part of ``budget``: by default the least at which every source is read once in
    full, so that no document is left out and rarer sources repeat. Each epoch of a source is a hash permutation of its documents; a
    document belongs to the block in which its running total of tokens, relative to its source's budget, falls:
    every block holds the weights, and the last epoch ends where the budget does.

    Running totals are summed within hash ranges of about RANGE documents, over groups of 2^GROUP_BITS ranges, over groups of those and so on, so that no
    window grows with a source. A null source counts as the empty one; a null text has no tokens; a source without tokens is read once, in
    block 0. Rows repeating id, source and text are scheduled as one. An empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        key.alias("text_key"),
        F.coalesce(word_count(text_col) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
    )
    base = written(base.groupBy("doc_id", "source", "text_key").agg(F.max("tokens").alias("tokens")), "mix")
    totals = written(base.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    some = totals.where("tokens > 0")
    top, most = some.agg(F.max("tokens"), F.max("n")).first()
    if not top:
        return base.select(
            F.lit(0).cast("long").alias("block"), F.xxhash64("doc_id", F.lit(seed)).alias("place"), "doc_id", "source", F.lit(0).alias("epoch"), "tokens", F.lit(0.0).alias("weight"), "text_key"
        )
    a = exponent(some, entropy, repeats)
    share = F.pow(F.col("tokens") / F.lit(float(top)), F.lit(a))
    total = some.agg(F.sum(share)).first()[0]
    whole = float(budget) if budget is not None else top * total  # the commonest source, of share 1 before normalising, is read once
    blocks = max(1, math.ceil(whole / block_tokens))
    plan = totals.select("source", F.col("tokens").alias("has"), F.when(F.col("tokens") > 0, share / F.lit(total)).otherwise(F.lit(0.0)).alias("weight"))
    plan = plan.withColumn("budget", F.col("weight") * F.lit(whole))
    plan = plan.withColumn("epochs", F.when(F.col("has") > 0, F.ceil(F.round(F.col("budget") / F.col("has"), 9))).otherwise(F.lit(1)).cast("int"))
    bits = max(0, math.ceil(math.log2(max(1, most / RANGE))))
    rows = base.join(plan, "source").where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text_key", "epoch", F.lit(seed)))
    rows = rows.withColumn("range", F.shiftrightunsigned("place", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = _running(rows.groupBy("source", "epoch", "range").agg(F.sum("tokens").alias("here")), bits)
    inside = W.partitionBy("source", "epoch", "range").orderBy(F.col("place") < 0, "place", "doc_id").rowsBetween(W.unboundedPreceding, -1)  # as unsigned, like the ranges
    rows = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    at = F.col("epoch") * F.col("has") + F.col("before") + F.col("within")
    rows = rows.join(sums, ["source", "epoch", "range"]).withColumn("at", at).where("has = 0 or at < budget" + (" or (epoch = 0 and tokens = 0)" if budget is None else ""))
    block = F.when(F.col("has") > 0, F.least(F.floor(F.col("at") / F.col("budget") * F.lit(blocks)), F.lit(blocks - 1))).otherwise(F.lit(0)).cast("long")
    return rows.select(block.alias("block"), "place", "doc_id", "source", "epoch", "tokens", "weight", "text_key")


def _running(sums: DataFrame, bits: int) -> DataFrame:
    """(source, epoch, range, before): the tokens of lower ranges, from (source, epoch, range, here) with ranges of ``bits`` bits."""
    group = F.shiftright("range", GROUP_BITS)
    before = W.partitionBy("source", "epoch", group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    out = sums.select("source", "epoch", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    if bits <= GROUP_BITS:
        return out
    above = sums.groupBy("source", "epoch", group.alias("range")).agg(F.sum("here").alias("here"))
    above = _running(above, bits - GROUP_BITS).select("source", "epoch", F.col("range").alias("group"), F.col("before").alias("more"))
    return out.withColumn("group", group).join(above, ["source", "epoch", "group"]).select("source", "epoch", "range", (F.col("before") + F.col("more")).alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, repeated and ordered as ``schedule`` says: blocks are ranges of the output's partitions.

    Rows repeating id, source and text are one (of rows that differ elsewhere the one whose JSON text hashes lowest); rows that share an id only
    are mixed each on its own. Nulls, empty texts and empty tables as in ``schedule``; extra columns, whatever their names, are carried along.
    """
    keys = ["id", "source", "text_key"]
    plan = schedule(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("text_key").alias("plan_key"), "block", "place")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    held = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), F.xxhash64(text).alias("text_key"), F.struct("*").alias("row"))
    held = one_of_each(held, keys)
    met = held.join(plan, held["id"].eqNullSafe(plan["plan_id"]) & (held["source"] == plan["plan_source"]) & (held["text_key"] == plan["plan_key"]))
    met = met.repartitionByRange("block", "place").sortWithinPartitions("block", "place")
    return met.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
