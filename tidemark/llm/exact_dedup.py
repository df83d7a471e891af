"""Exact dedup by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from itertools import count as numbers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, texts, written


#: Rows that repeat id and text, made again at once.
REPEATS = 4096


def exact_groups(docs: DataFrame, block_bytes: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of identical texts: doc_id, keep_id, group_size, kept, text_sha256.

    UTF-8 bytes are cut into blocks of ``block_bytes``. Distinct blocks (combined before the only
    shuffle of content) are sorted within hash partitions and numbered: a block's name. Adjacent
    names are then paired and the distinct pairs sorted and numbered in the same way, halving a document's names
    each round, until one is left. Names are injective at every level, so two documents of
    equal block count have equal last names exactly if their texts are equal: (blocks, name) is a collision-free
    identity, compared instead of the text. Blocks find their names through a 128-bit locator that is
    checked to be injective over the distinct blocks (else it is drawn anew), so no hash decides equality.

    Only names travel after the first shuffle: a hot text costs one row per copy, and its rows meet
    their name in a join whose skewed side AQE splits.

    A row comes back for each row of ``docs``. The largest doc_id of a group stays: exactly one row of a group is kept, also where
    several rows repeat both id and text. A null text counts as empty. A null doc_id comes after all others, so it stays only if its text has no
    row with an id. An empty table gives no rows.
    """
    blocks = _blocks(texts(docs, id_col, text_col), block_bytes)
    level = written(_with_names(blocks), "names0")
    levels, done = [level], [level.where("m = 1").select("doc_id", "sha", "m", "name", "n")]
    most = level.agg(F.max("m")).first()[0] or 1
    rows, k = level.where("m > 1"), 0
    while (1 << k) < most:
        k += 1
        rows = written(_pair(rows), f"names{k}")
        levels.append(rows)
        one = F.col("m") <= (1 << k)
        done.append(rows.where(one).select("doc_id", "sha", "m", "name", "n"))
        rows = rows.where(~one)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    every = written(every.groupBy("doc_id", "sha", "m", "name").agg(F.sum("n").alias("n")), "identities")
    drop(*levels)
    groups = every.groupBy("m", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups")  # a shuffle of its own on each side, so that AQE can split a hot group's rows
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    met = every.join(groups, ["m", "name"], "left").withColumn("keep", keep)
    # rows that repeat id and text were one so far; a row each again, in two steps so that no array grows with their number
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {REPEATS}"))))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(REPEATS), F.col("n") - F.col("part") * REPEATS) - 1)))
    return met.select(
        "doc_id",
        F.col("keep").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("part") == 0) & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """A row for each block; an empty text is one empty block."""
    m = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / size)).cast("int")
    return (
        docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), m.alias("m"), F.col("text").cast("binary").alias("bytes"))
        .select("doc_id", "sha", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("pos"), "bytes")
        .select("doc_id", "sha", "m", "pos", F.expr(f"substring(bytes, pos * {size} + 1, {size})").alias("block"))
    )


def _with_names(blocks: DataFrame) -> DataFrame:
    for seed in numbers(1):
        at = [F.xxhash64(F.lit(seed), F.col("block")).alias("h1"), F.xxhash64(F.lit(-seed), F.col("block")).alias("h2")]
        distinct = blocks.select("block").distinct().sortWithinPartitions("block")
        names = written(distinct.select(*at, F.monotonically_increasing_id().alias("name")), "blocks")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return (
                blocks.select("doc_id", "sha", "m", "pos", *at)
                .join(names, ["h1", "h2"])
                .select("doc_id", "sha", "m", "pos", "name", F.lit(1).cast("long").alias("n"))
            )


def _pair(rows: DataFrame) -> DataFrame:
    """Names of adjacent pairs; a last name without a partner is carried up.

    Documents of equal block count carry at equal places, so a carried name is only ever compared with carried ones.
    """
    left = F.col("pos") % 2 == 0
    pairs = rows.groupBy("doc_id", "sha", "m", F.expr("pos div 2").cast("int").alias("pos")).agg(
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.max(F.when(~left, F.col("name"))).alias("b"),
        F.sum(F.when(left, F.col("n"))).alias("n"),
    )
    names = (
        pairs.where("b is not null").select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("pair"))
    )
    return pairs.join(names, ["a", "b"], "left").select("doc_id", "sha", "m", "pos", F.coalesce("pair", "a").alias("name"), "n")
