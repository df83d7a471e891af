"""A training corpus from raw documents: quality filter, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and reads all that the one before it kept; ``run`` writes each result as
Parquet in the shared folder and rereads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, packing, quality, simhash, token_counts
from tidemark.llm.common import drop, one_of_each, outlasting, scope, sha, table, written

VOCABULARY = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling towards documents labelled good draws, with all columns.

    Null and empty texts have weight 1 and are drawn as such; rows of one id have equal noise; ties at the threshold stay; without labels of
    both kinds, and on an empty table, everything stays.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that of the largest doc_id, of several such rows the one whose JSON text hashes lowest.

    A null text counts as empty; a null doc_id stays only if its text has no row with an id. All columns are carried in a struct, so their names never clash.
    """
    groups = exact_dedup.exact_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = written(groups.groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("text_sha")).agg(F.count("*").alias("rows")), "kept")
    held = docs.select(F.col("doc_id").cast("long").alias("row_id"), sha(docs["text"]).alias("row_sha"), F.struct("*").alias("row"))
    same = (F.col("row_sha") == F.col("text_sha")) & F.col("row_id").eqNullSafe(F.col("id"))
    out = held.join(keep.where("rows = 1"), same, "left_semi").select("row")
    if not keep.where("rows > 1").isEmpty():
        out = out.unionByName(one_of_each(held.join(keep.where("rows > 1"), same, "left_semi"), ["row_id", "row_sha"]).select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8 or more), and all others.

    Rows go by id and text together, so another text of an id that goes stays. Texts without words are near duplicates of nothing; a null doc_id
    is the last of its group; an empty table stays empty.
    """
    gone = written(simhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("text_sha")), "near")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["id"]) & (sha(docs["text"]) == gone["text_sha"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source in full at least once, rarer ones up to twice, dealt by token counts over blocks that all hold the target weights.

    A null source is the empty one; a null text has no tokens and is read once; rows repeating id, source and text are one.
    """
    return mixing.mix(docs, tokens=token_counts.token_count(public_tokenizers.path(VOCABULARY)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text is the end id alone; a row that the mixture repeats is packed each time."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, block naming and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's own tables go when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    kept: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            docs = outlasting(out, name)
        drop(*kept)
        kept = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
