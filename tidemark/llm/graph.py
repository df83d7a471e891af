"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, reread, write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b) of longs.

    Alternates the large-star and small-star steps, each a partial minimum and a join; every
    round is a written table, so lineage stays short and a lost executor costs one round at most.
    Ends when the edges form stars. Loops a = b are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    path = write_table(e, "edges")
    while True:
        e = reread(spark, path, "hi long, lo long")
        if _stars(e):
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        after = write_table(_small_star(_large_star(e)), "edges")
        drop_table(spark, path)
        path = after


def _stars(e: DataFrame) -> bool:
    """Each node has one smaller neighbour, which has none."""
    twice = e.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and e.join(e.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to its smallest one."""
    least = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("lo").alias("v")))
    least = least.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return e.join(least, e.lo == least.u).select("hi", F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to its smallest one."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    near = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return near.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
