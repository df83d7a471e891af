"""Change-watch listings as records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshot import CollectError, LoginRequired
from tidemark.sources.base import Collected, Collector, as_records

# Bytes of a listing beyond which it is an error, and characters at which a watch's text is cut; the service compared with has the same bounds.
MOST_LISTING, MOST_TEXT = 32 << 20, 1 << 20


class Watches(Collector):
    """Watches listed in the JSON files at ``listing`` (uuid, url, title, page_title, last_changed, last_error, tags), and their latest text.

    A saved listing of the service's API; ``texts`` names a folder of JSON lines (uuid, text). A text is cut at MOST_TEXT characters (changes beyond are not seen),
    a listing over MOST_LISTING bytes is an error.
    """

    options = {"listing": str, "tag": str, "texts": str}
    required = ("listing",)
    default_title = ("title",)
    SCHEMA = "uuid string, url string, title string, page_title string, last_changed bigint, last_error string, tags array<string>, status int"

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.given["listing"])
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at) and fs.getContentSummary(at).getLength() > MOST_LISTING:
            raise CollectError("the listing is too long")
        try:
            rows = spark.read.schema(self.SCHEMA).option("mode", "FAILFAST").json(self.given["listing"])
        except Exception as e:
            raise CollectError(str(e).splitlines()[0][:200]) from None
        if rows.where("status in (401, 403)").limit(1).count():
            raise LoginRequired("the service refused the key", "set a valid key")
        if "tag" in self.given:
            rows = rows.where(F.array_contains("tags", self.given["tag"]))
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        error = F.when(F.lower("last_error").isin("false", ""), F.lit(None)).otherwise(F.col("last_error"))
        changed = F.when(F.col("last_changed") > 0, F.date_format(F.timestamp_seconds("last_changed"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        out = rows.select("uuid", "url", F.coalesce(blank("title"), blank("page_title"), "url").alias("title"), changed.alias("last_changed"), error.alias("last_error"))
        if "texts" in self.given:
            texts = spark.read.schema("uuid string, text string").json(self.given["texts"]).select("uuid", F.substring("text", 1, MOST_TEXT).alias("text"))
            out = out.join(texts, "uuid", "left")
        return Collected(as_records(out, F.col("uuid"), [c for c in out.columns if c != "uuid"]))
