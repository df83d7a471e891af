"""A table of mail headers as records, within a window of days and a cap."""

from __future__ import annotations

import base64
import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tidemark.sources.base import Collected, Collector, Window, as_records

#: Years of a date header that are believed.
YEARS = (1970, 9998)
FIELDS = ("subject", "from", "to", "date", "received", "folder", "seen", "flagged", "answered", "size")


def days_of(mails: DataFrame, cap: int, day: str = "day") -> DataFrame:
    """(start, mails): the longest run of latest days with at most ``cap`` mails in one folder, from (day); cumulative counts in one pass. A row for each day."""
    days = mails.groupBy(day).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.orderBy(F.desc(day)).rowsBetween(W.unboundedPreceding, 0))
    return days.withColumn("total", total).where(F.col("total") <= cap).agg(F.min(day).alias("start"), F.max("total").alias("mails"))


def days_within(mails: DataFrame, cap: int) -> DataFrame:
    """Per folder, the first of the longest run of latest days holding at most ``cap`` mails; null if the last day alone holds more."""
    per_day = mails.groupBy("folder", F.to_date("received").alias("day")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("folder").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, 0))
    return per_day.withColumn("total", total).groupBy("folder").agg(F.min(F.when(F.col("total") <= cap, F.col("day"))).alias("first_day"))


def folder_code(name: str) -> str:
    """A folder's name in the protocol's own form of UTF-7: printable ASCII as it is (& as &-), other runs in base64 between & and -."""
    parts = re.findall(r"[ -~]+|[^ -~]+", name)
    coded = lambda run: "&" + base64.b64encode(run.encode("utf-16-be")).decode("ascii").rstrip("=").replace("/", ",") + "-"
    return "".join(p.replace("&", "&-") if " " <= p[0] <= "~" else coded(p) for p in parts)


def header_date(text: str | None) -> datetime | None:
    """A date header as UTC; without a zone it counts as UTC, and none that cannot be read or lies beyond YEARS."""
    try:
        at = parsedate_to_datetime(text)
        at = at.replace(tzinfo=at.tzinfo or timezone.utc).astimezone(timezone.utc)
        return at if YEARS[0] <= at.year <= YEARS[1] else None
    except (TypeError, ValueError, IndexError, OverflowError):
        return None


@F.arrow_udf(TimestampType())
def header_dates(x: pa.Array) -> pa.Array:
    return pa.array([header_date(v) for v in x.to_pylist()], pa.timestamp("us", "UTC"))


def clean_headers(mails: DataFrame) -> DataFrame:
    """Header texts trimmed, lone surrogates replaced; ``date`` read from its text where it is one, and ``date`` and ``received`` stand in for one another."""
    out = mails
    for c, kind in mails.dtypes:
        if kind == "string" and c in ("subject", "from", "to", "message_id"):
            out = out.withColumn(c, F.trim(F.make_valid_utf8(F.col(f"`{c}`"))))
    if "date" not in out.columns:
        return out
    date = header_dates(F.col("date")) if dict(out.dtypes)["date"] == "string" else F.col("date").cast("timestamp")
    year = F.year(date)
    out = out.withColumn("date", F.coalesce(F.when(year.between(*YEARS), date), F.col("received").cast("timestamp")))
    return out.withColumn("received", F.coalesce(F.col("received").cast("timestamp"), F.col("date")))


class Mailbox(Collector):
    """Headers in ``view`` (folder, uid, message_id, received and the fields above), newest ``days`` of each of ``folders``.

    The protocol itself (a socket and a login) needs a network; a reader that fills such a view plugs in here. A folder over
    ``cap`` mails has its window shortened to whole days, or keeps the newest uids of its last day.
    """

    options = {"view": str, "folders": list, "days": int, "cap": int}
    required = ("view", "folders")
    ranges = {"days": (1, 365), "cap": (1, 5000)}
    default_track = ("folder",)
    default_title = ("subject", "from", "received")

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        folders, days, cap = self.given["folders"], self.given.get("days", 14), self.given.get("cap", 2000)
        midnight = now.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
        begin = midnight - timedelta(days=days)
        at = F.array_position(F.array(*map(F.lit, folders)), F.col("folder"))
        mails = clean_headers(spark.table(self.given["view"])).where(F.col("folder").isin(folders) & (F.to_date("received") >= F.lit(begin.date())))
        first = F.broadcast(days_within(mails, cap))  # a row for each configured folder
        met = mails.join(first, "folder", "left")
        newest = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("uid")))
        met = met.withColumn("__newest", newest).where(F.coalesce(F.to_date("received") >= F.col("first_day"), F.col("__newest") <= cap))
        starts = {}
        for r in met.groupBy("folder").agg(F.min("received").alias("t"), F.min("first_day").alias("d")).collect():  # a row for each folder
            capped = r["d"] is None or r["d"] > begin.date()
            starts[r["folder"]] = (r["t"].replace(tzinfo=timezone.utc) if capped else begin) + timedelta(days=1)
        key = F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat(F.lit("uid:"), "folder", F.lit("/"), F.col("uid").cast("string")))
        rest = [c for c in FIELDS if c in met.columns]
        one = met.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rest), F.struct(at, "uid")).alias("r")).select("__key", "r.*")
        records = as_records(one, F.col("__key"), rest)
        return Collected(records, window=Window("received", begin + timedelta(days=1), "folder", starts))
