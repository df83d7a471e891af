"""Registered queries over the driver's tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.functions import lines as L
from tidemark.functions import text as X
from tidemark.functions.udfs import text_change
from tidemark.operators import log, outcomes, score, snapshot, transcripts, worlds
from tidemark.plans import buckets
from tidemark.plans.model import EVENTS, RECORDS, Rule, SourceConfig
from tidemark.plans.runner import HASHED
from tidemark.plans.scratch import folder, settled
from tidemark.plans.store import Store
from tidemark.sources import tree
from tidemark.sources.base import as_records, collector
from tidemark.sources.mail import days_of
from tidemark.streaming import log as logs
from tidemark.streaming.replay import TICKS, Replay
from tidemark.streaming.outcomes import ANNOUNCED, LATENESS, replay

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- two snapshots of orders ------------------------------------------------------------------------

_CTE = """WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS prio,
  CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS eta FROM orders),
old AS (SELECT * FROM base WHERE k % 17 <> 3),
new AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'X' ELSE status END AS status, prio,
  CAST(CASE WHEN k % 7 = 0 THEN price + 1 ELSE price END AS DECIMAL(18,2)) AS price,
  CASE WHEN k % 13 = 0 THEN eta + 5 ELSE eta END AS eta FROM base WHERE k % 19 <> 5),
met AS (SELECT coalesce(o.k, n.k) AS key, o.k IS NOT NULL AS in_old, n.k IS NOT NULL AS in_new,
  o.status AS s0, n.status AS s1, o.prio AS p0, n.prio AS p1, o.price AS c0, n.price AS c1, o.eta AS e0, n.eta AS e1
  FROM old o FULL OUTER JOIN new n ON o.k = n.k),
diff AS (SELECT *, CASE WHEN NOT in_old THEN 'added' WHEN NOT in_new THEN 'removed' ELSE 'modified' END AS kind FROM met
  WHERE NOT in_old OR NOT in_new OR s0 <> s1 OR e0 <> e1)
"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("eta"),
    )
    new = base.where("k % 19 <> 5").select(
        "k",
        F.when(F.expr("k % 11 = 0"), "X").otherwise(F.col("status")).alias("status"),
        "prio",
        F.when(F.expr("k % 7 = 0"), F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)").alias("price"),
        F.when(F.expr("k % 13 = 0"), F.date_add("eta", 5)).otherwise(F.col("eta")).alias("eta"),
    )
    return base.where("k % 17 <> 3"), new


def _diff(spark, d, track=("status", "eta"), **options) -> DataFrame:
    old, new = snapshots(spark, d)
    return snapshot.diff(old, new, "k", track, long_text=False, **options)


@query(_CTE + "SELECT key, kind FROM diff")
def diff_kinds(spark, d):
    return _diff(spark, d).select("key", "kind")


@query(_CTE + "SELECT kind, count(*) AS n FROM diff GROUP BY kind")
def diff_counts(spark, d):
    return _diff(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    _CTE
    + """SELECT key, 'status' AS field, s0 AS old, s1 AS new FROM diff WHERE kind = 'modified' AND s0 <> s1
UNION ALL SELECT key, 'eta', CAST(e0 AS VARCHAR), CAST(e1 AS VARCHAR) FROM diff WHERE kind = 'modified' AND e0 <> e1"""
)
def diff_changes_exploded(spark, d):
    return _diff(spark, d).select("key", F.explode("changes").alias("c")).select("key", "c.field", "c.old", "c.new")


@query(_CTE + "SELECT key, CAST(c0 AS VARCHAR) AS old, CAST(c1 AS VARCHAR) AS new FROM met WHERE c0 <> c1")
def diff_tracked_only(spark, d):
    c = _diff(spark, d, ("price",)).where("kind = 'modified'").select("key", F.explode("changes").alias("c"))
    return c.select("key", "c.old", "c.new")


@query(_CTE + "SELECT key FROM met WHERE in_old AND in_new AND s0 = s1 AND e0 = e1 AND c0 <> c1")
def silent_updates(spark, d):
    old, new = snapshots(spark, d)
    h = snapshot.content_hash({c: k for c, k in new.dtypes if c != "k"})
    moved = snapshot.delta(old.withColumn("h", h), new.withColumn("h", h), "k", "h")
    told = snapshot.diff(old, new, "k", ["status", "eta"], long_text=False)
    return moved.select(F.col("k").alias("key")).join(told.select("key"), "key", "left_anti")


@query(_CTE + "SELECT key, kind FROM diff WHERE NOT (in_old AND key % 23 = 0)")
def diff_unavailable_carried(spark, d):
    old, new = snapshots(spark, d)
    lost = t(spark, d, "orders").where("o_orderkey % 23 = 0").select(F.col("o_orderkey").alias("k"))
    read = new.join(snapshot.carried(old, lost, "k").select("k"), "k", "left_anti")
    return snapshot.diff(snapshot.visible(old, lost, "k"), read, "k", ["status", "eta"], long_text=False).select("key", "kind")


@query(
    _CTE
    + """, starts AS (SELECT * FROM (VALUES ('1-URGENT', DATE '1999-01-01'), ('5-LOW', DATE '1996-01-01')) s(scope, start))
SELECT m.key, CAST(m.e0 AS VARCHAR) AS eta FROM met m LEFT JOIN starts s ON m.p0 = s.scope
WHERE in_old AND NOT in_new AND e0 < coalesce(s.start, DATE '1998-01-01')"""
)
def diff_aged_out_scoped(spark, d):
    old, new = snapshots(spark, d)
    starts = spark.createDataFrame([("1-URGENT", "1999-01-01"), ("5-LOW", "1996-01-01")], "scope string, start string").withColumn("start", F.to_date("start"))
    gone = snapshot.aged_out(old, new, "k", F.col("eta"), F.to_date(F.lit("1998-01-01")), starts, "prio")
    return gone.select(F.col("k").alias("key"), F.col("eta").cast("string").alias("eta"))


@query(_CTE + """SELECT key, '"' || s1 || '" prio "' || p1 || '"' AS title, 'status=' || s1 || ';eta=' || CAST(e1 AS VARCHAR) AS shown FROM diff WHERE kind = 'added'""")
def added_with_title(spark, d):
    """The label of added records: their title fields as records hold them, in the words of a digest's line."""
    a = _diff(spark, d, decorate_added=True).where("kind = 'added'")
    fields = as_records(a.select("key", "new.status", "new.prio", F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit("="), c["new"])), ";").alias("shown")), F.col("key"), ["status", "prio", "shown"])
    e = fields.select("key", F.col("fields")["shown"]["v"].alias("shown"), F.col("key").alias("record_key"), F.struct(L.titles(F.col("fields"), ["status", "prio"]).alias("title")).alias("detail"))
    return e.select(F.col("key").cast("long").alias("key"), L.record_label(F.lit(""), L.LINE_CAP, L.TITLE_CAP).alias("title"), "shown")


_WEIGHT = "CASE kind WHEN 'added' THEN 3 ELSE 4 END"


@query(_CTE + f"SELECT key, 2 * {_WEIGHT} AS importance FROM diff")
def importance(spark, d):
    return _diff(spark, d).select("key", score.importance(F.lit("normal"), F.col("kind"), F.col("changes")).alias("importance"))


def _scored(spark, d, *rules: Rule) -> DataFrame:
    x = _diff(spark, d)
    value = lambda f: F.coalesce(F.col(f"new.{f}"), F.col(f"old.{f}")) if f in ("status", "prio") else F.lit(None).cast("string")
    return x.select("key", score.importance(F.lit("high"), F.col("kind"), F.col("changes"), rules, value).alias("importance"))


@query(_CTE + f"SELECT key, 3 * {_WEIGHT} + CASE WHEN coalesce(s1, s0) = 'F' THEN 7 ELSE 0 END AS importance FROM diff")
def importance_highlight_equals(spark, d):
    return _scored(spark, d, Rule("status", "equals", "F", 7))


@query(_CTE + f"SELECT key, 3 * {_WEIGHT} + CASE WHEN contains(lower(coalesce(p1, p0)), 'urgent') THEN 20 ELSE 0 END AS importance FROM diff")
def importance_highlight_contains(spark, d):
    return _scored(spark, d, Rule("prio", "contains", "Urgent"), Rule("prio", "contains", "URGENT"))


@query(_CTE + f"SELECT key, 3 * {_WEIGHT} + CASE WHEN kind = 'modified' AND s1 = 'X' AND s0 <> 'X' THEN -5 ELSE 0 END AS importance FROM diff")
def importance_highlight_changed_to(spark, d):
    return _scored(spark, d, Rule("status", "changed_to", "X", -5))


@query(_CTE + "SELECT key, kind, 1000 + row_number() OVER (ORDER BY CAST(key AS VARCHAR)) AS seq FROM diff")
def event_seq(spark, d):
    x = _diff(spark, d).select(F.col("key").cast("string").alias("text_key"), "key", "kind")
    return log.with_seq(x, ["text_key"], 1000).select("key", "kind", "seq")


@query(_CTE + f""", s AS (SELECT key, kind, 2 * {_WEIGHT} + CASE WHEN kind = 'modified' AND s1 = 'X' AND s0 <> 'X' THEN 10 ELSE 0 END AS importance FROM diff)
SELECT key, kind, importance, row_number() OVER (ORDER BY importance DESC, key) AS rank FROM s ORDER BY importance DESC, key LIMIT 200""")
def ranked_changes(spark, d):
    """Snapshots to a ranked digest: diff, importance, top 200 before any numbering window."""
    x = _diff(spark, d)
    rules = [Rule("status", "changed_to", "X")]
    x = x.select("key", "kind", score.importance(F.lit("normal"), F.col("kind"), F.col("changes"), rules, lambda f: F.col(f"new.{f}")).alias("importance"))
    top = x.orderBy(F.desc("importance"), "key").limit(200)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "key")))


# --- the events table as a change log -------------------------------------------------------------------

_LOG = """WITH log AS (SELECT event_id + 1 AS seq, 'u' || CAST(user_id AS VARCHAR) AS source_id,
  CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'added' WHEN 'purchase' THEN 'removed'
    WHEN 'signup' THEN 'source_recovered' ELSE 'source_error' END AS kind,
  CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, ts FROM events),
scored AS (SELECT *, CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END AS pw,
  CASE kind WHEN 'modified' THEN 4 WHEN 'added' THEN 3 WHEN 'removed' THEN 4 WHEN 'source_recovered' THEN 1 ELSE 5 END AS kw FROM log),
effective AS (SELECT *, CASE WHEN kind = 'source_error' AND max(CASE WHEN kind = 'source_recovered' THEN seq END) OVER (PARTITION BY source_id) > seq
  THEN pw ELSE pw * kw END AS effective FROM scored),
ranked AS (SELECT *, row_number() OVER (ORDER BY effective DESC, seq) AS rank,
  row_number() OVER (PARTITION BY source_id ORDER BY effective DESC, seq) AS ordinal FROM effective)
"""


def change_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    kind = F.when(kind == "click", "modified").when(kind == "view", "added").when(kind == "purchase", "removed").when(kind == "signup", "source_recovered").otherwise("source_error")
    user = F.col("user_id") % 3
    return t(spark, d, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"),
        kind.alias("kind"),
        F.when(user == 0, "high").when(user == 1, "normal").otherwise("low").alias("priority"),
        "ts",
    )


def effective_log(spark, d, cursor: int = 0) -> DataFrame:
    x = change_log(spark, d).where(F.col("seq") > cursor)
    x = x.withColumn("importance", score.importance(F.col("priority"), F.col("kind"), F.array()))
    x = x.withColumn("detail", F.struct(F.lit(None).cast("array<string>").alias("selectors")))
    return log.effective_importance(x, F.col("priority"), score.priority_weight(F.col("priority")), score.kind_weight(F.col("kind")))


@query(_LOG + "SELECT seq, effective FROM effective")
def effective_importance(spark, d):
    return effective_log(spark, d).select("seq", "effective")


@query(_LOG + "SELECT seq, rank FROM ranked")
def rank_global(spark, d):
    return log.rank(effective_log(spark, d).select("seq", "effective")).select("seq", "rank")


@query(_LOG + "SELECT source_id, seq, ordinal FROM ranked")
def rank_in_source(spark, d):
    return log.rank(effective_log(spark, d).select("seq", "source_id", "effective"), ordinal=True).select("source_id", "seq", "ordinal")


@query(_LOG + "SELECT seq, effective FROM effective ORDER BY effective DESC, seq LIMIT 100")
def topk(spark, d):
    return effective_log(spark, d).select("seq", "effective").orderBy(F.desc("effective"), "seq").limit(100)


_LINE = "'  ' || kind || ' ' || source_id || '  tide://evt/' || CAST(seq AS VARCHAR)"


@query(
    _LOG
    + f"""SELECT seq, CAST(size_so_far AS BIGINT) AS size_so_far FROM (SELECT seq, sum(length({_LINE}) + 1) OVER (ORDER BY effective DESC, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size_so_far FROM ranked) x WHERE size_so_far <= 28000"""
)
def budget_prefix(spark, d):
    """The lines that alone fit a budget of 8,000 tokens: at most 1,400 lines can (the shortest is 20), so the rest never reaches the window."""
    line = F.concat(F.lit("  "), "kind", F.lit(" "), "source_id", F.lit("  "), X.event_handle(F.col("seq")))
    top = effective_log(spark, d).withColumn("line", line).orderBy(F.desc("effective"), "seq").limit(28000 // 20)
    return log.running_size(top, F.length("line"), [F.desc("effective"), F.asc("seq")]).where("size_so_far <= 28000").select("seq", "size_so_far")


@query(
    _LOG
    + """SELECT source_id, count(*) AS total, count(*) FILTER (rank <= 500) AS shown, count(*) FILTER (rank > 500) AS omitted,
  max(effective) FILTER (rank <= 500) AS max_shown, max(effective) FILTER (rank > 500) AS max_omitted FROM ranked GROUP BY source_id"""
)
def group_headers(spark, d):
    return log.groups(log.rank(effective_log(spark, d).select("seq", "source_id", "effective")), 500)


@query(
    _LOG
    + """SELECT source_id, omitted, row_number() OVER (ORDER BY m DESC, source_id) AS place FROM
  (SELECT source_id, count(*) AS omitted, max(effective) AS m FROM ranked WHERE rank > 500 GROUP BY source_id) x"""
)
def omitted_by_source(spark, d):
    return log.omitted(log.groups(log.rank(effective_log(spark, d).select("seq", "source_id", "effective")), 500)).select("source_id", "omitted", "place")


@query(_LOG + "SELECT seq, source_id FROM log WHERE seq > 700 AND source_id = 'u7'")
def events_after(spark, d):
    return log.after(change_log(spark, d), 700, "u7").select("seq", "source_id")


@query(_LOG + "SELECT seq, source_id, kind FROM log WHERE seq > 700")
def events_streamed(spark, d):
    """The log as a stream past a cursor, read in three goes while it grows, each a restart from the checkpoint."""
    store, out = Store(spark, folder(spark, "log")), folder(spark, "streamed")
    x = change_log(spark, d).withColumnRenamed("ts", "created_at")
    drafts = x.select(*(F.col(f.name) if f.name in x.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields))
    end, total = 0, x.agg(F.max("seq")).first()[0] or 0
    stream = logs.registered(spark).readStream.format(logs.NAME).option("after", 700).load(store.root)
    for part in (1, 2, 3):
        begin, end = end, total * part // 3
        commit = store.begin()
        commit.append("events", log.in_range(drafts, begin + 1, end))
        commit.manifest.next_seq = end + 1
        commit.publish()
        go = stream.select("seq", "source_id", "kind").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        go.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, source_id string, kind string").parquet(out)


@query(_LOG + "SELECT seq, kind FROM log WHERE seq BETWEEN 100 AND 900 AND seq > 250")
def events_range(spark, d):
    return log.in_range(change_log(spark, d), 100, 900, past=250).select("seq", "kind")


@query(_LOG + "SELECT seq, source_id FROM log WHERE seq < 800 ORDER BY seq DESC LIMIT 51")
def page_newest(spark, d):
    return log.newest(change_log(spark, d), 51, 800).select("seq", "source_id")


@query(_LOG + "SELECT seq, kind, (SELECT count(*) FROM log WHERE seq BETWEEN 1 AND 900 AND source_id = 'u5') AS total FROM log WHERE seq BETWEEN 1 AND 900 AND source_id = 'u5' ORDER BY seq LIMIT 20")
def batch_page(spark, d):
    return log.page(log.in_range(change_log(spark, d), 1, 900, "u5").select("seq", "kind"), 20)


@query(_LOG + "SELECT min(seq) AS first, max(seq) AS last, count(*) AS n FROM log WHERE seq > 300")
def selection_bounds(spark, d):
    return log.bounds(log.after(change_log(spark, d), 300))


@query(_LOG + "SELECT source_id, max(seq) AS seq FROM log WHERE kind = 'source_recovered' GROUP BY source_id")
def latest_recovery(spark, d):
    return log.latest_recovery(change_log(spark, d))


@query(_LOG + "SELECT seq, effective FROM effective ORDER BY effective DESC, seq LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    return log.offset_page(effective_log(spark, d).select("seq", "effective"), [F.desc("effective"), F.asc("seq")], 50, 25)


# --- keys -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return snapshot.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS r FROM lineitem) x WHERE r = 1")
def first_wins_dedupe(spark, d):
    x = snapshot.first_wins(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ORDER.split(", ")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY 1")
def composite_key(spark, d):
    key = snapshot.composite_key(F.col("l_orderkey"), F.col("l_linenumber"))
    return t(spark, d, "lineitem").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


# --- runs of a source ---------------------------------------------------------------------------------------------

_RUNS = """WITH runs AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS source_id, event_id AS run, event_type = 'error' AS failed, ts FROM events),
w AS (SELECT *, coalesce(lag(failed) OVER (PARTITION BY source_id ORDER BY run), false) AS before,
  coalesce(max(CASE WHEN NOT failed THEN 1 END) OVER (PARTITION BY source_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM runs)
"""


def runs(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_id").alias("run"), (F.col("event_type") == "error").alias("failed"), "ts")


@query(_RUNS + "SELECT source_id, run FROM w WHERE failed AND NOT before")
def announced_errors(spark, d):
    return outcomes.streaks(runs(spark, d)).where("kind = 'source_error'").select("source_id", "run")


@query(_RUNS + "SELECT source_id, run FROM w WHERE NOT failed AND before")
def recoveries(spark, d):
    return outcomes.streaks(runs(spark, d)).where("kind = 'source_recovered'").select("source_id", "run")


@query(_RUNS + "SELECT source_id, min(run) AS run FROM runs WHERE NOT failed GROUP BY source_id")
def baselines(spark, d):
    return outcomes.streaks(runs(spark, d)).where("kind = 'baseline'").select("source_id", "run")


@query(
    _RUNS
    + """, s AS (SELECT *, sum(CASE WHEN failed AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM w)
SELECT source_id, min(run) AS first_run, max(run) AS last_run, count(*) AS failures FROM s WHERE failed GROUP BY source_id, streak"""
)
def error_streaks(spark, d):
    return outcomes.error_streaks(runs(spark, d))


_AT = "CASE WHEN run % 10 = 0 THEN ts - INTERVAL 6 HOUR ELSE ts END"


@query(
    _RUNS
    + f""", a AS (SELECT source_id, run, date_trunc('second', {_AT}) AS tried FROM runs),
b AS (SELECT *, max(tried) OVER (PARTITION BY source_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM a)
SELECT source_id, run FROM b WHERE latest > tried"""
)
def stale_results(spark, d):
    at = F.when(F.col("run") % 10 == 0, F.col("ts") - F.expr("INTERVAL 6 HOUR")).otherwise(F.col("ts"))
    return outcomes.late(runs(spark, d).withColumn("at", at)).select("source_id", "run")


@query(
    """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
cum AS (SELECT day, sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM days)
SELECT CAST(min(day) AS VARCHAR) AS start, CAST(max(total) AS BIGINT) AS mails FROM cum WHERE total <= 500"""
)
def window_days_bisect(spark, d):
    return days_of(t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), 500).select(F.col("start").cast("string").alias("start"), "mails")


# --- retention and consumers -----------------------------------------------------------------------------------------

_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


def _cutoff():
    return F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))


def _dated(spark, d) -> DataFrame:
    return change_log(spark, d).select("seq", "source_id", "kind", F.col("ts").cast("timestamp_ntz").alias("created_at"), (F.col("seq") % 500).cast("string").alias("record_key"))


@query(_LOG + f"SELECT seq FROM log WHERE ts >= {_CUT}")
def prune_events(spark, d):
    return log.prune(_dated(spark, d), _cutoff()).select("seq")


@query(
    _LOG
    + f""", records AS (SELECT 'u' || CAST(o_custkey % 150 AS VARCHAR) AS source_id, CAST(o_orderkey % 500 AS VARCHAR) AS key, bool_or(o_orderkey % 17 = 3) AS present FROM orders GROUP BY 1, 2)
SELECT source_id, key, present FROM records r WHERE present OR EXISTS
  (SELECT 1 FROM log l WHERE l.ts >= {_CUT} AND l.source_id = r.source_id AND CAST(l.seq % 500 AS VARCHAR) = r.key)"""
)
def prune_records(spark, d):
    o = t(spark, d, "orders")
    records = o.groupBy(F.concat(F.lit("u"), (F.col("o_custkey") % 150).cast("string")).alias("source_id"), (F.col("o_orderkey") % 500).cast("string").alias("key")).agg(
        F.bool_or(F.col("o_orderkey") % 17 == 3).alias("present")
    )
    return log.prune_records(records, log.prune(_dated(spark, d), _cutoff())).select("source_id", "key", "present")


@query(_LOG + f"SELECT greatest(40, coalesce(max(seq), 0)) AS pruned_through FROM log WHERE ts < {_CUT}")
def pruned_floor(spark, d):
    return log.pruned_through(_dated(spark, d), _cutoff(), F.lit(40).cast("long"))


@query(
    """WITH cursors AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS agent_id, max(event_id) AS seq FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY 1),
served AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS agent_id, event_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0)
SELECT a.agent_id, c.seq, coalesce(s.n, 0) AS served_count, s.last_served FROM (SELECT agent_id FROM cursors UNION SELECT agent_id FROM served) a
LEFT JOIN cursors c USING (agent_id) LEFT JOIN (SELECT agent_id, count(*) AS n, max(event_id) AS last_served FROM served GROUP BY 1) s USING (agent_id)"""
)
def agent_summary(spark, d):
    e = t(spark, d, "events").withColumn("agent_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    cursors = e.where("event_type = 'view' and user_id % 2 = 0").groupBy("agent_id").agg(F.max("event_id").alias("seq"))
    served = e.where("event_type = 'purchase' and user_id % 3 = 0").select("agent_id", F.col("event_id").alias("at"))
    return log.consumers(cursors, served)


@query(
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS agent_id, (SELECT max(event_id) FROM events) - max(event_id) AS lag,
max(event_id) < 9000 AS gap FROM events WHERE event_type = 'signup' GROUP BY user_id"""
)
def cursor_lag(spark, d):
    """How far each consumer is behind the log's end, and whether it missed events pruned through 9,000."""
    e = t(spark, d, "events")
    at = e.where("event_type = 'signup'").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent_id")).agg(F.max("event_id").alias("seq"))
    return log.behind(at, e.agg(F.max("event_id")).first()[0], 9000)


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query(
    f"""WITH s AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS source_id, max(ts) AS last, 900 + 86400 * (user_id % 5) AS schedule FROM events GROUP BY user_id)
SELECT source_id, strftime(last + to_seconds(schedule), '%Y-%m-%dT%H:%M:%SZ') AS due_at FROM s WHERE last + to_seconds(schedule) <= {_NOW}"""
)
def due_sources(spark, d):
    s = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("last_success_at"))
    s = s.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), "last_success_at", F.lit(None).cast("timestamp_ntz").alias("last_error_at"), (F.lit(900) + F.lit(86400) * (F.col("user_id") % 5)).cast("int").alias("schedule"))
    return outcomes.due(s, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))).select("source_id", X.iso(F.col("due_at")).alias("due_at"))


@query(f"SELECT user_id, epoch(date_trunc('second', {_NOW})) - epoch(date_trunc('second', max(ts))) > 2 * (3600 + 3600 * (user_id % 4)) AS stale FROM events GROUP BY user_id")
def heartbeat_stale(spark, d):
    """Staleness is strictly more than twice the schedule."""
    last = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.select("user_id", outcomes.stale(F.col("last"), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 3600 + 3600 * (F.col("user_id") % 4)).alias("stale"))


@query(
    f"""WITH s AS (SELECT max(ts) AS last, 900 + 86400 * (user_id % 5) AS schedule FROM events GROUP BY user_id)
SELECT CAST(least(5, greatest(0, epoch(date_trunc('second', min(last + to_seconds(schedule)))) - epoch({_NOW}))) AS BIGINT) AS seconds FROM s"""
)
def soonest_due(spark, d):
    s = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_success_at"))
    s = s.withColumn("last_error_at", F.lit(None).cast("timestamp")).withColumn("schedule", (F.lit(900) + F.lit(86400) * (F.col("user_id") % 5)).cast("int"))
    return outcomes.soonest(s, F.to_timestamp(F.lit("2024-01-31 00:00:00")))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm'
WHEN s < 172800 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age
FROM (SELECT event_id, greatest(0, event_id * event_id % 400000 - 10) AS s FROM events) x"""
)
def age_text(spark, d):
    return t(spark, d, "events").select("event_id", X.age(F.col("event_id") * F.col("event_id") % 400000 - 10).alias("age"))


@query(
    """SELECT source_id, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, source_id) AS place FROM
(SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS source_id, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority FROM events) x"""
)
def status_order(spark, d):
    return outcomes.by_priority(change_log(spark, d).select("source_id", "priority").distinct()).select("source_id", "place")


# --- scalar functions ---------------------------------------------------------------------------------------------------

_FLAT = r"trim(regexp_replace(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Co}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"


@query(rf"""SELECT doc_id, '"' || replace(replace(CASE WHEN length(f) > 120 THEN substr(f, 1, 119) || '…' ELSE f END, '\', '\\'), '"', '\"') || '"' AS quoted FROM (SELECT doc_id, {_FLAT} AS f FROM documents) x""")
def quoted_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.quoted(F.col("text"), 120).alias("quoted"))


@query("SELECT doc_id, (length(text) * 2 + 6) // 7 AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, 'tide://rec/parts/' || replace(replace(url_encode(p_name || '|' || p_brand), '%2F', '/'), '%7C', '|') AS handle FROM part")
def record_handles(spark, d):
    return t(spark, d, "part").select("p_partkey", X.record_handle(F.lit("parts"), F.concat("p_name", F.lit("|"), "p_brand")).alias("handle"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%MZ') AS minute FROM events")
def iso_minute(spark, d):
    return t(spark, d, "events").select("event_id", X.iso(F.col("ts")).alias("iso"), X.minute(F.col("ts")).alias("minute"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT user_id, 'tide://batch/' || CAST(min(event_id) AS VARCHAR) || '-' || CAST(max(event_id) AS VARCHAR) || '?source=u' || CAST(user_id AS VARCHAR) AS handle FROM events GROUP BY user_id")
def batch_handles(spark, d):
    x = t(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return x.select("user_id", X.batch_handle(F.col("lo"), F.col("hi"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("handle"))


@query("SELECT conv_id, turn, role, CASE WHEN contains(lower(text), 'the') THEN true ELSE false END AS hit FROM conversations")
def contains_folded(spark, d):
    hit = score.matches(Rule("text", "contains", "The"), F.lit("added"), F.array(), F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", hit.alias("hit"))


@query(
    """SELECT CAST(page_id % 16 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.html' AS key, CAST(strlen(html) AS BIGINT) AS size, CASE WHEN strlen(html) <= 65536 THEN sha256(html) END AS text_hash,
CASE WHEN strlen(html) > 65536 THEN sha256(html) END AS hash FROM pages"""
)
def tree_files(spark, d):
    """Pages written as a tree of files, one a row, and collected from it: listed by tasks, read by tasks."""
    root = folder(spark, "tree")
    files = t(spark, d, "pages").select(F.concat((F.col("page_id") % 16).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("key"), F.col("html").cast("binary").alias("content"))
    tree.registered(spark)
    files.write.format(tree.NAME).mode("append").save(root)
    got = collector("dir", path=root).collect(spark, datetime(2024, 2, 1)).records
    value = lambda k: F.try_element_at("fields", F.lit(k))["v"]
    return got.select("key", value("size").cast("long").alias("size"), F.sha2(value("text"), 256).alias("text_hash"), value("sha256").alias("hash"))


# --- benchmark analytics ----------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT user_id, event_type AS field, value, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT u.user_id, arg_max(c.value, event_id) FILTER (field = 'click') AS click, arg_max(c.value, event_id) FILTER (field = 'purchase') AS purchase
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY 1"""
)
def state_as_of(spark, d):
    e = t(spark, d, "events")
    changes = e.where("event_type in ('click', 'purchase')").select("user_id", F.col("event_type").alias("field"), "value", F.col("ts").cast("timestamp_ntz").alias("t"), F.col("event_id").alias("ord"))
    initial = e.select("user_id").distinct().select("user_id", F.lit(None).cast("double").alias("click"), F.lit(None).cast("double").alias("purchase"))
    return worlds.state_as_of(initial, changes, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), ["user_id"])


@query(_CTE + "SELECT key AS k, s1 = 'X' AND s0 <> 'X' AS cancelled, e1 - e0 AS slip_days FROM met WHERE in_old AND in_new AND ((s1 = 'X' AND s0 <> 'X') OR e1 - e0 > 3)")
def po_rule(spark, d):
    return worlds.slipped_or_cancelled(*snapshots(spark, d), "k", "status", "eta", "X")


@query(_CTE + "SELECT key AS k, s1 AS status FROM met WHERE in_old AND in_new AND s1 IN ('X', 'P') AND s1 <> s0")
def portal_rule(spark, d):
    return worlds.became(*snapshots(spark, d), "k", "status", ["X", "P"])


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup') AND value > 20 AND ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def mail_rule(spark, d):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    x = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return worlds.needs_answer(x, at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"), F.col("event_type").isin("purchase", "signup"), F.col("value") > 20, "ts").select("event_id")


@query(
    """WITH k AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), r AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars < 2000),
n AS (SELECT count(*) FILTER (k.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS tp, count(*) FILTER (k.doc_id IS NULL) AS fp, count(*) FILTER (r.doc_id IS NULL) AS fn FROM k FULL OUTER JOIN r ON k.doc_id = r.doc_id)
SELECT tp, fp, fn, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision FROM n"""
)
def grade_sets(spark, d):
    return worlds.grade(t(spark, d, "labels").where("toxic = 1"), t(spark, d, "documents").where("n_chars < 2000"), ["doc_id"])


@query("SELECT event_type, avg(user_id) AS mean, median(user_id) AS median, min(user_id) AS least, max(user_id) AS most FROM events GROUP BY 1")
def run_stats(spark, d):
    return worlds.run_stats(t(spark, d, "events"), ["event_type"], "user_id")


@query("SELECT event_type, CAST(sum(m) AS BIGINT) AS user_id FROM (SELECT event_type, ts::DATE AS day, max(user_id) AS m FROM events GROUP BY 1, 2) x GROUP BY 1")
def usage_totals(spark, d):
    return worlds.max_then_sum(t(spark, d, "events").withColumn("day", F.col("ts").cast("date")), "day", ["event_type"], "user_id")


@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) x")
def common_misses(spark, d):
    x = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return worlds.misses(x, "event_type")


@query(r"SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS ref FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT unnest(regexp_extract_all(props, '\d+')) FROM events)")
def observability(spark, d):
    refs = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ref"))
    return worlds.observed(refs, t(spark, d, "events").select(F.col("props").alias("text")))


@query(
    r"""WITH said AS (SELECT DISTINCT unnest(regexp_extract_all(props, '\d+')) AS ref FROM events),
items AS (SELECT CASE event_id % 3 WHEN 0 THEN 'portal' WHEN 1 THEN 'po' ELSE 'email' END AS kind, CAST(event_id AS VARCHAR) AS ref, event_id FROM events UNION ALL SELECT 'system', unnest(['portal-layout', 'portal-login']), NULL)
SELECT kind, ref, seen AS observed, CASE WHEN seen THEN '' WHEN kind = 'portal' AND event_id >= 200 THEN 'after login expiry' WHEN kind = 'portal' AND event_id >= 50 THEN 'after layout change' ELSE 'other' END AS reason
FROM (SELECT *, CASE kind WHEN 'system' THEN ref = 'portal-layout' ELSE ref IN (SELECT ref FROM said) END AS seen FROM items) x"""
)
def observability_reasons(spark, d):
    """Which items the texts show, and why not the others; a layout changed at event 50 and a login ran out at event 200."""
    e = t(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "portal").when(F.col("event_id") % 3 == 1, "po").otherwise("email")
    items = e.select(kind.alias("kind"), F.col("event_id").cast("string").alias("ref"), F.col("event_id").alias("at"))
    system = e.select(F.explode(F.array(F.lit("portal-layout"), F.lit("portal-login"))).alias("ref")).distinct().select(F.lit("system").alias("kind"), "ref", F.lit(None).cast("long").alias("at"))
    return worlds.observability(items.unionByName(system), e.select(F.concat("event_type", F.lit(" "), "props").alias("text")), 50, 200, {"portal-layout": "signup {", "portal-login": "no such sign"})


@query(
    _CTE
    + """SELECT 'po' AS kind, CAST(key AS VARCHAR) AS ref FROM met WHERE in_old AND in_new AND ((s1 = 'X' AND s0 <> 'X') OR e1 - e0 > 3)
UNION ALL SELECT 'portal', CAST(key AS VARCHAR) FROM met WHERE in_old AND in_new AND s1 IN ('X', 'P') AND s1 <> s0
UNION ALL SELECT 'mail', CAST(event_id AS VARCHAR) FROM events WHERE event_type IN ('purchase', 'signup') AND value > 20 AND ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'system', unnest(['LAYOUT', 'LOGIN']) FROM (SELECT count(*) AS n FROM events) x WHERE n > 500"""
)
def answer_key(spark, d):
    return worlds.answer_key(po=po_rule(spark, d), portal=portal_rule(spark, d), mail=mail_rule(spark, d), system=system_rule(spark, d))


_FLAGS = """WITH mails AS (SELECT event_id, user_id, ts AS received FROM events WHERE event_type = 'view'),
flagged AS (SELECT user_id, ts AS t, event_type AS add_flag FROM events WHERE event_type IN ('click', 'purchase', 'signup'))
"""


@query(
    _FLAGS
    + """SELECT event_id, coalesce((SELECT string_agg(DISTINCT f.add_flag, ',' ORDER BY f.add_flag) FROM (SELECT user_id, t, add_flag FROM flagged UNION ALL SELECT m.user_id, m.received, 'seen') f
  WHERE f.user_id = m.user_id AND f.t <= TIMESTAMP '2024-01-08 00:00:00'), '') AS flags FROM mails m WHERE received <= TIMESTAMP '2024-01-08 00:00:00'"""
)
def flags_as_of(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    mails = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("received"), F.array(F.lit("seen")).alias("flags"))
    added = e.where("event_type in ('click', 'purchase', 'signup')").select("user_id", F.col("ts").alias("t"), F.col("event_type").alias("add"))
    got = worlds.flags_as_of(mails, added, F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00")), ["user_id"], "received")
    return got.select("event_id", F.array_join("flags", ",").alias("flags"))


@query(
    """WITH s AS (SELECT ts AS t, CASE WHEN event_id < 300 THEN 'v1' ELSE 'v2' END AS layout, event_id >= 400 AS login_expired FROM events),
a AS (SELECT arg_max(layout, t) FILTER (t <= (SELECT ts FROM events WHERE event_id = 100)) AS l0, arg_max(layout, t) FILTER (t <= (SELECT ts FROM events WHERE event_id = 500)) AS l1,
  arg_max(login_expired, t) FILTER (t <= (SELECT ts FROM events WHERE event_id = 100)) AS e0, arg_max(login_expired, t) FILTER (t <= (SELECT ts FROM events WHERE event_id = 500)) AS e1 FROM s)
SELECT 'LAYOUT' AS ref FROM a WHERE l1 <> 'v1' AND l0 = 'v1' UNION ALL SELECT 'LOGIN' FROM a WHERE e1 AND NOT e0"""
)
def system_rule(spark, d):
    e = t(spark, d, "events")
    looks = {r.event_id: r.ts for r in e.where("event_id in (100, 500)").select("event_id", "ts").collect()}
    states = e.select(F.col("ts").alias("t"), F.when(F.col("event_id") < 300, "v1").otherwise("v2").alias("layout"), (F.col("event_id") >= 400).alias("login_expired"))
    return worlds.system_rule(states, F.lit(looks[100]), F.lit(looks[500]), "v1")


@query(
    """WITH k AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1), r AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars < 2000),
m AS (SELECT k.*, r.doc_id IS NOT NULL AS hit FROM k LEFT JOIN r USING (doc_id))
SELECT avg(CAST(hit AS INT)) AS recall, avg(CASE WHEN good THEN CAST(hit AS INT) END) AS recall_good, avg(CASE WHEN toxic THEN CAST(hit AS INT) END) AS recall_toxic FROM m"""
)
def recalls(spark, d):
    key = t(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return worlds.recalls(key, t(spark, d, "documents").where("n_chars < 2000"), ["doc_id"], ["good", "toxic"])


@query("SELECT user_id, event_type, count(*) AS calls, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def tool_counts(spark, d):
    return worlds.tool_counts(t(spark, d, "events"), ["user_id"], "event_type")


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(floor((event_id % 8) / 8.0 * 100 + 0.5) AS BIGINT) || '%' END AS share,
format('{:,}', event_id * 1234) AS n, '$' || format('{:,.3f}', event_id / 8.0) AS cost FROM events"""
)
def report_formats(spark, d):
    share = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 8 / 8.0)
    return t(spark, d, "events").select("event_id", X.percent(share).alias("share"), X.thousands(F.col("event_id") * 1234).alias("n"), X.money(F.col("event_id") / 8.0).alias("cost"))


@query("SELECT event_id, CAST(value * x AS VARCHAR) AS text FROM events, (SELECT unnest([1.0::DOUBLE, 1e6, 1e15, 1e-5, 1e-8]) AS x) s WHERE value IS NOT NULL")
def float_texts(spark, d):
    """Floats as rules compare them: shortest digits, 10000000.0 rather than 1.0E7."""
    x = F.explode(F.array(*(F.lit(v) for v in (1.0, 1e6, 1e15, 1e-5, 1e-8)))).alias("x")
    return t(spark, d, "events").where("value is not null").select("event_id", "value", x).select("event_id", X.python_text(F.col("value").cast("double") * F.col("x"), "double").alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]+', ' ', 'g'), ' ') AS line FROM documents")
def log_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", X.log_line(F.col("text")).alias("line"))


@query(
    """SELECT strftime(tick, '%Y-%m-%dT%H:%M:%SZ') AS tick FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-03 10:00:00', INTERVAL 2 HOUR)) AS tick
UNION SELECT unnest([TIMESTAMP '2024-01-02 09:00:00', TIMESTAMP '2024-01-02 22:00:00'])) x"""
)
def ticks(spark, d):
    day = lambda n, h: datetime(2024, 1, n, h)
    return worlds.ticks(spark, day(1, 0), day(3, 10), 2, [day(2, 9), day(2, 22)]).select(X.iso(F.col("t")).alias("tick"))


@query(
    """SELECT event_id, CASE WHEN n > 0 AND s * n >= 10 THEN CAST(s * n AS BIGINT) END AS seconds FROM (SELECT event_id, event_id % 40 AS n,
CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS s FROM events) x"""
)
def schedule_seconds(spark, d):
    unit = F.element_at(F.array(*map(F.lit, "smhd")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("every "), (F.col("event_id") % 40).cast("string"), unit)
    return t(spark, d, "events").select("event_id", X.schedule_seconds(text).alias("seconds"))


_MAPS = _CTE + "SELECT CAST(key AS VARCHAR) AS key, kind, CAST(CASE WHEN kind = 'modified' THEN CASE WHEN s0 <> s1 THEN 1 ELSE 0 END + CASE WHEN e0 <> e1 THEN 1 ELSE 0 END END AS BIGINT) AS changes FROM diff"


def hashed_snapshots(spark, d) -> list[DataFrame]:
    return [as_records(x, F.col("k"), [c for c in x.columns if c != "k"]).withColumn("content_hash", F.sha2(F.to_json("fields"), 256)) for x in snapshots(spark, d)]


@query(_MAPS)
def diff_bucketed(spark, d):
    """The diff of stored records and a collection that lie in buckets by key, so that neither is shuffled to meet the other."""
    n, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    with buckets.tables(spark):
        for x, shape in zip(hashed_snapshots(spark, d), (RECORDS, HASHED)):
            x = x.withColumns({"source_id": F.lit("orders"), "present": F.lit(True), "updated_at": F.lit(datetime(2024, 1, 1))}).select(*shape.fieldNames())
            path = folder(spark, "buckets")
            buckets.write(x.to(shape).repartition(n, "key"), path, "key", n)
            parts.append(buckets.read(spark, path, shape, "key", n))
        met = snapshot.meet(*parts)
        both = F.col("old").isNotNull() & F.col("new").isNotNull()
        met = met.withColumn("changes", F.when(both, snapshot.changes_of(F.col("old"), F.col("new.fields"), ["status", "eta"])))
        out = met.select("key", snapshot.kind_of(F.col("old"), F.col("new"), F.col("changes")).alias("kind"), F.when(both, F.size("changes").cast("long")).alias("changes"))
        return settled(out.where("kind is not null"), "met")


@query(_MAPS)
def diff_kinds_maps(spark, d):
    """The dynamic path: fields as maps of tagged scalars, equal hashes skipped."""
    x = snapshot.diff_maps(*hashed_snapshots(spark, d), ["status", "eta"])
    return x.select("key", "kind", F.when(F.col("kind") == "modified", F.size("changes").cast("long")).alias("changes"))


@query(
    _RUNS
    + """SELECT source_id, run, 'source_error' AS kind FROM w WHERE failed AND NOT before UNION ALL SELECT source_id, run, 'source_recovered' FROM w WHERE NOT failed AND before
UNION ALL SELECT source_id, min(run), 'baseline' FROM runs WHERE NOT failed GROUP BY source_id"""
)
def stream_state_machine(spark, d):
    """The streamed machine over plain runs in four ticks."""
    x = runs(spark, d)
    x = x.select("source_id", "run", F.when(F.col("failed"), "fail").otherwise("ok").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.lit("m").alias("message"))
    x = x.withColumns({"hint": F.lit(None).cast("string"), "selectors": F.lit(None).cast("array<string>"), "fingerprint": F.lit(None).cast("string"), "record_count": F.lit(0).cast("long"), "schedule": F.lit(None).cast("long")})
    return in_ticks(spark, x).select("source_id", "run", "kind")


def in_ticks(spark, runs: DataFrame, ticks: int = 4, lateness: timedelta = LATENESS) -> DataFrame:
    """What the streamed machine announces about runs that come in tick files, one batch a tick."""
    root = folder(spark, "ticks")
    last = runs.agg(F.max("run")).first()[0] or 0
    for k in range(ticks):  # files are taken in order of their time; within a tick a source is in one file
        tick = runs.where(F.floor(F.col("run") * ticks / F.lit(last + 1)) == k)
        tick.repartition(2, "source_id").write.mode("append").parquet(f"{root}/ticks")
    replay(spark, f"{root}/ticks", f"{root}/state", f"{root}/out", 2, lateness)
    return spark.read.schema(ANNOUNCED).parquet(f"{root}/out")


_MACHINE = """WITH RECURSIVE runs AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run) AS n FROM (
    SELECT 'u' || CAST(user_id AS VARCHAR) AS source_id, event_id AS run, date_trunc('second', CASE WHEN event_id % 10 = 0 THEN ts - INTERVAL 6 HOUR ELSE ts END) AS tried_at,
      CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'login' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' THEN 'broken' ELSE 'ok' END AS kind,
      CASE event_type WHEN 'error' THEN 'm' || CAST(event_id % 3 AS VARCHAR) WHEN 'signup' THEN 'b' || CAST(event_id % 2 AS VARCHAR) END AS message,
      CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'sign in' END AS hint,
      CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 2 THEN 'c' ELSE 'a,b' END END AS selectors,
      CASE WHEN event_type IN ('click', 'purchase') THEN 'f' || CAST(event_id // 2000 AS VARCHAR) END AS layout, CAST(21600 + 3600 * (user_id % 5) AS BIGINT) AS schedule FROM events)),
walk AS (
  SELECT source_id, CAST(0 AS BIGINT) AS n, false AS counted, false AS baselined, false AS in_error, CAST(NULL AS VARCHAR) AS announced, '' AS broken, CAST(NULL AS VARCHAR) AS layout,
    CAST(NULL AS VARCHAR) AS error, CAST(NULL AS TIMESTAMP) AS tried_at, CAST(NULL AS BIGINT) AS run, CAST(NULL AS BIGINT) AS schedule, CAST([] AS STRUCT(kind VARCHAR, text VARCHAR)[]) AS told FROM (SELECT DISTINCT source_id FROM runs)
  UNION ALL
  SELECT source_id, n, counted, counted AND ok OR baselined, CASE WHEN counted THEN NOT ok ELSE in_error END,
    CASE WHEN NOT counted THEN announced WHEN ok THEN NULL WHEN tells THEN message ELSE announced END,
    CASE WHEN NOT counted THEN broken WHEN ok THEN '' WHEN tells AND kind = 'broken' AND baselined THEN selectors ELSE broken END,
    CASE WHEN counted AND ok THEN coalesce(new_layout, layout) ELSE layout END, CASE WHEN counted AND NOT ok THEN message ELSE error END,
    CASE WHEN counted THEN new_tried ELSE tried_at END, CASE WHEN counted THEN new_run ELSE run END, CASE WHEN counted THEN new_schedule ELSE schedule END,
    CASE WHEN NOT counted THEN []
      WHEN ok THEN list_concat(CASE WHEN in_error THEN [{'kind': 'source_recovered', 'text': coalesce(error, '')}] ELSE [] END,
        CASE WHEN NOT baselined THEN [{'kind': 'baseline', 'text': CAST(new_run AS VARCHAR)}] WHEN new_layout <> layout THEN [{'kind': 'schema_changed', 'text': ''}] ELSE [] END)
      WHEN NOT tells THEN [] WHEN kind = 'broken' AND baselined THEN [{'kind': 'schema_changed', 'text': selectors}] ELSE [{'kind': 'source_error', 'text': message || coalesce('; ' || hint, '')}] END
  FROM (SELECT w.source_id, r.n, w.tried_at IS NULL OR r.tried_at >= w.tried_at AS counted, r.kind = 'ok' AS ok, w.baselined, w.in_error, w.announced, w.broken, w.layout, w.error, w.tried_at, w.run, w.schedule,
      r.kind, r.message, r.hint, r.selectors, r.layout AS new_layout, r.tried_at AS new_tried, r.run AS new_run, r.schedule AS new_schedule,
      CASE WHEN r.kind = 'broken' AND w.baselined THEN NOT (r.selectors = w.broken AND r.message IS NOT DISTINCT FROM w.announced)
        ELSE NOT w.in_error OR r.kind = 'login' AND r.message IS DISTINCT FROM w.announced END AS tells
    FROM walk w JOIN runs r ON r.source_id = w.source_id AND r.n = w.n + 1) x),
steps AS (SELECT source_id, run, unnest(told) AS told, generate_subscripts(told, 1) - 1 AS step FROM walk WHERE counted),
tried AS (SELECT source_id, run, tried_at + to_seconds(schedule) AS due, lead(tried_at) OVER (PARTITION BY source_id ORDER BY n) AS later FROM walk WHERE counted)
SELECT source_id, run, CAST(step AS INT) AS step, told.kind AS kind, told.text AS text FROM steps
UNION ALL SELECT source_id, run, -1, 'due', strftime(due, '%Y-%m-%dT%H:%M:%SZ') FROM tried
WHERE coalesce(later >= due, due <= (SELECT max(CASE WHEN event_id % 10 = 0 THEN ts - INTERVAL 6 HOUR ELSE ts END) FROM events) - INTERVAL 1 DAY)"""


@query(_MACHINE)
def stream_outcomes(spark, d):
    """Logins, failures, broken selectors, changed layouts, late runs and due sources, of runs that come in four ticks."""
    e, kind, run = t(spark, d, "events"), F.col("event_type"), F.col("event_id")
    failed, broke = kind == "error", kind == "signup"
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    x = e.select(
        text("u", F.col("user_id")).alias("source_id"),
        run.alias("run"),
        F.when(failed & (run % 2 == 0), "login").when(failed, "fail").when(broke, "broken").otherwise("ok").alias("kind"),
        F.when(run % 10 == 0, F.col("ts") - F.expr("INTERVAL 6 HOUR")).otherwise(F.col("ts")).cast("timestamp").alias("at"),
        F.when(failed, text("m", run % 3)).when(broke, text("b", run % 2)).alias("message"),
        F.when(failed & (run % 2 == 0), "sign in").alias("hint"),
        F.when(broke, F.when(run % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(run % 3 == 1, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("c")))).alias("selectors"),
        F.when(kind.isin("click", "purchase"), text("f", F.floor(run / 2000))).alias("fingerprint"),
        run.cast("long").alias("record_count"),
        (21600 + 3600 * (F.col("user_id") % 5)).cast("long").alias("schedule"),
    )
    return in_ticks(spark, x, lateness=timedelta(days=1))


_TICKS = ["1994-01-01", "1995-07-01", "1996-02-01", "1997-01-01"]
_REPLAY = f"""WITH base AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS made, o_orderstatus AS status, o_totalprice AS price FROM orders),
versions AS (SELECT source_id, k, status, made AS since, CASE WHEN k % 3 = 0 THEN made + 300 WHEN k % 5 = 0 THEN made + 400 END AS until FROM base
  UNION ALL SELECT source_id, k, 'X', made + 300, CASE WHEN k % 5 = 0 THEN made + 700 END FROM base WHERE k % 3 = 0),
ticks AS (SELECT unnest([{", ".join(f"DATE '{x}'" for x in _TICKS)}]) AS tick, unnest(range({len(_TICKS)})) AS i),
seen AS (SELECT i, tick, source_id, CAST(k AS VARCHAR) AS key, status FROM ticks, versions WHERE since <= tick AND (until IS NULL OR until > tick)),
sources AS (SELECT DISTINCT source_id FROM base),
events AS (
  SELECT i, tick, source_id, 'baseline' AS kind, NULL AS key FROM ticks, sources WHERE i = 0
  UNION ALL SELECT t.i, t.tick, coalesce(n.source_id, o.source_id), CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END, coalesce(n.key, o.key)
  FROM (SELECT * FROM seen WHERE i > 0) n FULL JOIN (SELECT * REPLACE (i + 1 AS i) FROM seen WHERE i < {len(_TICKS) - 1}) o ON n.i = o.i AND n.key = o.key JOIN ticks t ON t.i = coalesce(n.i, o.i)
  WHERE o.key IS NULL OR n.key IS NULL OR n.status <> o.status),
log AS (SELECT row_number() OVER (ORDER BY i, source_id, key NULLS FIRST) AS seq, * FROM events)
SELECT seq, source_id, kind, key, strftime(tick, '%Y-%m-%dT00:00:00Z') AS at, seq <= (SELECT max(seq) FROM log WHERE i <= 2) AS acknowledged FROM log"""


@query(_REPLAY)
def replayed_collections(spark, d):
    """Orders as dated versions, collected from two sources over four ticks that come as a stream in two goes; a consumer's last look is the third tick."""
    o, name = t(spark, d, "orders"), f"versions_{uuid.uuid4().hex}"
    day = lambda c, n=0: F.date_add(F.col(c).cast("date"), n).cast("timestamp")
    k, first = F.col("o_orderkey"), day("o_orderdate")
    third, fifth = k % 3 == 0, k % 5 == 0
    base = o.select(k.alias("k"), F.col("o_orderstatus").alias("status"), first.alias("since"), F.when(third, day("o_orderdate", 300)).when(fifth, day("o_orderdate", 400)).alias("until"))
    later = o.where(third).select(k.alias("k"), F.lit("X").alias("status"), day("o_orderdate", 300).alias("since"), F.when(fifth, day("o_orderdate", 700)).alias("until"))
    sources = []
    for n, part in enumerate(("even", "odd")):
        base.unionByName(later).where(F.col("k") % 2 == n).createOrReplaceTempView(f"{name}_{part}")
        config = SourceConfig(part, "versions")
        sources.append((config, collector("versions", view=f"{name}_{part}", key="k", since="since", until="until")))
    root, store = folder(spark, "ticks"), Store(spark, folder(spark, "replayed"))
    replay_of = Replay(store, sources, "bench")
    for go in (_TICKS[:2], _TICKS[2:]):
        rows = [(datetime.fromisoformat(x), x == _TICKS[2]) for x in go]
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{root}/ticks")
        replay_of.start(spark.readStream.schema(TICKS).parquet(f"{root}/ticks"), f"{root}/state").awaitTermination()
    for part in ("even", "odd"):
        spark.catalog.dropTempView(f"{name}_{part}")
    cursor = store.manifest().cursors["bench"]["seq"]
    return store.read("events").select("seq", "source_id", "kind", F.col("record_key").alias("key"), X.iso(F.col("created_at")).alias("at"), (F.col("seq") <= cursor).alias("acknowledged"))


@query(
    """SELECT conv_id, turn, CASE conv_id % 5 WHEN 3 THEN '?' ELSE lower(role) END AS kind, CASE conv_id % 5 WHEN 3 THEN '{"kind":7}' ELSE CAST(conv_id AS VARCHAR) END AS ref FROM conversations WHERE conv_id % 5 < 4"""
)
def answers_read(spark, d):
    """Items of answers that are made of turns: fenced, bare with the turn's whole text before and within, unreadable, and cut off."""
    body = F.to_json(F.struct(F.col("text").alias("note"), F.array(F.struct(F.upper("role").alias("kind"), F.col("conv_id").cast("string").alias("ref"))).alias("items")))
    way = F.col("conv_id") % 5
    said = F.when(way == 0, F.concat(F.lit("Found:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.upper("role").alias("kind"), F.col("conv_id").alias("ref"))).alias("items"))), F.lit("\n```")))
    said = said.when(way == 1, F.concat(F.lit("So {this} is it: "), body, F.lit(" {}"))).when(way == 2, F.concat(F.lit('{"items": []} and '), body))
    said = said.when(way == 3, F.lit('```\n[{"kind": 7}]\n```')).otherwise(F.substring(body, 1, 20))
    texts = t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), said.alias("said"))
    return transcripts.answers(texts, "id", "said").select("id.conv_id", "id.turn", "kind", "ref")


@query(
    """WITH m AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
u AS (SELECT conv_id, sum(n) AS output_tokens, sum(turn + 1) AS input_tokens, count(*) AS api_calls FROM m WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, CASE conv_id % 4 WHEN 0 THEN 'no_result' WHEN 1 THEN 'error_max_turns' ELSE 'ok' END AS status, CAST(CASE WHEN conv_id % 4 = 2 THEN 1000 ELSE coalesce(u.input_tokens, 0) END AS BIGINT) AS input_tokens,
CAST(CASE WHEN conv_id % 4 = 2 THEN 10 ELSE coalesce(u.output_tokens, 0) END AS BIGINT) AS output_tokens, coalesce(u.api_calls, 0) AS api_calls, coalesce(u.api_calls, 0) AS tool_calls, c.bad_lines
FROM (SELECT conv_id, count(*) FILTER (role NOT IN ('assistant', 'user')) AS bad_lines FROM m GROUP BY 1) c LEFT JOIN u USING (conv_id)"""
)
def transcript_metrics(spark, d):
    """Metrics of transcripts that are made of conversations: each assistant's turn is two events of one message, some runs end with a result."""
    c = t(spark, d, "conversations")
    usage = lambda n: F.struct((F.col("turn") + 1).alias("input_tokens"), n.alias("output_tokens"))
    tool = F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.lit("get").alias("name")))
    event = lambda n, content: F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), usage(n).alias("usage"), content.alias("content")).alias("message")))
    lines = F.when(F.col("role") == "assistant", F.array(event(F.length("text"), tool), event(F.lit(0), F.col("text")))).when(F.col("role") == "user", F.array(F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))))
    lines = c.select("conv_id", F.explode(F.coalesce(lines, F.array(F.lit("no event")))).alias("line"))
    way = F.col("conv_id") % 4
    ends = F.when(way == 1, '{"type":"result","subtype":"error_max_turns","is_error":true}').when(way == 2, '{"type":"result","usage":{"input_tokens":1000,"output_tokens":10}}').when(way == 3, '{"type":"result","subtype":"success"}')
    ends = c.select("conv_id").distinct().select("conv_id", ends.alias("line")).where("line is not null")
    return transcripts.metrics(lines.unionByName(ends), ["conv_id"]).select("conv_id", "status", "input_tokens", "output_tokens", "api_calls", "tool_calls", "bad_lines")


# --- beyond SQL: opcode diffs and HTML; tests compute each of these queries again with plain code ---------------------------------------


@query()
def text_change_stats(spark, d):
    """Characters added and removed between each document and the next of its language and source.

    Neighbours are found among ids alone; texts are joined to them, so that a large language and source is dealt over all tasks.
    """
    docs, tasks = t(spark, d, "documents"), 4 * spark.sparkContext.defaultParallelism
    pairs = log.following(docs.select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"]).where("next is not null").select("doc_id", F.col("next.doc_id").alias("next_id"))
    later = pairs.join(docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next")), "next_id").where("next is not null")
    x = docs.select("doc_id", "text").repartition(tasks, "doc_id").join(later.select("doc_id", "next").repartition(tasks, "doc_id"), "doc_id")
    return x.select("doc_id", text_change(F.col("text"), F.col("next")).alias("n")).select("doc_id", "n.added", "n.removed")


@query()
def page_fingerprint(spark, d):
    return html.fingerprints(t(spark, d, "pages"), ["page_id"], "nav ul li")


@query()
def page_links(spark, d):
    found = html.rows_of(t(spark, d, "pages"), ["page_id"], "nav ul > li", {"text": "a", "href": "a[href]@href"})
    rows = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", F.col("fields")["text"].alias("text"), F.col("fields")["href"].alias("href")))).alias("rows"))  # of one page
    return rows.select("page_id", F.posexplode("rows").alias("row", "r")).select("page_id", "row", "r.text", "r.href")


@query()
def broken_selectors(spark, d):
    """What matches nothing in each page, of selectors that most pages satisfy."""
    fields = {"text": "a", "href": "a[href]@href", "strong": "strong"}
    return html.match_flags(t(spark, d, "pages"), ["page_id"], "nav ul > li", fields, "text", container="nav").select("page_id", "n_rows", F.array_join("broken", ", ").alias("broken"))


@query()
def structure_changed(spark, d):
    """Pages whose structure differs from the page before them on the same host."""
    x = t(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), "html")
    moved = log.following(html.fingerprints(x, ["page_id", "host"], "nav ul li"), ["host"], ["page_id"]).where(F.col("fingerprint") != F.col("next.fingerprint"))
    return moved.select("next.page_id", "next.host")
