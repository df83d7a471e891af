"""Benchmark analytics: states as of a time, attention rules, grading and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def state_as_of(initial: DataFrame, changes: DataFrame, at, keys: Sequence[str], touch: str | None = None) -> DataFrame:
    """Rows of ``initial`` with the last change of each field up to ``at``, and rows that changes created.

    ``changes``: keys, field, value, t, ord. The last value is an aggregate by (t, ord), pivoted by the declared columns; no window.
    """
    fields = [c for c in initial.columns if c not in keys]
    last = changes.where(F.col("t") <= at).groupBy(*keys).agg(
        *(F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("t", "ord"))).alias(f"__{f}") for f in fields if f != touch),
        *([F.max("t").alias("__touched")] if touch else []),
    )
    met = initial.join(last, list(keys), "full_outer")
    pick = lambda f: F.greatest(F.col(f), F.col("__touched")) if f == touch else F.coalesce(F.col(f"__{f}"), F.col(f))
    return met.select(*keys, *(pick(f).alias(f) for f in fields))


def flags_as_of(mail: DataFrame, flags: DataFrame, at, keys: Sequence[str], received: str) -> DataFrame:
    """Mails received by ``at``, with ``flags`` (a sorted array): their own and those that (keys, t, add) events had added by then."""
    added = flags.where(F.col("t") <= at).groupBy(*keys).agg(F.collect_set("add").alias("__added"))
    met = mail.where(F.col(received) <= at).join(added, list(keys), "left")
    return met.withColumn("flags", F.array_sort(F.array_union("flags", F.coalesce("__added", F.array().cast("array<string>"))))).drop("__added")


def system_rule(states: DataFrame, last, now, first_layout: str) -> DataFrame:
    """LAYOUT if the newest state (t, layout, login_expired) by ``now`` is not the first layout and that of ``last`` was, LOGIN likewise for an expired login."""
    newest = lambda at, c: F.max_by(c, F.when(F.col("t") <= at, F.col("t")))
    both = states.where((F.col("t") <= last) | (F.col("t") <= now)).agg(
        newest(last, F.col("layout")).alias("l0"), newest(now, F.col("layout")).alias("l1"), newest(last, F.col("login_expired")).alias("e0"), newest(now, F.col("login_expired")).alias("e1")
    )
    layout = F.when((F.col("l1") != first_layout) & (F.col("l0") == first_layout), "LAYOUT")
    login = F.when(F.col("e1") & ~F.col("e0"), "LOGIN")
    return both.select(F.explode(F.array_compact(F.array(layout, login))).alias("ref"))


def recalls(key: DataFrame, reported: DataFrame, on: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """recall over all items of ``key``, and recall_<mark> over those for which its boolean column ``mark`` holds; 1 over none."""
    met = key.join(reported.select(*on).distinct().withColumn("__hit", F.lit(True)), list(on), "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    share = lambda of: F.coalesce(F.avg(F.when(of, F.col("__hit").cast("double"))), F.lit(1.0))
    return met.agg(share(F.lit(True)).alias("recall"), *(share(F.col(m)).alias(f"recall_{m}") for m in marks))


def tool_counts(calls: DataFrame, by: Sequence[str], tool: str) -> DataFrame:
    """Calls of each run (by) and tool, and the run's total."""
    each = calls.groupBy(*by, tool).agg(F.count("*").alias("calls"))
    total = calls.groupBy(*by).agg(F.count("*").alias("total"))
    return each.join(total, list(by))


def misses(counts: DataFrame, name: str) -> DataFrame:
    """(name, n) with their place: the most frequent first, then by name. A row for each kind of miss."""
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), name)))


def answer_key(**rules: DataFrame) -> DataFrame:
    """The rules' references (their first columns) under their names: kind, ref."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("ref")) for kind, df in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def slipped_or_cancelled(before: DataFrame, now: DataFrame, key: str, status: str, eta: str, cancelled: str, days: int = 3) -> DataFrame:
    """Rows of both states that became cancelled or whose date moved later by more than ``days``."""
    b, n = before.alias("b"), now.alias("n")
    met = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"))
    cut = (F.col(f"n.{status}") == cancelled) & (F.col(f"b.{status}") != cancelled)
    slip = F.datediff(F.col(f"n.{eta}"), F.col(f"b.{eta}"))
    return met.where(cut | (slip > days)).select(F.col(f"n.{key}").alias(key), cut.alias("cancelled"), slip.alias("slip_days"))


def became(before: DataFrame, now: DataFrame, key: str, status: str, values: Sequence[str]) -> DataFrame:
    """Rows of both states whose status became one of ``values``."""
    b, n = before.alias("b"), now.alias("n")
    met = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"))
    new = F.col(f"n.{status}").isin(*values) & (F.col(f"n.{status}") != F.col(f"b.{status}"))
    return met.where(new).select(F.col(f"n.{key}").alias(key), F.col(f"n.{status}").alias(status))


def needs_answer(mail: DataFrame, last, now, business: Column, action: Column, received: str) -> DataFrame:
    return mail.where(business & action & (F.col(received) > last) & (F.col(received) <= now))


def grade(key: DataFrame, reported: DataFrame, on: Sequence[str]) -> DataFrame:
    """tp, fp, fn, recall (1 for an empty key) and precision (0 for no reports), over distinct items."""
    k, r = key.select(*on).distinct(), reported.select(*on).distinct()
    met = k.withColumn("in_key", F.lit(1)).join(r.withColumn("in_report", F.lit(1)), list(on), "full_outer")
    n = met.agg(
        F.count(F.when(F.col("in_key").isNotNull() & F.col("in_report").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("in_key").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("in_report").isNull(), 1)).alias("fn"),
    )
    return n.select(
        "tp",
        "fp",
        "fn",
        F.when(F.col("tp") + F.col("fn") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))).alias("recall"),
        F.when(F.col("tp") + F.col("fp") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"),
    )


def observed(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """References that occur in a text as whole numbers or as words joined by dashes. These are exploded once, so this is an equi-join."""
    numbers = texts.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(F.upper("text"), F.lit(r"[A-Z]+(?:-[A-Z]+)*"), F.lit(0)))).alias("ref")).distinct()
    return refs.join(numbers, "ref", "left_semi")


# References of the system's own items with the text that shows each, and why an item cannot be seen.
SYSTEM_SIGNS = {"portal-layout": "schema_changed", "portal-login": "login expired"}
REASONS = {"login": "after login expiry", "layout": "after layout change", "other": "other"}


def observability(items: DataFrame, texts: DataFrame, layout_at=None, login_at=None, signs: dict[str, str] = SYSTEM_SIGNS) -> DataFrame:
    """(kind, ref, observed, reason) of items (kind, ref, at): whether a text shows each, and why not where none does.

    A system item is shown by its sign in any text, others by their reference as a whole number or word. A portal's change at or after the login ran out, or else after
    the layout changed, could not be read; all else that is missed has another reason.
    """
    system = F.col("kind") == "system"
    shown = items.where(~system).select("ref").distinct()
    shown = observed(shown, texts).withColumn("__seen", F.lit(True))
    seen = texts.agg(*(F.max(F.contains("text", F.lit(sign))) for sign in signs.values())).first()  # a value for each sign
    signed = F.col("ref").isin([ref for ref, found in zip(signs, seen) if found])
    met = items.join(shown, "ref", "left")
    found = F.when(system, signed).otherwise(F.coalesce("__seen", F.lit(False)))
    after = lambda at: F.lit(False) if at is None else F.coalesce(F.col("at") >= at, F.lit(False))
    portal = F.col("kind") == "portal"
    reason = F.when(found, "").when(portal & after(login_at), REASONS["login"]).when(portal & after(layout_at), REASONS["layout"]).otherwise(REASONS["other"])
    return met.select("kind", "ref", found.alias("observed"), reason.alias("reason"))


def run_stats(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median, minimum and maximum, nulls left out."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def max_then_sum(usage: DataFrame, message: str, by: Sequence[str], value: str) -> DataFrame:
    """The greatest value of each message, summed: streamed usage repeats a message's count."""
    return usage.groupBy(*by, message).agg(F.max(value).alias("m")).groupBy(*by).agg(F.sum("m").alias(value))


def notes_csv(state: DataFrame, path: str, order: Sequence[str]) -> None:
    """A state as CSV with a header, in order."""
    state.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def ticks(spark, start, end, hours: int = 2, extra: Sequence = ()) -> DataFrame:
    """Times every ``hours`` from start to end, and the extra ones, each once."""
    every = F.sequence(F.lit(start), F.lit(end), F.make_dt_interval(hours=F.lit(hours)))
    more = F.array(*map(F.lit, extra)) if extra else F.slice(every, 1, 0)
    return spark.range(1).select(F.explode(F.array_sort(F.array_union(every, more))).alias("t"))
