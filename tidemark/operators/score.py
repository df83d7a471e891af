"""Importance of events: weights and highlight rules as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import python_text
from tidemark.functions.udfs import folded_contains
from tidemark.plans.model import KIND_WEIGHTS, PRIORITY_WEIGHTS, RECORD_KINDS, Rule


def _weight(name: Column, weights: dict[str, int], what: str) -> Column:
    """An unknown name is an error, not a zero."""
    pick = reduce(lambda c, kv: c.when(name == kv[0], kv[1]), list(weights.items())[1:], F.when(name == list(weights)[0], list(weights.values())[0]))
    return pick.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(name, F.lit("null")))).cast("int"))


def kind_weight(kind: Column) -> Column:
    return _weight(kind, KIND_WEIGHTS, "kind")


def priority_weight(priority: Column) -> Column:
    return _weight(priority, PRIORITY_WEIGHTS, "priority")


def matches(rule: Rule, kind: Column, changes: Column, value: Column, dtype: str = "string") -> Column:
    """Whether a rule holds; ``value`` is the current value of its field (the last known one of a removed record).

    Null matches nothing. contains folds case: by lower() where both sides are ASCII, by full folding otherwise.
    """
    text = python_text(value, dtype)
    if rule.op == "equals":
        return F.coalesce(text == rule.value, F.lit(False))
    if rule.op == "contains":
        if rule.value.isascii():
            # only three letters fold into ASCII from outside it: their presence sends the text to the full folding
            odd = text.rlike("[ßſKﬀ-ﬆİŉǰẖ-ẚẞ]")
            return F.coalesce(F.when(odd, folded_contains(text, F.lit(rule.value))).otherwise(F.contains(F.lower(text), F.lit(rule.value.lower()))), F.lit(False))
        return F.coalesce(folded_contains(text, F.lit(rule.value)), F.lit(False))
    hit = F.exists(changes, lambda c: (c["field"] == rule.field) & F.coalesce(F.when(c["added_chars"].isNotNull(), text).otherwise(c["new"]) == rule.value, F.lit(False)))
    return (kind == "modified") & F.coalesce(hit, F.lit(False))


def importance(priority: Column, kind: Column, changes: Column, rules: Sequence[Rule] = (), value_of=None, dtypes: dict[str, str] | None = None) -> Column:
    """priority weight x kind weight, plus the bonus of every matching rule on record kinds; equal rules each count.

    ``value_of(field)`` gives the current value's column; rules on fields it does not know give null and never match.
    """
    base = priority_weight(priority) * kind_weight(kind)
    bonus = F.lit(0)
    for r in rules:
        value = value_of(r.field) if value_of else F.lit(None).cast("string")
        bonus = bonus + F.when(matches(r, kind, changes, value, (dtypes or {}).get(r.field, "string")), F.lit(r.bonus)).otherwise(F.lit(0))
    return base + F.when(kind.isin(*RECORD_KINDS), bonus).otherwise(F.lit(0))
