"""Configuration: a YAML text to validated sources. Values of secrets are named by environment variable and never echoed."""

from __future__ import annotations

import re
from typing import NamedTuple

import yaml

from tidemark.plans.model import DEFAULT_BONUS, SOURCE_ID, Rule, SourceConfig
from tidemark.sources.base import known_types

_COMMON = {"id", "type", "schedule", "priority", "key_label", "track", "title", "highlight"}
_ENV = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# Options that would hold a secret itself.
_SECRETS = frozenset({"password", "passwd", "token", "secret", "api_key"})
#: Days that events are kept unless the configuration says otherwise.
RETENTION_DAYS = 30
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_schedule(text: str) -> int:
    m = re.fullmatch(r"every ([1-9][0-9]*)([smhd])", text if isinstance(text, str) else "")
    if not m or (seconds := int(m[1]) * _UNITS[m[2]]) < 10:
        raise ValueError('schedule must be like "every 15m" and at least 10 seconds')
    return seconds


def _rule(raw: dict) -> Rule:
    ops = [k for k in ("equals", "contains", "changed_to") if k in raw]
    if set(raw) - {"field", "bonus", *ops} or len(ops) != 1 or "field" not in raw:
        raise ValueError("a highlight has a field, one of equals, contains and changed_to, and perhaps a bonus")
    bonus = raw.get("bonus", DEFAULT_BONUS)
    if not isinstance(raw[ops[0]], (str, int, float, bool)) or isinstance(bonus, bool) or not isinstance(bonus, int):
        raise ValueError("a highlight's value must be a scalar and its bonus an integer")
    return Rule(raw["field"], ops[0], str(raw[ops[0]]), bonus)


class Settings(NamedTuple):
    sources: list[SourceConfig]
    retention_days: int = RETENTION_DAYS


def _names_secrets(options: dict, where: str, sql: bool = False) -> None:
    for k, v in options.items():  # messages never show v
        if not isinstance(k, str) or k.lower() in _SECRETS or (k == "url" and sql):
            raise ValueError(f"{where}: name secrets by an option that ends in _env")
        if k.lower().endswith("_env") and not (isinstance(v, str) and _ENV.fullmatch(v)):
            raise ValueError(f"{where}: option {k} must be the name of an environment variable")
        if isinstance(v, dict):
            _names_secrets(v, where)


def parse_config(text: str) -> list[SourceConfig]:
    return parse_settings(text).sources


def parse_settings(text: str) -> Settings:
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict) or set(raw) - {"sources", "retention_days"}:
        raise ValueError("the keys at the top are sources and retention_days")
    days = raw.get("retention_days", RETENTION_DAYS)
    if isinstance(days, bool) or not isinstance(days, int) or days < 1:
        raise ValueError("retention_days must be a whole number of days, at least 1")
    out, seen = [], set()
    for s in raw.get("sources") or []:
        name = s.get("id")
        if not isinstance(name, str) or not re.fullmatch(SOURCE_ID, name):
            raise ValueError("a source id has lower-case letters, digits, _ and - only")
        if name in seen:
            raise ValueError(f"source {name} occurs twice")
        seen.add(name)
        if s.get("type") not in known_types():
            raise ValueError(f"source {name}: unknown type")
        _names_secrets({k: v for k, v in s.items() if k != "fields"}, f"source {name}", s["type"] == "sql")
        out.append(
            SourceConfig(
                name,
                s["type"],
                parse_schedule(s.get("schedule", "every 15m")),
                s.get("priority", "normal"),
                s.get("key_label", ""),
                tuple(dict.fromkeys(s["track"])) if "track" in s else None,
                tuple(s.get("title", ()))[:3],
                tuple(_rule(r) for r in s.get("highlight", ())),
                {k: v for k, v in s.items() if k not in _COMMON},
            )
        )
    return Settings(out, days)
