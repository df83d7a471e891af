"""python -m tidemark.cli --store DIR [--config FILE] collect [ID] | daemon [--once] | digest | get | ack | status | prune"""

from __future__ import annotations

import argparse
import sys
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from tidemark.plans import runner
from tidemark.plans.daemon import Daemon, DaemonError
from tidemark.plans.service import DEFAULT_BUDGET, Service
from tidemark.plans.store import Store
from tidemark.sources.base import collector
from tidemark.sources.config import parse_settings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--store", required=True)
    p.add_argument("--config")
    p.add_argument("--agent", default="default")
    p.add_argument("--budget", type=int, default=DEFAULT_BUDGET)
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("collect").add_argument("source", nargs="?")
    sub.add_parser("daemon").add_argument("--once", action="store_true")
    sub.add_parser("digest").add_argument("source", nargs="?")
    sub.add_parser("get").add_argument("handle")
    sub.add_parser("ack").add_argument("cursor", type=int)
    sub.add_parser("status")
    sub.add_parser("prune").add_argument("days", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = lambda: datetime.now(timezone.utc)
    store = Store(spark, a.store)
    service = Service(store, now, "cli")
    if a.verb in ("collect", "daemon"):
        if not a.config:
            print(f"error: {a.verb} needs --config", file=sys.stderr)
            return 2
        with open(a.config, encoding="utf-8") as f:
            configs, retention_days = parse_settings(f.read())
        if a.verb == "daemon":
            try:
                return Daemon(store, [(c, collector(c.type, **c.options)) for c in configs], now, time.sleep, retention_days=retention_days).run(a.once)
            except DaemonError as e:
                print(f"error: {e}", file=sys.stderr)
                return 1
        if a.source and a.source not in {c.id for c in configs}:
            print(f"error: unknown source {a.source}", file=sys.stderr)
            return 2
        runner.register(store, configs)
        chosen = [(c, collector(c.type, **c.options)) for c in configs if a.source in (None, c.id)]
        results = runner.tick(store, chosen, now(), every=a.source is not None)
        for r in results:
            span = "superseded" if r.superseded else f"events {r.first_seq}-{r.last_seq}" if r.first_seq else "no changes"
            print(f"{r.source_id}: {r.failed or span}")
        return int(any(r.failed for r in results))
    if a.verb == "prune":
        print("dropped {} events, {} records".format(*runner.prune(store, now() - timedelta(days=a.days))))
        return 0
    text = {
        "digest": lambda: service.digest(a.agent, a.budget, a.source),
        "get": lambda: service.get(a.handle, a.agent, a.budget),
        "ack": lambda: service.ack(a.agent, a.cursor),
        "status": service.status,
    }[a.verb]()
    print(text)
    return int(text.startswith("error: "))


if __name__ == "__main__":
    sys.exit(main())
