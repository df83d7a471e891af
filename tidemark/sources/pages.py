"""A web page's rows as records, extracted from HTML by selectors of tags, classes, ids and attributes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.operators.snapshot import CollectError, LoginRequired
from tidemark.plans.scratch import settled
from tidemark.sources.base import Collected, Collector, tagged


class Page(Collector):
    """The newest snapshot of ``url`` in ``view`` (url, html): an element for each match of ``rows``, its ``fields`` by selector[@attribute], empty where nothing matches.

    Fetching needs a browser; whatever stores pages in the view does it. Selectors are broken if no row matches (or the ``container`` does not), if a field
    that is not ``optional`` matches in no row, or if no row has a key. A row without a key is no record. What is no selector fails the run.
    """

    options = {"view": str, "url": str, "rows": str, "fields": dict, "key": str, "container": str, "optional": list, "depth": int, "login_url": str, "login_selector": str}
    ranges = {"depth": (0, 32)}
    required = ("view", "url", "rows", "fields", "key")

    def __init__(self, **options):
        super().__init__(**options)
        if options["key"] not in options["fields"]:
            raise ValueError("key is not among the fields")

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        o = self.given
        for s in [o["rows"], *o["fields"].values(), *(o[k] for k in ("container", "login_selector") if k in o)]:
            try:
                html.parse_selector(s)
            except ValueError:
                raise CollectError(f"invalid selector in the configuration: {s[:120]!r}") from None
        page = settled(spark.table(o["view"]).where(F.col("url") == o["url"]).limit(1), "page")
        seen = page.select("url", *(["final_url"] if "final_url" in page.columns else [])).first()
        if seen is None:
            raise CollectError("the page could not be read")
        login = "login_selector" in o and not html.elements(page.select("html"), [o["login_selector"]]).where(html.matches(F.col("path"), o["login_selector"])).isEmpty()
        if login or "login_url" in o and "final_url" in page.columns and o["login_url"] in (seen["final_url"] or ""):
            raise LoginRequired("the page asks for a login", f"log in to {o['url']}")
        flags = html.match_flags(page, ["url"], o["rows"], o["fields"], o["key"], o.get("optional", []), o.get("container")).first()
        depth = o.get("depth", html.FINGERPRINT_DEPTH)
        fingerprint = html.fingerprints(page, ["url"], o["rows"], depth).first()["fingerprint"] if depth else None
        rows = html.rows_of(page, ["url"], o["rows"], o["fields"]).where(F.trim(F.col("fields")[o["key"]]) != "")
        fields = F.transform_values("fields", lambda _, v: tagged(F.coalesce(v, F.lit("")), "string"))
        return Collected(rows.select(F.col("fields")[o["key"]].alias("key"), fields.alias("fields")), fingerprint=fingerprint, broken=list(flags["broken"]))
