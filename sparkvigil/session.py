"""Session settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sparkvigil", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()
