"""Session factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; a caller's own win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: object) -> SparkSession:
    """A session with DEFAULTS; ``conf`` takes underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("_", ".") if "." not in k else k: str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
