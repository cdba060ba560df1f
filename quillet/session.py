"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The store of streaming state: bounded memory, and what keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and Arrow; other settings are the cluster's own."""
    b = SparkSession.builder.appName("quillet")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.streaming.stateStore.providerClass": STORE}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
