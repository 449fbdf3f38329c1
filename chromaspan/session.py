"""Sessions for tests and benchmarks. On a cluster, use the session that the cluster gives."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC, Arrow and few shuffle partitions."""
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("chromaspan")
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
