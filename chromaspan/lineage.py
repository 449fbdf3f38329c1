"""Cutting a plan's lineage by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings under which tables in the same buckets are joined without a shuffle, whatever else the join's keys are.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false"}
#: Setting under which no table goes through the driver for the size of its files: Parquet makes these many times smaller than
#: the rows are in memory. Frames marked as small are broadcast.
MARKED = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
#: Setting under which a step whose generated method is too long for the JVM to compile runs in several shorter ones.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new temporary one on a local master, else an error: executors
    would not see a folder of the driver's machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chromaspan-"))
        folder = context.getCheckpointDir()
    return folder


@contextmanager
def under(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """What is written in this context is planned and run under the settings; afterwards the session is as it was."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def together(spark: SparkSession):
    return under(spark, TOGETHER | MARKED)


def cut(df: DataFrame, *more: DataFrame, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """The rows (with those of ``more``, one after the other), written to the shared folder as Parquet and read again. They are
    worked out once, and survive a lost executor.

    With ``buckets``, rows lie in as many buckets by the column ``by``. Cuts of such tables join, group and order them inside
    their buckets: if the keys name that column, only rows that come from elsewhere are shuffled, and only frames marked as
    small are broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if not buckets:
        for rows in (df, *more):
            rows.write.mode("append").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"cut_{uuid.uuid4().hex}"
    with together(spark):
        for rows in (df, *more):
            rows.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).mode("append").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table lies outside the warehouse, and the frame knows its buckets
    return out
