"""Drift of arriving captures against the batch form."""

import datetime

from pyspark.sql import functions as F

from chromaspan.operators import drift
from chromaspan.streaming import drift as stream

DAY = datetime.datetime(2026, 1, 1)
SCHEMA = f"site long, snapshot_id string, captured_at timestamp, tokens array<{stream.TOKEN}>"


def token(category, ord_, value, num=None, confidence="high"):
    return (category, ord_, None, value, num, 3, confidence)


def capture(site, day, colors, spaces=(8, 16)):
    return (site, f"s{site}-{day}", DAY + datetime.timedelta(days=day), [*(token("color", k, c) for k, c in enumerate(colors)), *(token("spacing", k, f"{x}px", float(x)) for k, x in enumerate(spaces))])


#: Five micro-batches; in the fourth a late and a repeated capture.
BATCHES = [
    [capture(1, 0, ["#102030", "#ff0000"]), capture(2, 0, ["#00ff00"])],
    [capture(1, 2, ["#102030", "#ee0000"]), capture(2, 1, ["#00ff00"], (8, 24)), capture(3, 1, [])],
    [capture(1, 4, ["#405060"]), capture(3, 3, ["#123456"])],
    [capture(1, 3, ["#ffffff"]), capture(2, 1, ["#00ff00"], (8, 24)), capture(2, 5, [], ())],
    [capture(1, 6, ["#405060", "#0000ff"], (4,)), capture(1, 7, ["#405060"]), capture(2, 6, ["#00ff00"])],
]


def batch_reports(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = drift.previous_pairs(df.select("site", "snapshot_id", F.col("captured_at").alias("capture")))
    tokens = df.select("snapshot_id", F.explode_outer("tokens").alias("t")).select("snapshot_id", "t.*").fillna("none", ["category"])
    return sorted(tuple(r) for r in drift.reports(drift.categories(drift.compared(pairs, tokens))).select("pair_id", "score", "status", "changed", "added", "removed").collect())


def run(spark, tmp_path, found):
    assert stream.start(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(240)


def record(spark, tmp_path, found):
    assert stream.record(found, str(tmp_path / "events"), str(tmp_path / "state")).awaitTermination(240)


def recorded(spark, tmp_path):
    return spark.readStream.schema(stream.EVENTS).parquet(str(tmp_path / "events"))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (0, 2, 3, 4):  # each a restart from the checkpoint; the second and third batch come in one run
            captures = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            record(spark, tmp_path, stream.events(captures))
        if k in (1, 4):
            run(spark, tmp_path, recorded(spark, tmp_path))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/reports")).select("pair_id", "score", "status", "changed", "added", "removed").collect())
    on_time = {r[1]: r for rows in BATCHES for r in rows if r[1] != "s1-3"}
    assert got == batch_reports(spark, list(on_time.values())) and len(got) == 8
    others = sorted((r["kind"], r["snapshot_id"]) for r in spark.read.parquet(str(tmp_path / "out/others")).collect())
    assert others == [("first", "s1-0"), ("first", "s2-0"), ("first", "s3-1"), ("late", "s1-3"), ("repeat", "s2-1")]
    assert spark.read.parquet(str(tmp_path / "out/changes")).where("category = 'color'").count() > 3


def test_silent_sites_are_told(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([capture(1, 0, ["#102030"])], [capture(2, 0, ["#102030"])]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        captures = spark.readStream.schema(SCHEMA).parquet(source)
        record(spark, tmp_path, stream.events(captures, silence_ms=1))
    told = {(r["kind"], r["site"]) for r in spark.read.parquet(str(tmp_path / "events")).collect()}
    assert ("silent", 1) in told and ("first", 2) in told


def test_stream_against_pinned_baselines(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [*BATCHES[1], capture(9, 0, ["#102030"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    pinned = spark.createDataFrame([(r[0], r[1], r[3]) for r in BATCHES[0]], f"site long, base_id string, tokens array<{stream.TOKEN}>")
    run(spark, tmp_path, stream.baseline_events(spark.readStream.schema(SCHEMA).parquet(source), pinned))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/reports")).select("pair_id", "score", "status", "changed", "added", "removed").collect())
    assert got == batch_reports(spark, [*BATCHES[0], *BATCHES[1][:2]]) and len(got) == 2
    assert {r["site"] for r in spark.read.parquet(str(tmp_path / "out/others")).collect()} == {3, 9}
