"""Drift of arriving captures: each is compared with the last one of its site, or with the site's pinned baseline.

captures: site, snapshot_id, captured_at, tokens (array of TOKEN), a row per capture; a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from chromaspan.operators import drift

TOKEN = "struct<category: string, ord: bigint, key: string, value: string, num: double, count: bigint, confidence: string>"
_STATE = "snapshot_id string, at long, tokens string, seen string"
_FOUND = "kind string, site long, snapshot_id string, at long, tokens string, base_id string, base_tokens string"
EVENTS = "kind string, site long, snapshot_id string, captured_at timestamp, tokens string, base_id string, base_tokens string"


def events(captures: DataFrame, silence_ms: int = 7 * 86_400_000, memory_ms: int = 90 * 86_400_000) -> DataFrame:
    """EVENTS of a stream of captures. Rows without site, id or time are left out.

    The state of a site is its last capture and the ids that it has shown (those not over ``memory_ms`` older than the last
    capture). Of a micro-batch's captures, in order of time and id, each gives one event: 'first', 'pair' (with the capture
    before it), 'late' (older than the last one) or 'repeat' (its id has been seen). Of the two latter the state takes no
    notice. A site that is silent for ``silence_ms`` gives 'silent', once until it speaks again.
    """

    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        (site,) = key
        last = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(("silent", site, last[0], last[1], None, None, None))
        else:
            seen = json.loads(last[3]) if last else {}
            last = last and last[:3]
            rows = sorted(row for frame in frames for row in frame[["at", "snapshot_id", "tokens"]].itertuples(index=False, name=None))
            for at, snapshot_id, tokens in rows:
                kind = "repeat" if snapshot_id in seen else "first" if last is None else "late" if at < last[1] else "pair"
                before = (last[0], last[2]) if kind == "pair" else (None, None)
                out.append((kind, site, snapshot_id, at, tokens, *before))
                seen.setdefault(snapshot_id, at)
                if kind in ("first", "pair"):
                    last = (snapshot_id, at, tokens)
            seen = {k: v for k, v in seen.items() if v >= last[1] - 1000 * memory_ms}
            state.update((*last, json.dumps(seen)))
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    rows = captures.where("site is not null and snapshot_id is not null and captured_at is not null")
    rows = rows.select(F.col("site").cast("long").alias("site"), "snapshot_id", F.unix_micros("captured_at").alias("at"), F.to_json(F.col("tokens").cast(f"array<{TOKEN}>")).alias("tokens"))
    found = rows.groupBy("site").applyInPandasWithState(run, _FOUND, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("kind", "site", "snapshot_id", F.timestamp_micros("at").alias("captured_at"), "tokens", "base_id", "base_tokens")


def record(found: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the events to a Parquet table, which start() can read as a stream of its own."""
    return _started(found.writeStream.format("parquet").option("path", folder), found, checkpoint, trigger)


def _started(writer: DataStreamWriter, found: DataFrame, checkpoint: str, trigger: dict) -> StreamingQuery:
    """With the trigger availableNow, a query that waits for silence would go on with empty micro-batches for ever; they are
    turned off for it, so silence is told with the next data of any site."""
    trigger = trigger or {"availableNow": True}
    conf, key = found.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    if trigger.get("availableNow"):
        conf.set(key, "false")
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(key, before)


def baseline_events(captures: DataFrame, baselines: DataFrame) -> DataFrame:
    """EVENTS of a stream of captures beside each site's baseline (site, base_id, tokens; a table): 'pair', or 'first' for
    sites without one."""
    held = baselines.select("site", "base_id", F.to_json(F.col("tokens").cast(f"array<{TOKEN}>")).alias("base_tokens"))
    rows = captures.select(F.col("site").cast("long").alias("site"), "snapshot_id", "captured_at", F.to_json(F.col("tokens").cast(f"array<{TOKEN}>")).alias("tokens")).join(held, "site", "left")
    rows = rows.where("base_id is null or base_id <> snapshot_id").withColumn("kind", F.when(F.col("base_id").isNull(), "first").otherwise("pair"))
    return rows.select("kind", "site", "snapshot_id", "captured_at", "tokens", "base_id", "base_tokens")


def compared(pairs_of: DataFrame) -> DataFrame:
    """drift.compared() of the 'pair' events of a batch."""
    own = pairs_of.where("kind = 'pair'")
    pairs = own.select(F.concat_ws(">", "base_id", "snapshot_id").alias("pair_id"), "base_id", F.col("snapshot_id").alias("cand_id"))
    sides = own.select("snapshot_id", "tokens").union(own.select("base_id", "base_tokens")).dropDuplicates(["snapshot_id"])
    tokens = sides.select("snapshot_id", F.explode(F.from_json("tokens", f"array<{TOKEN}>")).alias("t")).select("snapshot_id", "t.*")
    empty = sides.select("snapshot_id", F.lit("none").alias("category"), *(F.lit(None).cast(t).alias(c) for c, t in (("ord", "bigint"), ("key", "string"), ("value", "string"), ("num", "double"), ("count", "bigint"), ("confidence", "string"))))
    return drift.compared(pairs, tokens.union(empty))  # the extra row keeps captures without tokens


def start(found: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write, micro-batch by micro-batch, reports and changes of the pairs and the other events as Parquet under folder:
    reports, changes and others, each with batch=<id>. A batch that is worked again after a failure replaces its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows = compared(batch).persist()
        try:
            for name, out in (("reports", drift.reports(drift.categories(rows))), ("changes", drift.changes(rows)), ("others", batch.where("kind <> 'pair'").select("kind", "site", "snapshot_id", "captured_at"))):
                out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()
            batch.unpersist()

    return _started(found.writeStream.foreachBatch(write), found, checkpoint, trigger)
