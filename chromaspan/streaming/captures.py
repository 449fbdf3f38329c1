"""Streams of captures: deduplicated ingest, usage timelines, sessions, and alerts on status changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str = "snapshot_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def timeline(rows: DataFrame, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """start, token, n, total: uses per token and tumbling window; batch or stream."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = timed.groupBy(F.window(time, width), "token").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "token", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """site, start, end, n: captures of a site without a longer gap."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = timed.groupBy(F.session_window(time, gap), "site").agg(F.count("*").alias("n"))
    return out.select("site", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def status_alerts(stream: DataFrame) -> DataFrame:
    """site, ts, status, before: rows (site, ts, status) whose status differs from the site's last one."""

    def run(key, frames: Iterator, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for ts, status in pdf.sort_values("ts")[["ts", "status"]].itertuples(index=False):
                if last is not None and status != last:
                    out.append((key[0], ts, status, last))
                last = status
            yield pd.DataFrame(out, columns=["site", "ts", "status", "before"])
        state.update((last,))

    return stream.groupBy("site").applyInPandasWithState(run, "site long, ts timestamp, status string, before string", "last string", "append", "NoTimeout")
