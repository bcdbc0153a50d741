"""Counters, sessions and throttles over outcome rows; the same functions serve batch and streaming where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgate.functions.formatting import valid_change_list


def counted(outcomes: DataFrame) -> DataFrame:
    """(change): one row per outcome and distinct change, of messages whose names are all counted ones."""
    valid = valid_change_list(F.array("changes"))
    return outcomes.where(valid).select(F.explode(F.array_distinct("changes")).alias("change"))


def fix_counts(outcomes: DataFrame) -> DataFrame:
    """How many outcomes had each change."""
    return counted(outcomes).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def idle_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(owner, session_no, first_ts, n): a gap of ``gap_seconds`` or more starts a session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    near = F.col("ts") < before + F.make_dt_interval(secs=F.lit(gap_seconds))
    marked = events.withColumn("new", F.when(near, 0).otherwise(1))
    numbered = marked.withColumn("session_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(F.col("user_id").alias("owner"), "session_no").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))


def throttled(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(owner, event_id, ts) of the events let through: the first, then each that comes ``gap_seconds`` after the last one let through.

    The choice depends on all choices before it, so it is a scan in order. Rows are dealt out and sorted by
    Spark; a task streams through its sorted rows and holds one timestamp, however many events an owner has.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, last = None, None
        for batch in batches:
            keep = []
            for who, ts in zip(batch["owner"], batch["ts"], strict=True):
                ok = who != owner or (ts - last).total_seconds() >= gap_seconds
                if ok:
                    owner, last = who, ts
                keep.append(ok)
            yield batch[keep]

    rows = events.select("owner", "event_id", "ts").where("owner is not null and ts is not null")
    return rows.repartition("owner").sortWithinPartitions("owner", "ts", "event_id").mapInPandas(scan, rows.schema)
