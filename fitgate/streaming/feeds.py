"""Outcome streams: counters, the newest selection of each owner, and the ring of latest problems.

Every function takes a streaming frame and gives one; ``drain`` runs it over what is there now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fitgate.functions.formatting import MAX_PROBLEMS
from fitgate.operators.bookkeeping import fix_counts
from fitgate.plans.views import outcomes_of
from fitgate.session import shared_folder


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # a pattern: the table may be one file or a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Where state lies while a stream runs, as the processors of this package need it. These streams stop when they have taken in what there is, so a store
#: gives its local files back with its commit; else each partition would keep some 5 MB for every start.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class _Run:
    """A streaming frame run over all input there is, as often as asked for, from one checkpoint. The rows of each batch
    go to the shared folder and the state lies beside them; the driver holds no rows."""

    def __init__(self, spark: SparkSession, root: str, mode: str, sink: Callable[[DataFrame, int], object] | None = None):
        self.spark, self.root, self.mode = spark, root, mode
        self.sink = sink or self._write
        self.given: list[str] = []

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/rows/{batch_id}"
        rows.write.mode("overwrite").parquet(path)  # a batch that runs again gives the same rows
        if path not in self.given:
            self.given.append(path)

    def once(self, stream: DataFrame) -> None:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _STATE_STORE}
        for k, v in _STATE_STORE.items():
            conf.set(k, v)
        try:
            writer = stream.writeStream.foreachBatch(lambda rows, batch_id: self.sink(rows, batch_id)).option("checkpointLocation", f"{self.root}/state")
            writer.outputMode(self.mode).trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def rows(self, schema: StructType) -> DataFrame:
        if not self.given:
            return self.spark.createDataFrame([], schema)
        # in complete mode each batch holds the whole result
        return self.spark.read.schema(schema).parquet(*(self.given[-1:] if self.mode == "complete" else self.given))


def drain(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """Run a streaming frame over all input there is; what it gave, read from a table."""
    run = _Run(spark, shared_folder(spark, "drained"), mode)
    run.once(stream)
    return run.rows(stream.schema)


def deliveries(rows: DataFrame, parts: int = 3, order: str = "us") -> list[DataFrame]:
    """rows in so many ranges of ``order``, of about equal size; rows without it have no place in a stream and are left out."""
    found = rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else []
    edges = [None, *sorted(set(found or [])), None]
    inside = lambda a, b: (F.lit(True) if a is None else F.col(order) >= a) & (F.lit(True) if b is None else F.col(order) < b)
    return [rows.where(F.col(order).isNotNull() & inside(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def fed(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append", sink: Callable[[DataFrame, int], object] | None = None) -> DataFrame:
    """What the stream ``make(frame)`` gives when its input comes in these deliveries; with a ``sink(rows, batch_id)`` each batch goes there instead.

    Each delivery is written to a folder that the stream reads. The stream is started, takes in what is new and stops, so every delivery
    but the first finds the state of those before it in the checkpoint, just as after a lost driver.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    run = _Run(spark, shared_folder(spark, "fed"), mode, sink)
    out = None
    for k, part in enumerate(parts):
        part.write.parquet(f"{run.root}/in/{k:06d}")
        out = make(spark.readStream.schema(schema).parquet(f"{run.root}/in/*"))
        run.once(out)
    return run.rows(out.schema)


def running_counts(events: DataFrame) -> DataFrame:
    """Counts by change, kept as state; the same expression as in batch."""
    return fix_counts(outcomes_of(events))


def newest_selection(events: DataFrame) -> DataFrame:
    """(owner, us, event_id, turn): a newer selection supersedes the older; a late one with a lower (ts, event_id) is dropped. turn counts what an owner was given."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *best, turn = state.get if state.exists else (-1, -1, 0)
        before = best
        for b in batches:
            best = max(best, *map(list, zip(b["us"].tolist(), b["event_id"].tolist(), strict=True)))
        if best != before:
            state.update((*best, turn + 1))
            yield pd.DataFrame({"owner": [key[0]], "us": [best[0]], "event_id": [best[1]], "turn": [turn + 1]})

    rows = events.select(F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return rows.groupBy("owner").applyInPandasWithState(keep, "owner long, us long, event_id long, turn long", "us long, event_id long, turn long", "update", GroupStateTimeout.NoTimeout)


def problem_ring(events: DataFrame, size: int = MAX_PROBLEMS) -> DataFrame:
    """Per owner the latest problems: state of at most ``size`` entries, given out whole after each change. turn counts the changes of an owner."""

    def ring(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *columns, turn = state.get if state.exists else ([], [], [], 0)
        before = entries = list(zip(*columns, strict=True))
        for b in batches:
            entries = sorted([*entries, *zip(b["us"].tolist(), b["event_id"].tolist(), b["code"].tolist(), strict=True)])[-size:]
        if entries != before:
            state.update((*(list(x) for x in zip(*entries, strict=True)), turn + 1))
            yield pd.DataFrame({"owner": key[0], "us": [e[0] for e in entries], "event_id": [e[1] for e in entries], "code": [e[2] for e in entries], "turn": turn + 1})

    rows = outcomes_of(events).select("owner", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "code")
    return rows.groupBy("owner").applyInPandasWithState(
        ring, "owner long, us long, event_id long, code string, turn long", "us array<long>, event_id array<long>, code array<string>, turn long", "update", GroupStateTimeout.NoTimeout
    )


def last_given(rows: DataFrame, owner: str = "owner") -> DataFrame:
    """The rows of each owner's last turn, which is its state."""
    last = rows.groupBy(owner).agg(F.max("turn").alias("turn"))
    return rows.join(last, [owner, "turn"], "left_semi").drop("turn")


def closed_sessions(events: DataFrame, owner: str, gap_us: int, delay: str = "0 seconds") -> DataFrame:
    """(owner, first_us, last_us, n) of the sessions that are over, for a stream with a column ``us``: no event of the owner for the gap, and the watermark is past it.

    ``delay``: how late rows may come; what comes later than that is dropped and opens no session that is over.
    """
    timed = events.where(F.col(owner).isNotNull() & F.col("us").isNotNull()).withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    # a window takes in an event at its very end, but the gap is over then
    window = F.session_window("at", f"{gap_us - 1} microseconds")
    return timed.groupBy(owner, window).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("session_window")
