"""Incremental ingestion: sources with monotone cursors, exactly-once delivery, states with leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.digests import schema_fingerprint
from tessera.operators.ingest import after_watermark, watermarks


def _batches(spark: SparkSession, marks: str) -> list[int]:
    """Numbers of the batches whose state of the cursors is in the log, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(marks)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [x.getPath().getName() for x in fs.listStatus(p) if fs.exists(done(x.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch_number=")) for n in names if n.startswith("batch_number="))


def _marks(spark: SparkSession, marks: str, number: int) -> DataFrame | None:
    """Cursors as they were before batch `number`: the state after the batch before it, never what a run of the batch itself left."""
    before = [n for n in _batches(spark, marks) if n < number]
    return spark.read.parquet(f"{marks}/batch_number={before[-1]}") if before else None


def ingest(stream: DataFrame, out: str, marks: str, checkpoint: str, keys: list[str], order: list[str], keep: int = 8) -> StreamingQuery:
    """Append rows beyond their shard's watermark to `out`; the cursors move only after the batch is written.

    Every batch writes its rows and then the state of all cursors after it, each to a folder of its own. A batch that is run again reads the state before it and
    replaces both folders, so nothing is appended twice and nothing is lost, wherever the first run ended. Only the last `keep` states stay.
    A stream whose schema isn't the one of the log is refused.
    """
    if schema_changed(stream.sparkSession, stream, marks):
        raise ValueError("the stream's schema isn't the one under which its log was written")
    seal = schema_fingerprint(stream.schema)
    names = [f"wm_{c}" for c in order]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _marks(spark, marks, number)
        fresh = after_watermark(batch, before.select(*keys, *names), keys, order) if before is not None else batch
        target = f"{out}/batch={number}"
        fresh.write.mode("overwrite").parquet(target)  # the sink first
        new = watermarks(spark.read.schema(batch.schema).parquet(target), keys, order)
        if before is not None:
            top = before.select(*keys, *names).unionByName(new).groupBy(*keys).agg(F.max(F.struct(*names)).alias("m"))
            new = top.select(*keys, *[F.col(f"m.{c}").alias(c) for c in names])
        new.withColumn("schema_seal", F.lit(seal)).write.mode("overwrite").parquet(f"{marks}/batch_number={number}")  # then the cursors
        for old in _batches(spark, marks)[:-keep]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/batch_number={old}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def schema_changed(spark: SparkSession, stream: DataFrame, marks: str) -> bool:
    """Whether the log's last state was written under another schema."""
    done = _batches(spark, marks)
    if not done:
        return False
    return spark.read.parquet(f"{marks}/batch_number={done[-1]}").where(F.col("schema_seal") != schema_fingerprint(stream.schema)).limit(1).count() > 0


def once(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its copies come within the delay; state is dropped after it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


STATE_SCHEMA = "status string, n_events long, lease_until double"
OUT_SCHEMA = "unit string, status string, n_events long, error string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, final: str, lease_s: float) -> Iterator[pd.DataFrame]:
    status, n, lease = state.get if state.exists else ("new", 0, 0.0)
    if state.hasTimedOut:
        state.update(("expired", n, 0.0))
        yield pd.DataFrame({"unit": [key[0]], "status": ["expired"], "n_events": [n], "error": [None]})
        return
    error = None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for event in rows["event"]:
        if status == final:
            error = "event after the final state"
            break
        status, n = event, n + 1
    state.update((status, int(n), float(lease)))
    if status != final and lease_s > 0:
        state.setTimeoutDuration(int(lease_s * 1000))
    yield pd.DataFrame({"unit": [key[0]], "status": [status], "n_events": [n], "error": [error]})


def states(stream: DataFrame, final: str = "accepted", lease_s: float = 900.0) -> DataFrame:
    """Current status of every unit of (unit, seq, event); a final state is terminal, an idle unit expires after its lease (0: never).

    With a lease the query wakes up for timeouts as long as it runs, so it needs a trigger that goes on, not availableNow.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if lease_s > 0 else GroupStateTimeout.NoTimeout
    def fold(key, batches, state):
        return _fold(key, batches, state, final, lease_s)

    return stream.groupBy("unit").applyInPandasWithState(fold, OUT_SCHEMA, STATE_SCHEMA, "update", timeout)
