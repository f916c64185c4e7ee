import os
import shutil
from datetime import datetime, timedelta

import pytest

from tessera.streaming import increments, windows

SCHEMA = "shard string, sort_seq int, local_id int, body string"


def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    src, out, marks, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "marks", "ck"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(src)
    put([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 1, 1, "z")])

    def run():
        increments.ingest(spark.readStream.schema(SCHEMA).json(src), out, marks, ck, ["shard"], ["sort_seq", "local_id"]).awaitTermination()
        return spark.read.schema(SCHEMA + ", batch int").parquet(out).count()

    assert run() == 3
    put([("a", 2, 1, "late"), ("a", 1, 9, "late"), ("b", 1, 2, "new")])
    assert run() == 4
    assert run() == 4
    assert not increments.schema_changed(spark, spark.createDataFrame([], SCHEMA), marks)
    assert increments.schema_changed(spark, spark.createDataFrame([], SCHEMA + ", extra int"), marks)


@pytest.mark.parametrize("lost", ["nothing", "marks", "half"])
def test_a_batch_run_again_keeps_its_rows(spark, tmp_path, lost):
    src, out, marks, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "marks", "ck"))

    def run():
        increments.ingest(spark.readStream.schema(SCHEMA).json(src), out, marks, ck, ["shard"], ["sort_seq", "local_id"]).awaitTermination()
        return sorted((r.shard, r.sort_seq) for r in spark.read.schema(SCHEMA + ", batch int").parquet(out).collect())

    spark.createDataFrame([("a", 1, 1, "x")], SCHEMA).coalesce(1).write.mode("append").json(src)
    run()
    spark.createDataFrame([("a", 1, 1, "again"), ("a", 2, 1, "y"), ("b", 1, 1, "z")], SCHEMA).coalesce(1).write.mode("append").json(src)
    want = run()
    assert want == [("a", 1), ("a", 2), ("b", 1)]
    for name in ("1", ".1.crc"):  # the stream died before it took the batch down as done
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    if lost == "marks":  # between the sink and the cursors
        shutil.rmtree(f"{marks}/batch_number=1")
    if lost == "half":  # while the cursors were written
        os.remove(f"{marks}/batch_number=1/_SUCCESS")
    assert run() == want and run() == want


def test_another_schema_is_refused(spark, tmp_path):
    src, out, marks, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "marks", "ck"))
    spark.createDataFrame([("a", 1, 1, "x")], SCHEMA).coalesce(1).write.json(src)
    increments.ingest(spark.readStream.schema(SCHEMA).json(src), out, marks, ck, ["shard"], ["sort_seq", "local_id"]).awaitTermination()
    with pytest.raises(ValueError, match="schema"):
        increments.ingest(spark.readStream.schema(SCHEMA + ", extra int").json(src), out, marks, ck, ["shard"], ["sort_seq", "local_id"])


def test_states(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "unit string, seq int, event string"
    spark.createDataFrame([("u", 2, "produced"), ("u", 1, "claimed"), ("v", 1, "accepted"), ("v", 2, "claimed")], schema).coalesce(1).write.json(src)
    q = increments.states(spark.readStream.schema(schema).json(src), lease_s=0).writeStream.format("memory").queryName("unit_states").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.unit: (r.status, r.n_events, r.error) for r in spark.table("unit_states").collect()}
    assert got == {"u": ("produced", 2, None), "v": ("accepted", 1, "event after the final state")}


def test_windows_and_once_over_a_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    t = datetime(2024, 1, 1)
    rows = [(1, t, 7, "view", 1.0), (1, t, 7, "view", 1.0), (2, t + timedelta(minutes=20), 7, "view", 2.0), (3, t + timedelta(hours=9), 7, "click", 1.0)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)

    def collect(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert collect(increments.once(stream, ["event_id"]), "single_events", "append").count() == 3
    assert collect(windows.tumbling(stream, "1 hour"), "hourly", "complete").where("event_type = 'view'").first()["n"] == 3
    batch = spark.read.parquet(src)
    assert windows.sessions(batch, "30 minutes").count() == 2
