from pyspark.sql import functions as F
from tessera.operators import dedup

SCHEMA = "row_no long, server_id string, conversation_id string, local_id int, create_time int, message_content string, h1 string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, rows):
    return sorted(r[0] for r in dedup.lost_messages(frame(spark, rows), {"row_no": F.col("row_no")}).collect())


def test_identity_rules(spark):
    rows = [
        (5, " M-1\t", "c", 1, 1, "x", None), (2, "m-1", "d", 9, 9, None, None), (7, "M-1", None, None, None, "y", None),
        (1, "0", "c", 1, 1, "a", None), (3, None, "c", 1, 1, "b", None), (4, "  ", "c", 1, 1, "b", None), (6, "0", "c", 1, 2, "b", None),
        (8, None, None, 1, 1, "n", None), (9, None, None, 1, 1, "n", None), (10, "00", "c", 1, 1, "z", None),
    ]
    assert found(spark, rows) == [3, 4, 5, 7]


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, None, None, None, None)]) == []


def test_hot_identity_is_salted_and_whole(spark):
    rows = [(i, "hot", None, None, None, None, None) for i in range(4000)] + [(10_000 + i, f"k{i // 2}", None, None, None, None, None) for i in range(2000)]
    assert found(spark, rows) == list(range(1, 4000)) + [10_001 + 2 * i for i in range(1000)]


def test_vectors_apply_on_both_paths(spark, tmp_path):
    rows = [(i, f"s{i % 700}", "c", i, i, "text " * 20 + str(i), "clash") for i in range(2000)]
    path = str(tmp_path / "m.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    whole = spark.read.parquet(path)
    places = {"file": F.xxhash64("_metadata.file_path"), "position": F.col("_metadata.row_index")}
    vectors = dedup.deletion_vectors(dedup.lost_messages(whole, places))
    for limit in (1 << 25, 0):
        kept = dedup.read_by_vectors(spark, path, vectors, False, limit=limit)
        assert kept.columns == whole.columns
        assert sorted(r["row_no"] for r in kept.collect()) == list(range(700))
        assert sorted(r["row_no"] for r in dedup.read_by_vectors(spark, path, vectors, True, ["row_no"], limit=limit).collect()) == list(range(700, 2000))
    assert dedup.exactly_once(spark, path).count() == 700


def test_null_order_comes_last(spark):
    assert found(spark, [(None, "a", None, None, None, None, None), (9, "a", None, None, None, None, None)]) == [None]
