import json

from pyspark.sql import functions as F
from tessera.operators import drift

SCHEMA = "stream_id string, file_seq int, line_no int, record string, field string"


def changes(spark, rows):
    df = spark.createDataFrame([(s, q, i, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, (s, q, r) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in drift.schema_changes(df).collect())


def test_kinds_of_change(spark):
    rows = [
        ("s", 1, {"local_id": 1, "content": "a", "device": "d"}), ("s", 1, {"local_id": None, "content": "b"}),
        ("s", 4, {"localId": "1", "Content": "a", "edited_at": 3}), ("s", 7, {"localId": 2, "Content": None, "edited_at": None}),
        ("t", 2, {"x": 1}),
    ]
    assert changes(spark, rows) == [
        ("s", 4, "added", "edited_at"), ("s", 4, "removed", "device"), ("s", 4, "renamed", "Content"), ("s", 4, "renamed", "localId"), ("s", 4, "type_changed", "localId"), ("s", 7, "type_changed", "localId"),
    ]


def test_unreadable_records_and_nulls(spark):
    rows = [("s", 1, '{"a": 1, "b"'), ("s", 1, None), ("s", 1, "[1]"), ("s", 1, {"a": 1}), ("s", 2, {"a": [1]}), (None, 3, {"a": 1}), ("s", None, {"a": 1})]
    assert changes(spark, rows) == [("s", 2, "type_changed", "a")]


def test_empty(spark):
    assert changes(spark, []) == []


def test_files_delivered_twice(spark):
    rows = [("s", 1, {"a": 1}), ("s", 1, {"a": 1}), ("s", 2, {"a": True}), ("s", 2, {"a": True})]
    assert changes(spark, rows) == [("s", 2, "type_changed", "a")]


def test_lattice(spark):
    masks = spark.createDataFrame([(0,), (1,), (2,), (6,), (10,), (48,), (32,)], "m int").select(drift.promote(F.col("m")))
    assert [r[0] for r in masks.collect()] == [None, "boolean", "integer", "number", "string", "string", "array"]


def test_one_table(spark):
    rows = [("s", 1, 1, json.dumps({"create_time": 1700000000, "senderId": {"wxid": "w1"}, "is_sender": True}), "x"), ("s", 2, 1, json.dumps({"createTime": "1700000000000", "sender_id": "w2", "isSend": "0"}), "x"), ("s", 2, 1, "{", "x")]
    out = drift.unified_messages(spark.createDataFrame(rows, SCHEMA)).orderBy("file_seq").collect()
    assert [(r.create_time, r.real_sender_id, r.is_sender) for r in out] == [(1700000000, "w1", 1), (1700000000, "w2", 0)]


def test_no_field_and_no_name_is_lost(spark):
    rows = [
        {"msgSvrId": 7, "talker": "w1", "device": ["d"], "read_count": 3, "odd": None, "Line_No": 9}, {"SenderID": "w2", "sender": "w3", "device": "x", "read_count": "4", "a.b'\"c": 1.5, "local_id": "x7"},
        {"senderId": {"id": "w4", "kind": "bot"}, "flag": True, "createTime": 1700000000123, "chatId": "c", "Device": 1},
    ]
    df = spark.createDataFrame([("s", i, 1, json.dumps(r), "x") for i, r in enumerate(rows)] + [(None, None, 1, json.dumps({"homeless": 1}), "x")], SCHEMA)
    unified = drift.unified_messages(df)
    types = dict(unified.dtypes)
    assert (types["read_count"], types["device_2"], types["odd"], types["a.b'\"c"], types["flag"], types["homeless"]) == ("string", "string", "string", "double", "boolean", "bigint")
    a, b, c, d = (r.asDict() for r in unified.orderBy(F.col("file_seq").asc_nulls_last()).collect())
    assert (a["server_id"], a["real_sender_id"], a["device_2"], a["read_count"], a["Line_No_2"], a["line_no"], a["other_values"]) == ("7", "w1", '["d"]', "3", 9, 1, [])
    assert (b["real_sender_id"], b["device_2"], b["a.b'\"c"], b["local_id"], sorted(map(tuple, b["other_values"]))) == ("w2", "x", 1.5, None, [("local_id", "x7"), ("sender", "w3")])
    assert (c["real_sender_id"], c["flag"], c["create_time"], c["conversation_id"], c["device_2"], c["Device"]) == ("w4", True, 1700000000, "c", None, 1)
    assert sorted(map(tuple, c["other_values"])) == [("createTime", "1700000000123"), ("senderId", '{"id":"w4","kind":"bot"}')] and d["homeless"] == 1
