import sqlite3

import pytest
from pyspark.sql import functions as F
from tessera.sources import files, markdown, sinks, tables


def test_frontmatter():
    p = markdown.parse_page('---\naliases: [A, "b, c", \'it\'\'s\']\nevidence:\n  - "[[sources/s]]"\n  - 2\nupdated: 2024-02-30\ncreated: 2024-02-03\nquoted: "2024-02-03"\nn: -1.5\nok: true\nnothing: ~\n# note\n---\nBody')
    f = p["fields"]
    assert f == {"aliases": ["A", "b, c", "it's"], "evidence": ["[[sources/s]]", 2], "updated": "2024-02-30", "created": "2024-02-03T00:00:00.000Z", "quoted": "2024-02-03", "n": -1.5, "ok": True, "nothing": None}
    assert p["body"] == "Body"
    assert "duplicate" in markdown.parse_page("---\na: 1\na: 2\n---\n", strict=True)["error"]
    assert markdown.parse_page("no", strict=True)["error"] == "missing frontmatter" and markdown.parse_page("---\na: 1", strict=True)["error"] == "unclosed frontmatter"
    assert markdown.parse_page(None)["body"] == ""


def test_body_splits():
    assert markdown.split_body("a\n<!-- timeline -->\nb") == ("a", "b")
    assert markdown.split_body("a\n--- Timeline ---\nb") == ("a", "b")
    assert markdown.split_body("a\n---\n\n## History\nb") == ("a", "\n## History\nb")
    assert markdown.split_body("a\n---\nb") == ("a\n---\nb", "")


CLAIM = "## Claims\n### C-1 one\n- 陈述：s\n- 类型：事实\n- 直接依据：\n  - e1\n- 样本量：3\n- 利益关系：none\n- 允许用途：\n  - default_answer\n- 禁止用途：[]\n- 反证：[]\n- 证据缺口：[]\n- 适用范围：[]\n- 失效条件：[]\n- 下一步验证：[]\n"


def test_claims(spark):
    claims, issues = markdown.parse_claims(CLAIM)
    assert issues == [] and claims[0]["claim_type"] == "fact" and claims[0]["sample_size"] == 3 and claims[0]["direct_evidence"] == ["e1"]
    codes = {c for c, _ in markdown.parse_claims(CLAIM + "### C-1 two\n- 类型：谣言\n- 样本量：x\n")[1]}
    assert {"DUPLICATE_CLAIM_ID", "UNKNOWN_CLAIM_TYPE", "INVALID_SAMPLE_SIZE", "MISSING_CLAIM_FIELD"} <= codes
    assert markdown.parse_claims("none")[1] == [("MISSING_CLAIMS_SECTION", "$.claims")]
    df = markdown.claim_records(spark.createDataFrame([(CLAIM,), (None,)], "body string"))
    assert df.select(F.size("parsed.claims")).collect()[0][0] == 1


def test_vault_scan(spark, tmp_path):
    for name in ("methods/alpha.md", "sources/deep/one.md", ".raw/secret.md", "README.md", "ops/x.md", "methods/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("---\ntitle: T\n---\nx")
    got = markdown.scan_vault(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == ["methods/alpha.md", "sources/deep/one.md"]
    assert markdown.parse_pages(got, "markdown").select("page.title").distinct().collect()[0][0] == "T"


def test_rows_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,text\n1,\"a,\nb\"\n".encode())
    assert [tuple(r) for r in tables.read_csv_rows(spark, str(tmp_path / "a.csv")).collect()] == [("1", "a,\nb")]
    (tmp_path / "e.csv").write_text("id,text\n")
    with pytest.raises(ValueError):
        tables.read_csv_rows(spark, str(tmp_path / "e.csv"))
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": \n')
    rows = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").cache()
    assert rows.where("_corrupt_record is not null").count() == 1


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("create table m (id integer, name text, x real)")
        db.executemany("insert into m values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)])
    tables.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("query", "select id, name, x from m where id > 9").option("key", "id").option("partitions", "3").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 90 and df.agg(F.sum("x")).first()[0] == sum(range(10, 100)) / 2


def test_sqlite_keeps_null_keys(spark, tmp_path):
    path = str(tmp_path / "n.db")
    with sqlite3.connect(path) as db:
        db.execute("create table m (id integer, name text)")
        db.executemany("insert into m values (?, ?)", [(None if i % 3 == 0 else i, f"n{i}") for i in range(30)])
    tables.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("query", "select id, name from m").option("key", "id").option("partitions", "4").load()
    assert df.rdd.getNumPartitions() == 4 and sorted(r.name for r in df.collect()) == sorted(f"n{i}" for i in range(30))


def test_catalog_and_shards(spark):
    m = spark.createDataFrame([(1, "a")], "local_id int, content string")
    state = tables.inspect({"message": m}, {"message": ["local_id", "server_id"], "contact": ["id"]}, {"favorite": ["x"]})
    assert state["missing"] == ["contact", "message.server_id"] and state["optional"] == {"favorite": "not_present"}
    sessions = spark.createDataFrame([("u1",)], "username string")
    name = sessions.select(tables.shard_name("username")).first()[0]
    assert tables.union_shards({name: m, "Msg_x": m}, sessions).count() == 1
    assert tables.unmatched(spark.createDataFrame([(name,), ("Msg_x",)], "shard string"), sessions).first()[0] == "Msg_x"
    assert tables.rename(m, {"local_id": "id"}).columns == ["id"]


def test_files(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "b.silk").write_bytes(b"aaaa")
    got = {r.basename: r.kind for r in files.media_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": "image", "b.silk": "voice"}
    rows = files.byte_entropy(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()
    assert sorted((r.entropy, r.looks_encrypted) for r in rows) == [(0.0, False), (8.0, True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "fp", "hello", "c1", "raw")], "record_id string, source_fingerprint string, authored_text string, conversation_id string, secret string")
    assert sinks.write_once(df, f"{tmp_path}/w") == "written" and sinks.write_once(df, f"{tmp_path}/w") == "unchanged"
    with pytest.raises(ValueError):
        sinks.write_once(df.withColumn("secret", F.lit("x")), f"{tmp_path}/w")
    sinks.build_release(df, f"{tmp_path}/rel", "g1")
    released = spark.read.parquet(f"{tmp_path}/rel/records")
    assert "secret" not in released.columns and released.first()["conversation_id"] != "c1" and sinks.verify_release(spark, f"{tmp_path}/rel")
    df.select("record_id").write.mode("append").parquet(f"{tmp_path}/rel/records")
    assert not sinks.verify_release(spark, f"{tmp_path}/rel")


def test_index_generations(spark, tmp_path):
    embed = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "chunk_id string, text string")
    sinks.synchronize(chunks, f"{tmp_path}/ix", "g1", None, embed)
    later = chunks.unionByName(spark.createDataFrame([("c", "zzz")], chunks.schema))
    stored = sinks.synchronize(later, f"{tmp_path}/ix", "g2", sinks.current_generation(spark, f"{tmp_path}/ix"), lambda c: F.array(F.lit(-1.0).cast("float"), F.lit(0.0).cast("float")))
    assert {r.chunk_id: r.vector[0] for r in stored.collect()} == {"a": 1.0, "b": 2.0, "c": -1.0}
    assert sinks.current_generation(spark, f"{tmp_path}/ix") == "g2"
    assert sinks.reconcile(stored, later.select("chunk_id", "text")).count() == 0
    assert sinks.reconcile(stored, chunks).count() == 1
    assert sinks.load_generation(spark, f"{tmp_path}/ix").count() == 3 and sinks.load_generation(spark, f"{tmp_path}/ix", "g1").count() == 2
    # rows that are lost make the next generation a full one; two generations stay
    later.withColumn("input_hash", F.lit("x")).withColumn("vector", embed(F.col("text"))).limit(1).write.mode("overwrite").parquet(f"{tmp_path}/ix/g2")
    assert not sinks.intact(spark, f"{tmp_path}/ix", "g2")
    with pytest.raises(ValueError):
        sinks.load_generation(spark, f"{tmp_path}/ix")
    again = sinks.synchronize(later, f"{tmp_path}/ix", "g3", "g2", lambda c: F.array(F.lit(9.0).cast("float"), F.lit(0.0).cast("float")))
    assert {r.vector[0] for r in again.collect()} == {9.0} and not (tmp_path / "ix" / "g1").exists() and (tmp_path / "ix" / "g2").exists()


def test_no_release_with_private_keys(spark, tmp_path):
    df = spark.createDataFrame([("r1", '{"note": 1, "api_key": "k"}'), ("r2", None)], "record_id string, authored_text string")
    with pytest.raises(ValueError, match="authored_text.api_key"):
        sinks.build_release(df, f"{tmp_path}/rel", "g1")
    assert not (tmp_path / "rel").exists()
