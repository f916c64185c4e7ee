"""Sinks: write-once tables, sealed releases, index generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.digests import group_digest, key_digest
from tessera.operators.ingest import forbidden_keys


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order."""
    return df.agg(group_digest(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})).alias("d")).first()["d"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> str:
    """Write a table that must never change: writing the same rows again does nothing, other rows are an error."""
    spark = df.sparkSession
    if _exists(spark, path):
        if table_digest(spark.read.parquet(path)) != table_digest(df):
            raise ValueError(f"{path} is frozen and differs")
        return "unchanged"
    df.write.mode("errorifexists").parquet(path)
    return "written"


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: Columns a release may hold, and keys that must never leave.
RELEASE_COLUMNS = ["record_id", "source_fingerprint", "timestamp", "direction", "author_scope", "authored_text", "quoted_text", "message_kind", "conversation_id", "redaction_status"]


def private_keys(records: DataFrame) -> DataFrame:
    """(column, key, n): keys that must not leave, in the JSON that string columns hold."""
    names = [f.name for f in records.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return records.sparkSession.createDataFrame([], "column string, key string, n long")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), forbidden_keys(F.col(f"`{n}`")).alias("keys")) for n in names]))
    return records.select(each.alias("x")).select("x.column", F.explode("x.keys").alias("key")).groupBy("column", "key").agg(F.count("*").alias("n"))


def build_release(records: DataFrame, path: str, generation: str) -> DataFrame:
    """Sealed data set: whitelisted columns, pseudonymous conversations, and a manifest row with count and digest.

    Rows are scanned for private keys before anything is written; one such key and there is no release.
    """
    kept = records.select([c for c in RELEASE_COLUMNS if c in records.columns])
    found = private_keys(kept).limit(20).collect()  # names of keys for the message
    if found:
        raise ValueError("private keys in the release: " + ", ".join(sorted(f"{r['column']}.{r['key']}" for r in found)))
    if "conversation_id" in kept.columns:
        kept = kept.withColumn("conversation_id", F.concat(F.lit("conv_"), F.substring(key_digest(F.lit(generation), F.col("conversation_id")), 1, 20)))
    kept.write.mode("errorifexists").parquet(f"{path}/records")
    stored = kept.sparkSession.read.parquet(f"{path}/records")
    manifest = kept.sparkSession.createDataFrame([(generation, stored.count(), table_digest(stored))], "generation string, n_records long, digest string")
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return manifest


def verify_release(spark: SparkSession, path: str) -> bool:
    manifest = spark.read.parquet(f"{path}/manifest").first()
    stored = spark.read.parquet(f"{path}/records")
    return stored.count() == manifest["n_records"] and table_digest(stored) == manifest["digest"]


#: Index generations that stay: the present one and the one before it.
RETAINED = 2


def synchronize(chunks: DataFrame, root: str, generation: str, previous: str | None, embed) -> DataFrame:
    """A new index generation: vectors of chunks whose input is unchanged are taken from the previous one, the others embedded.

    embed is a Column function text -> ARRAY<FLOAT>. A previous generation that isn't what its pointer says gives nothing over: all chunks are embedded again.
    The pointer row, with count and digest, is appended last, so readers never see half a generation; generations before the last RETAINED go away.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("input_hash", F.sha2("text", 256))
    if previous is not None and intact(spark, root, previous):
        old = spark.read.parquet(f"{root}/{previous}").where("vector is not null").select("input_hash", "vector").dropDuplicates(["input_hash"])
        reused = keyed.join(old, "input_hash", "inner")
        fresh = keyed.join(old.select("input_hash"), "input_hash", "left_anti").withColumn("vector", embed(F.col("text")))
        out = reused.unionByName(fresh)
    else:
        out = keyed.withColumn("vector", embed(F.col("text")))
    out.write.mode("errorifexists").parquet(f"{root}/{generation}")
    stored = spark.read.parquet(f"{root}/{generation}")
    row = spark.createDataFrame([(generation, stored.count(), table_digest(stored))], "generation string, n_rows long, digest string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/pointer")
    for name in _generations(spark, root)[RETAINED:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return stored


def _generations(spark: SparkSession, root: str) -> list[str]:
    """Names of all generations that were completed, the latest first."""
    if not _exists(spark, f"{root}/pointer"):
        return []
    return [r["generation"] for r in spark.read.parquet(f"{root}/pointer").orderBy(F.desc("at"), F.desc("generation")).collect()]  # one row per generation


def current_generation(spark: SparkSession, root: str) -> str | None:
    return next(iter(_generations(spark, root)), None)


def intact(spark: SparkSession, root: str, generation: str) -> bool:
    """Whether a generation is there and has the rows its pointer was written for."""
    if not _exists(spark, f"{root}/{generation}"):
        return False
    row = spark.read.parquet(f"{root}/pointer").where(F.col("generation") == generation).orderBy(F.desc("at")).first()
    stored = spark.read.parquet(f"{root}/{generation}")
    return row is not None and stored.count() == row["n_rows"] and table_digest(stored) == row["digest"]


def load_generation(spark: SparkSession, root: str, generation: str | None = None) -> DataFrame:
    """The present or the named generation, its rows checked against the pointer; vectors of several lengths, or without one, are refused."""
    name = generation or current_generation(spark, root)
    if name is None or not intact(spark, root, name):
        raise ValueError(f"generation {name} isn't what its pointer says")
    stored = spark.read.parquet(f"{root}/{name}")
    if stored.where("vector is not null").select(F.size("vector")).distinct().count() > 1 or not stored.where("vector is null").isEmpty():
        raise ValueError(f"generation {name} has vectors of several lengths or none")
    return stored


def reconcile(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty when the index matches the corpus."""
    cols = recomputed.columns
    return stored.select(cols).exceptAll(recomputed).withColumn("side", F.lit("stored")).unionByName(recomputed.exceptAll(stored.select(cols)).withColumn("side", F.lit("recomputed")))
