"""Row sources: CSV, JSON lines, SQLite (data source), shards, schema inspection."""

from __future__ import annotations

import sqlite3
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.digests import schema_fingerprint


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all columns strings; an empty file is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line, with an explicit schema; unreadable lines come out in _corrupt_record."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE")


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("query", "select ...").option("key", column).option("partitions", n)

    Reads a copy of a SQLite file that every executor sees. With a numeric key the query is cut into ranges, one per partition; rows with a null key come with the first.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            db.execute(f"create temp view wanted as {self.options['query']}")
            columns = db.execute("pragma table_info(wanted)").fetchall()
        return T.StructType([T.StructField(name, kinds.get((kind or "").upper(), T.StringType())) for _, name, kind, *_ in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _Range(InputPartition):
    def __init__(self, low, high, nulls=False):
        self.low, self.high, self.nulls = low, high, nulls


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.options = [f.name for f in schema.fields], options
        if not options["query"].lstrip().lower().startswith(("select", "with")):
            raise ValueError("only SELECT or WITH queries are read")

    def partitions(self):
        n, key = int(self.options.get("partitions", 1)), self.options.get("key")
        if n <= 1 or not key:
            return [_Range(None, None)]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"select min({key}), max({key}) from ({self.options['query']})").fetchone()
        if low is None:
            return [_Range(None, None)]
        step = max(1, (high - low + n) // n)
        return [_Range(low + i * step, low + (i + 1) * step, i == 0) for i in range(n)]

    def read(self, partition):
        where, args = "", ()
        if partition.low is not None:
            key = self.options["key"]
            where, args = f" where ({key} >= ? and {key} < ?)" + (f" or {key} is null" if partition.nulls else ""), (partition.low, partition.high)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            yield from db.execute(f"select {', '.join(self.names)} from ({self.options['query']}){where}", args)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def rename(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Projection with logical names: {physical: logical}."""
    return df.select([F.col(f"`{p}`").alias(name) for p, name in fields.items()])


def shard_name(username):
    return F.concat(F.lit("Msg_"), F.md5(username))


def union_shards(shards: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """All message shards with their conversation; a shard without a session is an error row set returned by `unmatched`."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("shard", F.lit(name)) for name, df in shards.items()])
    return rows.join(sessions.select(shard_name("username").alias("shard"), F.col("username").alias("conversation_id")), "shard")


def unmatched(shard_names: DataFrame, sessions: DataFrame) -> DataFrame:
    return shard_names.join(sessions.select(shard_name("username").alias("shard")), "shard", "left_anti")


def inspect(tables: dict[str, DataFrame], required: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> dict:
    """Catalog check: missing tables and columns, state of optional capabilities, fingerprint of the whole schema."""
    missing = [t for t in required if t not in tables] + [f"{t}.{c}" for t, cs in required.items() if t in tables for c in cs if c not in tables[t].columns]
    states = {t: "not_present" if t not in tables else "mapped" if set(cs) <= set(tables[t].columns) else "present_unmapped" for t, cs in (optional or {}).items()}
    whole = T.StructType([T.StructField(n, T.StringType() if df is None else T.StructType(sorted(df.schema.fields, key=lambda f: f.name))) for n, df in sorted(tables.items())])
    return {"missing": missing, "optional": states, "fingerprint": schema_fingerprint(whole)}


def union_optional(base: DataFrame, extras: dict[str, DataFrame | None]) -> DataFrame:
    """base with the optional sources that are there, under a capability column."""
    out = base.withColumn("capability", F.lit("messages"))
    for name, df in extras.items():
        if df is not None:
            out = out.unionByName(df.withColumn("capability", F.lit(name)), allowMissingColumns=True)
    return out
