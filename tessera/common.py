"""Helpers every operator shares: table access, the cluster's shared folder, hot keys."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the key histogram and the share of all rows from which a bucket is hot. At most 1/HOT_SHARE buckets can be hot.
HISTOGRAM_BUCKETS = 4096
HOT_SHARE = 1 / 64
SALTS = 32
#: Sides up to this many bytes, measured and not estimated, may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: they may run elsewhere and in another folder than the driver."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera-package")
        atexit.register(shutil.rmtree, os.path.dirname(base), ignore_errors=True)
        with zipfile.ZipFile(f"{base}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(f"{base}.zip")  # Spark copies it to every executor
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir, or a folder of our own where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {context.master}")
            own = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            context.setCheckpointDir("file://" + own)
        root = context._jsc.sc().getCheckpointDir().get()
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, path: str) -> None:
    """A scratch folder for files that tasks write themselves."""
    fs, p = _folder(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def until_exit(spark: SparkSession, path: str) -> None:
    """A scratch folder that exists goes away with the application."""
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that no table still to be computed reads."""
    for df in staged:
        fs, p = _folder(df.sparkSession, df._staged_at)
        fs.delete(p, True)


def hash_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: 128 bits stand for the key in shuffles."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols, F.lit("k"))]


def hot_buckets(df: DataFrame, key_hash: Column, share: float = HOT_SHARE) -> list[int]:
    """Buckets of the key histogram that hold at least `share` of all rows.

    One column-pruned pass; the aggregate combines on the map side and at most HISTOGRAM_BUCKETS rows reach the driver, at any input size.
    """
    counts = df.groupBy(F.pmod(key_hash, F.lit(HISTOGRAM_BUCKETS)).cast("int").alias("b")).count().collect()
    total = sum(r["count"] for r in counts)
    return sorted(r["b"] for r in counts if r["count"] >= max(1000, share * total))


def salt(key_hash: Column, row: Column, hot: list[int], salts: int = SALTS) -> Column:
    """0 for a key outside the hot buckets, else one of `salts` values by row."""
    if not hot:
        return F.lit(0)
    return F.when(F.pmod(key_hash, F.lit(HISTOGRAM_BUCKETS)).isin(hot), F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], how: str = "left", also: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join on `key` (and `also`); rows of hot keys on the left are spread over salts, the right rows of those keys repeated for each salt."""
    keys = [key, *(also or [])]
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.pmod(F.xxhash64(F.col(key)), F.lit(HISTOGRAM_BUCKETS)).isin(hot)
    spread = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
