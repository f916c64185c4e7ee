"""File inventories and content measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media kinds by file extension.
KINDS = {"image": ["jpg", "jpeg", "png", "gif", "webp", "dat"], "voice": ["silk", "aud", "wav", "m4a", "mp3"], "video": ["mp4", "mov", "avi", "mkv"]}


def media_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for kind, extensions in KINDS.items():
        out = out.when(ext.isin(extensions), F.lit(kind))
    return out.otherwise(F.lit("attachment"))


def media_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(media_ref, basename, kind, content_hash, size) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.concat(F.lit("media_"), F.substring(F.sha2(F.col("path"), 256), 1, 20)).alias("media_ref"), name.alias("basename"), media_kind(name).alias("kind"), F.sha2(F.col("content"), 256).alias("content_hash"), F.col("length").alias("size"))


def entropy(df: DataFrame, group: str, symbols: Column) -> DataFrame:
    """(group, n_symbols, entropy in bits) over an array of symbols per row; counts combine before the shuffle."""
    counts = df.select(group, F.explode(symbols).alias("s")).groupBy(group, "s").agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("n_symbols"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return totals.select(group, "n_symbols", F.round(F.log2("n_symbols") - F.col("x") / F.col("n_symbols"), 6).alias("entropy"))


def byte_entropy(files: DataFrame) -> DataFrame:
    """Per file of (path, content): entropy of its bytes and whether it looks encrypted (at least 7 bits)."""
    hexes = F.regexp_extract_all(F.hex("content"), F.lit("(..)"), 1)
    return entropy(files, "path", hexes).withColumn("looks_encrypted", F.col("entropy") >= 7)
