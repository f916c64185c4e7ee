"""Exactly one copy of each message that was delivered at least once.

Only a 128-bit identity, the delivery order and the row's place in its file are shuffled. The losers become deletion vectors, one bitmap
per file and 32768 rows, and the wide payload is read once, without a shuffle, with the marked rows left out.

Defined cases: a row without identity (any part of the fallback identity null) is no copy of any other row and is kept; rows with a null
delivery order come after all others; rows equal in everything are one message; an empty table gives an empty result; further columns pass
through; input columns that begin with `_tessera` aren't supported.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.common import BROADCAST_BYTES, hash_pair, hot_buckets, salt, scratch, until_exit

BITS = 32768  # of one built-in bitmap


def message_identity(server_id: Column, conversation_id: Column, local_id: Column, create_time: Column) -> Column:
    """The server's id without surrounding blanks and letter case, else conversation, local id and time together; null where neither is there."""
    sid = F.lower(F.btrim(server_id, F.lit(" \t")))
    usable = sid.isNotNull() & ~sid.isin("", "0")
    whole = conversation_id.isNotNull() & local_id.isNotNull() & create_time.isNotNull()
    fallback = F.concat_ws("\u001f", F.lit("f"), conversation_id, local_id.cast("string"), create_time.cast("string"))
    return F.when(usable, F.concat(F.lit("s\u001f"), sid)).when(whole, fallback)


def losers(df: DataFrame, identity: Column, order: Column, carry: dict[str, Column]) -> DataFrame:
    """Columns `carry` of every row of a message but the first by `order`.

    Hot identities are salted: a first pass leaves one candidate per identity and salt, a second one decides among these few.
    """
    h1, h2 = hash_pair(F.col("_id"))
    narrow = df.select(identity.alias("_id"), order.alias("_order"), *[c.alias(n) for n, c in carry.items()]).where("_id is not null").select(h1.alias("_h1"), h2.alias("_h2"), "_order", *carry)
    hot = hot_buckets(narrow, F.col("_h1"))
    narrow = narrow.withColumn("_salt", salt(F.col("_h1"), F.coalesce(F.col("_order"), F.lit(0)), hot))
    ranked = narrow.withColumn("_rn", F.row_number().over(Window.partitionBy("_h1", "_h2", "_salt").orderBy(F.col("_order").asc_nulls_last())))
    if not hot:
        return ranked.where("_rn > 1").select(*carry)
    is_hot = F.pmod(F.col("_h1"), F.lit(4096)).isin(hot)
    finals = ranked.where((F.col("_rn") == 1) & is_hot).withColumn("_rn", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy(F.col("_order").asc_nulls_last())))
    return ranked.where("_rn > 1").select(*carry).unionByName(finals.where("_rn > 1").select(*carry))


def deletion_vectors(lost: DataFrame) -> DataFrame:
    """(file, bucket, bits) of rows (file, position). Each bitmap has a fixed 4 KB; partial bitmaps are merged before the shuffle."""
    place = F.col("position") + 1
    return lost.groupBy("file", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def _choose(batches, root: str, columns: list[str], marked: bool):
    """Task side of the large path: reads only the vectors of the files in its own batches from the shared folder."""
    import numpy as np
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    vectors = None
    known: dict[int, dict[int, np.ndarray]] = {}
    for batch in batches:
        files = batch.column("_tessera_file")
        gone = np.zeros(batch.num_rows, dtype=bool)
        positions = batch.column("_tessera_position").to_numpy(zero_copy_only=False)
        ids = files.to_numpy(zero_copy_only=False)
        for f in np.unique(ids):
            if f not in known:
                vectors = vectors or ds.dataset(root, format="parquet", partitioning="hive")
                rows = vectors.to_table(filter=(pc.field("part") == int(f) % 1024) & (pc.field("file") == int(f)))
                known = {f: {b: np.unpackbits(np.frombuffer(x, dtype=np.uint8), bitorder="little") for b, x in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist())}}
            own = ids == f
            for b in np.unique(positions[own] // BITS):
                if (bits := known[f].get(int(b) + 1)) is not None:
                    at = np.flatnonzero(own & (positions // BITS == b))
                    gone[at] |= bits[positions[at] % BITS] == 1
        yield batch.filter(pa.array(gone if marked else ~gone)).select(columns)


def read_by_vectors(spark: SparkSession, path: str, vectors: DataFrame, marked: bool, columns: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table at `path`, only its marked rows or only the others, with all columns or the named ones; never shuffled.

    Vectors of up to `limit` measured bytes are broadcast; beyond that each task reads the vectors of its own files from the shared folder.
    """
    root = scratch(spark, "vectors")
    vectors.withColumn("part", F.pmod("file", F.lit(1024)).cast("int")).write.partitionBy("part").parquet(root)
    until_exit(spark, root)
    stored = spark.read.schema("file long, bucket long, bits binary, part int").parquet(root)
    size = stored.agg(F.sum(F.length("bits") + 24)).first()[0] or 0
    wide = spark.read.parquet(path)
    columns = columns or wide.columns
    wide = wide.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("_metadata.file_path").alias("_tessera_file"), F.col("_metadata.row_index").alias("_tessera_position"))
    if size > limit:
        kept = T.StructType([f for f in wide.schema.fields if not f.name.startswith("_tessera")])
        return wide.mapInArrow(partial(_choose, root=root, columns=columns, marked=marked), kept)
    place = F.col("_tessera_position") + 1
    bits = F.broadcast(stored.select(F.col("file").alias("_tessera_file"), F.col("bucket").alias("_tessera_bucket"), F.col("bits").alias("_tessera_bits")))
    offset = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_tessera_bits, cast(bitmap_bit_position(_tessera_position + 1) div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    joined = wide.withColumn("_tessera_bucket", F.bitmap_bucket_number(place)).join(bits, ["_tessera_file", "_tessera_bucket"], "inner" if marked else "left")
    gone = F.col("_tessera_bits").isNotNull() & (F.getbit(byte, (offset % 8).cast("int")) == 1)
    return joined.where(gone if marked else ~gone).select(*[F.col(f"`{c}`") for c in columns])


def lost_messages(df: DataFrame, carry: dict[str, Column]) -> DataFrame:
    return losers(df, message_identity(*[F.col(c) for c in ("server_id", "conversation_id", "local_id", "create_time")]), F.col("row_no"), carry)


def message_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Deletion vectors of the message table at `path`: every row of a message but the one with its lowest row_no, which is the delivery order."""
    places = {"file": F.xxhash64("_metadata.file_path"), "position": F.col("_metadata.row_index")}
    return deletion_vectors(lost_messages(spark.read.parquet(path), places))


def exactly_once(spark: SparkSession, path: str) -> DataFrame:
    """The message table at `path` with one row of each message: the one with the lowest row_no."""
    return read_by_vectors(spark, path, message_vectors(spark, path), False)


def surplus(spark: SparkSession, path: str) -> DataFrame:
    """row_no of the rows that the deletion vectors leave out of exactly_once."""
    return read_by_vectors(spark, path, message_vectors(spark, path), True, ["row_no"])
