"""Byte-budget packets, oversize records in parts, and text chunks: sequential by nature, so they run per key in sorted Arrow streams."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDS = "\n。！？.!?"


def chunk_bounds(text: str, size: int = 1200, overlap: int = 160) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `size` characters that share `overlap`; a sentence or line end in the last 35 % is preferred."""
    if size < 32 or not 0 <= overlap < size:
        raise ValueError("invalid chunk size or overlap")
    out, start = [], 0
    if not text or not text.strip():
        return out
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            least = start + max(overlap + 1, size * 65 // 100)
            cut = max(text.rfind(c, least, end) for c in ENDS)
            end = cut + 1 if cut >= 0 else end
        if text[start:end].strip():
            out.append((start, end))
        if end == len(text):
            return out
        start = end - overlap


def _chunks(batches, keep: list[str], size: int, overlap: int):
    for batch in batches:
        rows, index, starts, ends, texts = [], [], [], [], []
        for i, t in enumerate(batch.column("_text").to_pylist()):
            for k, (a, b) in enumerate(chunk_bounds(t or "", size, overlap)):
                rows.append(i)
                index.append(k)
                starts.append(a)
                ends.append(b)
                texts.append(t[a:b])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(index, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=[*keep, "chunk_index", "start", "end", "chunk_text"])


def chunk_texts(df: DataFrame, text: str, keep: list[str], size: int = 1200, overlap: int = 160) -> DataFrame:
    """keep... with chunk_index, start, end, chunk_text; blank texts have no chunk."""
    chunk_bounds("x", size, overlap)
    narrow = df.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInArrow(partial(_chunks, keep=keep, size=size, overlap=overlap), f"{fields}, chunk_index int, start int, end int, chunk_text string")


def fixed_chunks(df: DataFrame, text: str, keep: list[str], size: int = 1200, overlap: int = 160) -> DataFrame:
    """Chunks of fixed size without looking for sentence ends, on the JVM."""
    step = size - overlap
    length = F.length(text)
    starts = F.when(length > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), length - overlap - 1), F.lit(step)))
    x = df.select(*keep, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_index", "start"))
    return x.select(*keep, "chunk_index", "start", F.least(F.col("start") + size, F.length("_t")).alias("end"), F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("chunk_text"))


def split_parts(text: str, room: int) -> list[str]:
    """Longest prefixes of at most `room` UTF-8 bytes, one after the other; at least a character each."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(at + room, len(raw))
        while end < len(raw) and end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            raise ValueError("the budget can't hold a character")
        out.append(raw[at:end].decode())
        at = end
    return out


def compact(df: DataFrame, key: str, text: str, budget: int, overhead: int = 64) -> DataFrame:
    """(key, part_index, part_count, part): records whose text exceeds the budget in parts that join again exactly; others whole."""
    @F.pandas_udf("array<string>")
    def parts(values):
        return values.map(lambda t: split_parts(t, budget - overhead) if t else [""])

    split = df.select(key, parts(F.coalesce(F.col(text), F.lit(""))).alias("p"))
    return split.select(key, F.posexplode("p").alias("part_index", "part"), F.size("p").alias("part_count")).select(key, "part_index", "part_count", "part")


def _pack(batches, budget: int, keep: list[str]):
    group, packet, used = object(), 0, 0
    for batch in batches:
        numbers = []
        for g, n in zip(batch.column("_group").to_pylist(), batch.column("_size").to_pylist()):
            if g != group:
                group, packet, used = g, 0, 2
                used += n
            elif used + n + 1 > budget:
                packet += 1
                used = 2 + n
            else:
                used += n + 1
            numbers.append(packet)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(numbers, pa.int64())], names=[*keep, "packet"])


def pack(df: DataFrame, group: str, order: list[str], size: str, budget: int, keep: list[str]) -> DataFrame:
    """keep... with packet: records of a group in order, greedily into packets of at most `budget` bytes (2 for the brackets, 1 per comma).

    A packet's fill depends on the one before, so a group is one sorted stream; memory holds one batch, never a group.
    """
    shaped = df.select(*keep, F.col(group).alias("_group"), F.col(size).alias("_size"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    placed = shaped.repartition("_group").sortWithinPartitions("_group", *[f"_o{i}" for i in range(len(order))])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema if f.name in keep)
    return placed.mapInArrow(partial(_pack, budget=budget, keep=keep), f"{fields}, packet long")
