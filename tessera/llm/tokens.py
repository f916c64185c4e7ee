"""The whole corpus as ids of a public tokenizer, by reuse of content-defined chunks.

Texts are cut where a rolling hash of the last characters says so, so equal passages give equal chunks wherever they stand. Chunks meet by
their hash and each distinct one is encoded once per task; then a text's chunks come together again and every join is repaired.

Why the result is exact. The tokenizer splits a text into pieces by a pattern that looks back at nothing, and encodes each piece by itself. Between
a letter, digit or mark and a character of another kind a piece always ends (but for the apostrophe of contractions and a blank before a word,
which never count here). Inside a chunk the ids between its first and last such border are those of the whole text; what lies before and after
is glued to the neighbouring chunk's part and encoded again, from sure border to sure border, over as many chunks as it takes.

Scale: one pass over the texts, one shuffle of chunk texts by chunk hash, one of ids (two bytes each) by document. A chunk that is frequent within a batch is
sent once for the batch with the list of its places, and spread over salts, so no task gets all copies of a hot chunk.

Defined cases: null and empty texts give an empty list; every row gives a row, repeated and null doc_ids too; further columns are ignored; texts of any
length are cut only by content; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import os
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the piece pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, CUT_BITS = 16, 8  # a border on average every 256 characters
HOT_IN_BATCH = 8
SALTS = 16
_KEPT: dict = {}

# Kinds of characters between which a piece surely ends: letters, digits, marks, blanks; 0 is anything that isn't listed.
_KIND = np.zeros(0x110000, dtype=np.uint8)
_KIND[0x4E00:0x9FA6] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[]^_`{|}~，。；：？！、（）']] = 3
_KIND[[ord(c) for c in " \n"]] = 4
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, WINDOW - i, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


def encoder(folder: str):
    """The tokenizer of a vocabulary file, one per worker process."""
    if folder not in _KEPT:
        import base64

        import tiktoken

        with open(os.path.join(folder, VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _KEPT[folder] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[folder].encode_ordinary


def cuts(codes: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Places after which the last WINDOW characters' hash calls for a cut; in steps, so that a text of any length takes bounded memory beside its own."""
    found = []
    for lo in range(0, len(codes) - WINDOW + 1, step):
        x = codes[lo : lo + step + WINDOW - 1].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        n = len(x) - WINDOW + 1
        h = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            h += x[i : i + n] * _FACTORS[i]
        found.append(np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW + lo)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def chunk(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All chunks in order, the text each belongs to, and its number there. An empty text is one empty chunk."""
    whole = "".join(texts)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = cuts(codes)
    doc = np.searchsorted(begin, at, side="right") - 1
    at = at[(at - WINDOW >= begin[doc]) & (at < begin[np.minimum(doc + 1, len(texts))])]  # windows within one text, no empty chunk
    filled = np.flatnonzero(lengths > 0)
    start = np.sort(np.concatenate([at, begin[filled]]))
    owner = np.searchsorted(begin, start, side="right") - 1
    end = np.concatenate([start[1:], begin[-1:]]) if len(start) else start
    out = [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]
    empty = np.flatnonzero(lengths == 0)
    out += [""] * len(empty)
    owner = np.concatenate([owner, empty])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    first = np.searchsorted(owner, owner)
    return [out[i] for i in order.tolist()], owner, np.arange(len(owner)) - first


def _chunks(batches):
    """(salt, text, rid, doc_id, seq): a row per distinct chunk of a slice, with its places."""
    import xxhash

    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        rids, ids = batch.column("rid").to_numpy(), batch.column("doc_id").to_pylist()
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size < 1 << 20 and i + 1 < len(texts):
                continue
            parts, owner, seq = chunk(texts[lo : i + 1])
            places: dict[str, list[int]] = {}
            for k, p in enumerate(parts):
                places.setdefault(p, []).append(k)
            row = owner + lo
            names, lists = list(places), list(places.values())
            flat = np.fromiter((k for x in lists for k in x), dtype=np.int64, count=len(parts))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            salts = [int(rids[lo]) % SALTS if len(x) >= HOT_IN_BATCH else 0 for x in lists]
            keys = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=s) - (1 << 63) for x, s in zip(names, salts)]
            make = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), make(rids[row[flat]], pa.int64()), make([ids[r] for r in row[flat].tolist()], pa.int64()), make(seq[flat].astype(np.int32), pa.int32())], names=["key", "text", "rid", "doc_id", "seq"])
            lo, size = i + 1, 0


def borders(codes: np.ndarray) -> np.ndarray:
    """Places where a piece surely ends, whatever stands around."""
    kind = _KIND[codes]
    return np.flatnonzero((kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[:-1] < 4) & (kind[1:] > 0)) + 1


def split_sure(text: str) -> tuple[str, str, str] | None:
    """Text before the first sure border, between first and last, and after the last; None without a border."""
    at = borders(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    return (text[: at[0]], text[at[0] : at[-1]], text[at[-1] :]) if len(at) else None


def _encode_chunks(batches, folder: str, room: int = 64 << 20):
    """Encode each distinct chunk once (while it is among the last `room` bytes) and send it to its places."""
    encode = encoder(folder)
    done: dict[str, tuple] = {}
    used = 0
    for batch in batches:
        head, middle, tail = [], [], []
        for t in batch.column("text").to_pylist():
            if (e := done.get(t)) is None:
                sure = split_sure(t)
                e = (t, None, "") if sure is None else (sure[0], np.array(encode(sure[1]), dtype=np.uint16).tobytes(), sure[2])
                used += 4 * len(t) + 200
                if used > room:
                    done.clear()
                    used = 0
                done[t] = e
            head.append(e[0])
            middle.append(e[1])
            tail.append(e[2])
        seq = batch.column("seq")
        of = pc.list_parent_indices(seq)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid").flatten(), batch.column("doc_id").flatten(), seq.flatten(), pa.array(head, pa.string()).take(of), pa.array(middle, pa.binary()).take(of), pa.array(tail, pa.string()).take(of)],
            names=["rid", "doc_id", "seq", "head", "ids", "tail"],
        )


def join_chunks(chunks, encode) -> np.ndarray:
    """Ids of a text from its chunks (head, ids or None, tail): repair every join by encoding it anew from sure border to sure border."""
    out, open_text = [], ""
    for head, ids, tail in chunks:
        open_text += head
        if ids is None:
            continue  # no sure border in this chunk: the repair goes on in the next
        if open_text:
            out.append(np.array(encode(open_text), dtype=np.uint16))
        out.append(np.frombuffer(ids, dtype=np.uint16))
        open_text = tail
    if open_text:
        out.append(np.array(encode(open_text), dtype=np.uint16))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


def _assemble(batches, folder: str, counts: bool):
    encode = encoder(folder)
    kind = pa.int64() if counts else pa.list_(pa.int32())

    def flush(docs, found):
        if counts:
            values = pa.array([len(x) for x in found], pa.int64())
        else:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), values.cast(kind)], names=["doc_id", "n_tokens" if counts else "ids"])

    now, doc, open_chunks = None, None, []
    for batch in batches:
        docs, found = [], []
        for rid, doc_id, head, ids, tail in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "head", "ids", "tail"))):
            if rid != now and now is not None:
                docs.append(doc)
                found.append(join_chunks(open_chunks, encode))
                open_chunks = []
            now, doc = rid, doc_id
            open_chunks.append((head, ids, tail))
        if docs:
            yield flush(docs, found)
    if now is not None:
        yield flush([doc], [join_chunks(open_chunks, encode)])


def _tokens(docs: DataFrame, folder: str, counts: bool) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = rows.mapInArrow(_chunks, "key long, text string, rid array<long>, doc_id array<long>, seq array<int>")
    parts = chunks.repartition("key").mapInArrow(partial(_encode_chunks, folder=folder), "rid long, doc_id long, seq int, head string, ids binary, tail string")
    whole = parts.repartition("rid").sortWithinPartitions("rid", "seq")
    return whole.mapInArrow(partial(_assemble, folder=folder, counts=counts), "doc_id long, n_tokens long" if counts else "doc_id long, ids array<int>")


def token_ids(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""
    return _tokens(docs, folder, False)


def _count(batches, folder: str, keep: list[str]):
    encode = encoder(folder)
    for batch in batches:
        n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])


def token_counts(docs: DataFrame, keep: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """keep... and n_tokens of every row, without a shuffle."""
    narrow = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text") + ", n_tokens long"
    return narrow.mapInArrow(partial(_count, folder=folder, keep=keep), schema)
