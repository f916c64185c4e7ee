"""Personal information in free text: found by a conditional random field, replaced by typed placeholders.

The field (crf.py) is trained once from the small labelled table (pii_labels.py) and travels to the tasks with its weights, a few MB that do not grow with the data. Rows are tagged in Arrow batches without a shuffle. An exact check follows: a piece must have what its kind can't lack.

Defined cases: null and empty texts have nothing to find and stay as they are; texts of any length are tagged whole (beyond half a million characters in overlapping parts); a piece has one kind; repeated rows
give one row each in `tag` and one in `found`; null parts of a row's key are empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import shared_dir
from tessera.llm.crf import VERSION, Tagger
from tessera.llm.pii_labels import KINDS, ROWS, labelled_table

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "name": "[NAME]"}
#: Taken off the unlabelled score in decoding.
LEAN = 1.5
#: Characters that neighbouring parts of a very long text share on each side; no piece is longer.
MARGIN = 1024
_KEPT: dict = {}


def tagger(rows: int = ROWS, spark: SparkSession | None = None) -> Tagger:
    """The trained field; `rows` is the size of the labelled table.

    It is trained once: a process keeps it, and the shared folder has its weights under the digest of the table and the field, for every later process that uses the folder.
    """
    if rows not in _KEPT:
        table = labelled_table(rows)
        model = Tagger(KINDS, lean=LEAN)
        path = None
        if spark is not None:
            digest = hashlib.sha256(repr((VERSION, LEAN, KINDS, table)).encode()).hexdigest()[:32]
            path = f"{shared_dir(spark).rstrip('/')}/tagger-{digest}.npz"
        if path is None or not _load(model, path):
            model.train(table)
            if path is not None:
                _store(model, path)
        _KEPT[rows] = model
    return _KEPT[rows]


def _load(model: Tagger, path: str) -> bool:
    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return False
    with store.open_input_file(at) as f:
        model.restore(np.load(io.BytesIO(f.read()), allow_pickle=False))
    return True


def _store(model: Tagger, path: str) -> None:
    store, at = fs.FileSystem.from_uri(path)
    own = f"{at}.{uuid.uuid4().hex}"
    data = io.BytesIO()
    np.savez(data, **model.weights())
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own) as f:
        f.write(data.getvalue())
    store.move(own, at)


_EMAIL = re.compile(r"[\w.+\-]\s?(?:[@＠]|[(\[]\s?at\s?[)\]]|\bat\b)\s?[\w\-]+\s?(?:\.|．|\bdot\b)\s?\w", re.IGNORECASE)
_STREET = re.compile(r"[路街巷道弄村里坊]|胡同|[0-9０-９][a-z]?\s+[a-z]{2}", re.IGNORECASE)


def _joined(x: str, y: str) -> bool:
    return bool(x and y) and x.isascii() and y.isascii() and x.isalnum() and y.isalnum()


def holds(kind: str, text: str, a: int, b: int) -> bool:
    """What a piece of each kind can't lack; numbers end where letters and digits end."""
    piece = text[a:b]
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return "\n" not in piece and _EMAIL.search(piece) is not None
    torn = _joined(text[a - 1 : a], piece[:1]) or _joined(piece[-1:], text[b : b + 1])
    if kind in ("phone", "id_number"):
        return 7 <= digits <= (16 if kind == "phone" else 18) and not torn
    if kind == "street_address":
        return digits >= 1 and _STREET.search(piece) is not None and not torn
    letters = [w for w in piece.replace(",", " ").split() if w]
    han = sum("㐀" <= c <= "鿿" for c in piece)
    return digits == 0 and (han >= 2 or len([w for w in letters if len(w.strip(".")) > 1]) >= 2)


def parts(text: str, most: int) -> list[tuple[int, int, int, int]]:
    """(begin, low, high, end) of the parts of a text: a part is seen from begin to end and answers for the pieces that begin from low to high.

    Parts overlap by MARGIN on both sides, more than any piece is long, so that a piece at a border is seen whole, with what stands around it.
    """
    cuts = list(range(0, max(len(text), 1), most))
    return [(max(0, lo - MARGIN), lo, min(lo + most, len(text)), min(lo + most + MARGIN, len(text))) for lo in cuts]


def pieces(model: Tagger, texts: list[str], room: int = 1 << 19):
    """(text number, start, end, kind) of all pieces, texts taken in slices of about `room` characters; a longer text is taken in several overlapping parts."""
    part: list[str] = []
    place: list[tuple[int, int, int, int]] = []  # text number, offset of each part, and the starts it answers for
    size = 0

    def flush():
        doc, start, end, kind = (x.tolist() for x in model.spans(part))
        for d, a, b, k in zip(doc, start, end, kind):
            number, offset, low, high = place[d]
            for line in part[d][a:b].split("\n"):  # a piece lies in one line
                first = a + len(line) - len(line.lstrip())
                last = first + len(line.strip())
                if low <= offset + first < high and holds(KINDS[k], part[d], first, last):
                    yield number, offset + first, offset + last, k
                a += len(line) + 1

    for i, text in enumerate(texts):
        for begin, low, high, end in parts(text, room):
            part.append(text[begin:end])
            place.append((i, begin, low, high))
            size += end - begin
            if size >= room:
                yield from flush()
                part, place, size = [], [], 0
    if part:
        yield from flush()


def _tag(batches, model: Tagger, keep: list[str]):
    for batch in batches:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        rows, kinds, occurrence, starts, ends = [], [], [], [], []
        last, seen = -1, [0] * len(KINDS)
        for d, a, b, k in pieces(model, texts):
            if d != last:
                last, seen = d, [0] * len(KINDS)
            seen[k] += 1
            rows.append(d)
            kinds.append(KINDS[k])
            occurrence.append(seen[k])
            starts.append(a)
            ends.append(b)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(kinds, pa.string()), pa.array(occurrence, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*keep, "kind", "occurrence", "start", "end"])


def tag(df: DataFrame, keep: dict[str, Column], text: Column) -> DataFrame:
    """keep..., kind, occurrence, start, end of each piece of personal information; start and end count code points."""
    narrow = df.where(text.isNotNull() & (text != "")).select(*[c.cast("string").alias(n) for n, c in keep.items()], text.alias("_text"))
    model = df.sparkSession.sparkContext.broadcast(tagger(spark=df.sparkSession))  # a model of fixed size
    fields = ", ".join(f"{n} string" for n in keep)
    return narrow.mapInArrow(partial(_tag_with, model=model, keep=list(keep)), f"{fields}, kind string, occurrence int, start int, end int")


def _tag_with(batches, model, keep):
    return _tag(batches, model.value, keep)


def _masked(batches, model, names: list[str]):
    for batch in batches:
        out = []
        for name in names:
            texts = batch.column(name).to_pylist()
            plain = [t or "" for t in texts]
            found: dict[int, list] = {}
            for d, a, b, k in pieces(model.value, plain):
                found.setdefault(d, []).append((a, b, k))
            for d, spans in found.items():
                for a, b, k in reversed(spans):
                    texts[d] = texts[d][:a] + PLACEHOLDERS[KINDS[k]] + texts[d][b:]
            out.append(pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in names), *out], names=[c for c in batch.schema.names if c not in names] + names)


def redact(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the personal information in the named columns replaced by placeholders; these columns come last."""
    from pyspark.sql import types as T

    model = df.sparkSession.sparkContext.broadcast(tagger(spark=df.sparkSession))
    ordered = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *names)
    return ordered.mapInArrow(partial(_masked, model=model, names=names), T.StructType(ordered.schema.fields))


def redacted(message: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of the chat tables with their texts redacted: tbl, and the columns of both tables, null where a table lacks one."""
    a = redact(message, ["message_content"]).withColumn("tbl", F.lit("message"))
    b = redact(rows, ["text", "quoted_text"]).withColumn("tbl", F.lit("synthetic_rows"))
    return a.unionByName(b, allowMissingColumns=True)


def found(message: DataFrame, rows: DataFrame) -> DataFrame:
    """(tbl, row_key, field_name, kind, occurrence), distinct, of the chat tables."""
    a = tag(message, {"row_key": F.col("row_no"), "field_name": F.lit("message_content")}, F.col("message_content")).withColumn("tbl", F.lit("message"))
    key = F.concat(F.coalesce("conversation_id", F.lit("")), F.lit("/"), F.coalesce("row_id", F.lit("")))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("text", "quoted_text")]))
    fields = rows.select(key.alias("row_key"), both.alias("f"))
    b = tag(fields, {"row_key": F.col("row_key"), "field_name": F.col("f.field_name")}, F.col("f.value")).withColumn("tbl", F.lit("synthetic_rows"))
    return a.unionByName(b).select("tbl", "row_key", "field_name", "kind", "occurrence").distinct()
