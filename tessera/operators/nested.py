"""Nested JSON into flat, linked tables by structural indexing.

Whole Arrow batches of texts are one byte buffer. Quote, bracket and delimiter bitmaps are built over it at once, strings are masked by the
parity of unescaped quotes, and nesting depth is a prefix sum of brackets. Sorting the structural bytes by depth puts every container's
delimiters next to one another, from which each value's span, key, place and parent follow without parsing a text by itself.

Defined cases: a text that is null, blank, cut off, not an object or list, or has mismatched brackets or empty slots, is unreadable and has no rows; a single value where the
path has a list counts as a list of one (place 0); nulls keep their place; the value null has no row; typed nested columns are indexed through to_json;
keys are compared exactly (escaped keys too); repeated keys of an object all count.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _COMMA, _COLON = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
for _c, _k in (("{", _OPEN), ("[", _OPEN), ("}", _CLOSE), ("]", _CLOSE), (",", _COMMA), (":", _COLON)):
    _KIND[ord(_c)] = _k
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True
_FIRST = np.zeros(256, dtype=bool)
_FIRST[[ord(c) for c in '"{[-0123456789tfn']] = True


class Index:
    """Structural index of a batch. Slots are the places of values: after a colon, or in a list after its bracket or a comma."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data = data
        n = len(data)
        quote = data == 34
        if (data == 92).any():
            # a quote is escaped if the run of backslashes before it is odd; only quotes after a backslash need the run
            at = np.flatnonzero(quote)
            behind = at[(at > 0) & (data[np.maximum(at - 1, 0)] == 92)]
            if len(behind):
                plain = np.flatnonzero(data != 92)
                before = np.searchsorted(plain, behind) - 1
                last = np.where(before >= 0, plain[np.maximum(before, 0)], -1)
                quote[behind[(behind - 1 - last) % 2 == 1]] = False
        quotes = np.flatnonzero(quote)
        kinds = _KIND[data]
        at = np.flatnonzero(kinds)
        seen = np.searchsorted(quotes, at)  # quotes before each structural byte
        doc = np.searchsorted(starts, at, side="right") - 1
        first = np.searchsorted(quotes, starts)
        outside = (seen - first[doc]) % 2 == 0
        self.pos, self.doc = at[outside], doc[outside]
        self.kind = kinds[self.pos]
        step = np.where(self.kind == _OPEN, 1, np.where(self.kind == _CLOSE, -1, 0))
        total = np.cumsum(step)
        before = np.concatenate([[0], total])
        begin = np.searchsorted(self.pos, starts)
        finish = np.searchsorted(self.pos, ends)
        base = before[begin]
        odd_quotes = (np.searchsorted(quotes, ends) - first) % 2 == 1
        inside = total - base[self.doc]
        self.depth = np.where(self.kind == _CLOSE, inside + 1, inside)
        good = (before[finish] == base) & ~odd_quotes & (finish > begin)
        np.logical_and.at(good, self.doc, self.depth >= 1)
        # the first structural byte opens the root and the last one closes it, with blanks only outside
        f, l = np.minimum(begin, len(self.pos) - 1), np.maximum(finish - 1, 0)
        if len(self.pos):
            good &= (self.kind[f] == _OPEN) & (self.kind[l] == _CLOSE) & (self._solid(starts, self.pos[f]) == 0) & (self._solid(self.pos[l] + 1, ends) == 0)
            root_only = np.zeros(len(starts), dtype=np.int64)
            np.add.at(root_only, self.doc, (self.kind == _OPEN) & (self.depth == 1))
            good &= root_only == 1
        self.order = np.argsort(self.depth, kind="stable")
        self.o_pos, self.o_kind, self.o_depth, self.o_doc = self.pos[self.order], self.kind[self.order], self.depth[self.order], self.doc[self.order]
        m = len(self.o_pos)
        index = np.arange(m)
        is_open = self.o_kind == _OPEN
        self.open_of = np.maximum.accumulate(np.where(is_open, index, 0)) if m else index
        commas = np.cumsum(self.o_kind == _COMMA)
        self.place = commas - commas[self.open_of] if m else commas
        opener = data[self.o_pos[self.open_of]] if m else data[:0]
        closes = self.o_kind == _CLOSE
        bad = closes & (data[self.o_pos] != opener + 2)
        in_list = opener == ord("[")
        self.slot = np.flatnonzero((~in_list & (self.o_kind == _COLON)) | (in_list & (is_open | (self.o_kind == _COMMA))))
        self.start, self.end = self._strip(self.o_pos[self.slot] + 1, self.o_pos[np.minimum(self.slot + 1, m - 1)] if m else self.o_pos)
        empty_list = (self.o_kind[self.slot] == _OPEN) & (self.end <= self.start) & (self.o_kind[np.minimum(self.slot + 1, m - 1)] == _CLOSE)
        wrong = (~empty_list) & ((self.end <= self.start) | ~_FIRST[data[np.minimum(self.start, n - 1)]])
        # in an object keys and colons alternate: a comma or bracket is followed by a colon unless the object is empty
        follows = np.concatenate([self.o_kind[1:], [0]]) if m else self.o_kind
        lead = ~in_list & (is_open | (self.o_kind == _COMMA)) & (follows != _COLON)
        lead &= ~(is_open & (follows == _CLOSE))
        for mask, who in ((bad, self.o_doc), (lead, self.o_doc)):
            good[who[mask]] = False
        good[self.o_doc[self.slot[wrong]]] = False
        keep = ~empty_list & good[self.o_doc[self.slot]]
        self.slot, self.start, self.end = self.slot[keep], self.start[keep], self.end[keep]
        self.good = good
        self.sorted_key = self.o_depth.astype(np.int64) * (n + 1) + self.o_pos
        self.n = n

    def _solid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that are no blanks in each [a, b)."""
        if not hasattr(self, "_dense"):
            self._dense = np.concatenate([[0], np.cumsum(~_BLANK[self.data])])
        return self._dense[np.maximum(a, b)] - self._dense[a]

    def _strip(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = a.copy(), b.copy()
        while len(a) and (more := (a < b) & _BLANK[self.data[np.minimum(a, len(self.data) - 1)]]).any():
            a[more] += 1
        while len(a) and (more := (a < b) & _BLANK[self.data[np.maximum(b - 1, 0)]]).any():
            b[more] -= 1
        return a, b

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Root containers (places in depth order) and their documents."""
        at = np.flatnonzero((self.o_kind == _OPEN) & (self.o_depth == 1))
        at = at[self.good[self.o_doc[at]]]
        return at, self.o_doc[at]

    def container(self, slots: np.ndarray) -> np.ndarray:
        """The container that fills each slot (place in depth order), -1 where the value is a scalar."""
        a = self.start[slots]
        holds = np.isin(self.data[a], (123, 91))
        key = (self.o_depth[self.slot[slots]].astype(np.int64) + 1) * (self.n + 1) + a
        return np.where(holds, np.searchsorted(self.sorted_key, key), -1)

    def key_is(self, slots: np.ndarray, name: str) -> np.ndarray:
        """Whether the object key of each slot is `name`."""
        tok = self.slot[slots]
        a, b = self._strip(self.o_pos[tok - 1] + 1, self.o_pos[tok])
        want = np.frombuffer(json.dumps(name, ensure_ascii=False).encode(), dtype=np.uint8)
        same = b - a == len(want)
        at = np.flatnonzero(same)
        for i, w in enumerate(want):
            at = at[self.data[a[at] + i] == w]
        out = np.zeros(len(slots), dtype=bool)
        out[at] = True
        size = b - a
        for i in np.flatnonzero(~out & (size > len(want))):  # keys written with escapes
            text = self.data[a[i] : b[i]]
            if (text == 92).any():
                try:
                    out[i] = json.loads(text.tobytes()) == name
                except ValueError:
                    pass
        return out

    def walk(self, path: str):
        """Slots of the values at a path such as `a[].b.c[]`: (documents, places in the first list, in the second, slots). A [] takes a list's items, or a single value."""
        root, docs = self.roots()
        of_slot = self.open_of[self.slot]  # container of each slot
        order = np.argsort(of_slot, kind="stable")
        ranked = of_slot[order]
        steps = [s for part in path.split(".") for s in ([part[:-2], "[]"] if part.endswith("[]") else [part]) if s]
        # state: containers or scalars by slot; the root is a container without slot
        cont, slot, doc = root, np.full(len(root), -1), docs
        places = np.full((len(root), 2), -1)
        lists = 0
        for s in steps:
            is_list = (cont >= 0) & (self.data[self.o_pos[np.maximum(cont, 0)]] == 91) if len(self.o_pos) else cont >= 0
            if s == "[]":
                single = np.flatnonzero(~is_list)
                many = np.flatnonzero(is_list)
            else:
                single = np.zeros(0, dtype=np.int64)
                many = np.flatnonzero((cont >= 0) & ~is_list)
            lo, hi = np.searchsorted(ranked, cont[many]), np.searchsorted(ranked, cont[many], side="right")
            count = hi - lo
            parent = np.repeat(many, count)
            inner = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())] if len(many) else np.zeros(0, dtype=np.int64)
            new_places = places[parent].copy()
            if s == "[]":
                new_places[:, lists] = self.place[self.slot[inner]]
                alone = places[single].copy()
                alone[:, lists] = 0
                slot = np.concatenate([slot[single], inner])
                doc = np.concatenate([doc[single], doc[parent]])
                places = np.concatenate([alone, new_places])
                cont = np.concatenate([cont[single], self.container(inner)])
                lists += 1
            else:
                hit = self.key_is(inner, s)
                slot, doc, places = inner[hit], doc[parent[hit]], new_places[hit]
                cont = self.container(slot)
        return doc, places[:, 0], places[:, 1], slot

    def values(self, slots: np.ndarray) -> list[str | None]:
        """Each slot's value as text: strings decoded, null as None, anything else as written."""
        out: list[str | None] = []
        raw = self.data.tobytes() if len(slots) else b""
        for a, b in zip(self.start[slots].tolist(), self.end[slots].tolist()):
            text = raw[a:b]
            if text[:1] == b'"':
                try:
                    out.append(json.loads(text) if b"\\" in text else text[1:-1].decode())
                except ValueError:
                    out.append(None)
            else:
                out.append(None if text == b"null" else text.decode())
        return out


def index_batch(texts: pa.Array) -> Index:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    return Index(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _rows(batches, paths: dict[str, str], keep: list[str], schema: pa.Schema, slice_bytes: int = 8 << 20):
    for batch in batches:
        size = max(1, batch.column("_json").nbytes)
        step = max(1, batch.num_rows * slice_bytes // size)
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            index = index_batch(part.column("_json"))
            for name, path in paths.items():
                doc, pos, subpos, slot = index.walk(path)
                values = index.values(slot)
                there = np.array([v is not None for v in values], dtype=bool)
                at = pa.array(doc[there])
                columns = [part.column(k).take(at) for k in keep]
                columns += [pa.array([name] * int(there.sum()), pa.string()), pa.array(pos[there], pa.int32()), pa.array(subpos[there], pa.int32()), pa.array([v for v in values if v is not None], pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def extract(df: DataFrame, text: Column, keep: dict[str, Column], paths: dict[str, str]) -> DataFrame:
    """Rows (keep..., path, pos, subpos, value): each non-null value at one of the paths. pos and subpos are places in the path's first and second list, else -1."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = df.select(*[c.alias(n) for n, c in keep.items()], text.alias("_json"))
    out = T.StructType([narrow.schema[k] for k in keep] + [T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("subpos", T.IntegerType()), T.StructField("value", T.StringType())])
    return narrow.mapInArrow(partial(_rows, paths=paths, keep=list(keep), schema=to_arrow_schema(out)), out)


#: Paths of the flat tables.
EVENT_TIMES = {"events.asserted_event_time.value": "[].asserted_event_time.value"}
EVENT_EVIDENCE = {"events.evidence_ids": "[].evidence_ids[]"}
CLAIM_STATUS = {"self_model.calibration.status": "self_model[].calibration.status"}


def found(episodes: DataFrame, assets: DataFrame) -> DataFrame:
    """(root_table, root_key, path, pos, subpos): each value that is neither null nor empty, once."""
    a = extract(episodes, F.to_json("events"), {"root_key": F.col("route_id")}, EVENT_TIMES | EVENT_EVIDENCE).withColumn("root_table", F.lit("routed_episodes"))
    b = extract(assets, F.col("body"), {"root_key": F.col("package_id")}, CLAIM_STATUS).withColumn("root_table", F.lit("assets"))
    return a.unionByName(b).where("value != ''").select("root_table", "root_key", "path", "pos", "subpos").distinct()


#: Fields of the flat tables, by path below the parent.
EVENT_FIELDS = ("subject", "disposition", "title", "summary", "importance", "asserted_event_time.value", "asserted_event_time.precision")
CLAIM_FIELDS = ("asset_id", "layer", "statement", "confidence", "calibration.status", "calibration.behavior_change")
NUMBERS = {"importance"}


def delivered(df: DataFrame, key: str, when: str, text: Column) -> DataFrame:
    """(key, version, _json): one delivered row of each key, the first by `when`, then by the hash of its text; rows with a null key stay, each text by itself."""
    rows = df.select(key, F.col(when).alias("_when"), text.alias("_json")).withColumn("version", F.xxhash64("_json"))
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("_when", "version")).alias("_first")).select(key, F.col("_first._when").alias("_when"), F.col("_first.version").alias("version"))
    match = [rows[key] == first[key], rows["_when"].eqNullSafe(first["_when"]), rows["version"] == first["version"]]
    kept = rows.join(first, match[0] & match[1] & match[2], "left_semi")
    return kept.select(key, "version", "_json").unionByName(rows.where(F.col(key).isNull()).select(key, "version", "_json"))


def flat_tables(episodes: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """Related tables: events, evidence and place links below routes, claims, scenarios' and cases' evidence below packages; every row names its parent's key and place.

    Of several delivered rows with one key the first decides, so a table's row never mixes two versions of its parent.
    """
    routes = delivered(episodes, "route_id", "routed_at", F.to_json("events"))
    packages = delivered(assets, "package_id", "built_at", F.col("body"))

    def below(rows: DataFrame, key: str, paths: dict[str, str]) -> DataFrame:
        return extract(rows, F.col("_json"), {key: F.col(key), "version": F.col("version")}, paths)

    def wide(rows: DataFrame, key: str, fields: tuple[str, ...], at: str) -> DataFrame:
        found = below(rows, key, {f: f"{at}[].{f}" for f in fields})
        pick = lambda f: F.min(F.when(F.col("path") == f, F.col("value")))  # noqa: E731  # copies of a row agree, so this is its one value
        picks = [(pick(f).try_cast("double") if f in NUMBERS else pick(f)).alias(f.replace(".", "_")) for f in fields]
        return found.groupBy(key, "version", "pos").agg(*picks).drop("version")

    def links(rows: DataFrame, key: str, path: str, parent: str, name: str) -> DataFrame:
        found = below(rows, key, {"x": path}).distinct()
        return found.select(key, F.col("pos").alias(parent), F.col("subpos").alias("pos"), F.col("value").alias(name))

    return {
        "events": wide(routes, "route_id", EVENT_FIELDS, ""),
        "evidence_links": links(routes, "route_id", "[].evidence_ids[]", "event_pos", "evidence_id"),
        "place_links": links(routes, "route_id", "[].place_ids[]", "event_pos", "place_id"),
        "claims": wide(packages, "package_id", CLAIM_FIELDS, "self_model"),
        "scenario_evidence": links(packages, "package_id", "voice.scenarios[].evidence_ids[]", "scenario_pos", "evidence_id"),
        "case_evidence": links(packages, "package_id", "evaluation_cases[].evidence_ids[]", "case_pos", "evidence_id"),
    }
