"""Long exact spans shared between records, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks; any common run of `min_chars` holds a whole block of either text. The blocks'
hashes become a filter of raw bit files in the shared folder, one per group of hashes; tasks map these files into memory, so that a machine holds one
copy, in its page cache, and neither the driver nor a worker holds the filter. Every rolling window of every text probes the filter; only hits and blocks become rows. Rows that meet on a hash are candidate pairs of
distinct texts (equal texts are one), one row per pair and diagonal, and are extended character by character to the maximal exact repeat. Portions need no pairs
where many texts meet: there the shared windows themselves are counted.

Scale: the text is read twice and never shuffled as a whole; shuffles carry one narrow row per block and hit, and the text around candidates.
Periodic texts: of overlapping equal windows all near either end of their chain are kept and one per block length between, which loses no span
(an extension of one block length on each side decides).

Defined cases: null texts and texts shorter than min_chars share nothing; rows with a null doc_id are left out; repeated rows with one doc_id are one
document per distinct text; equal texts of at least min_chars are a pair; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import BROADCAST_BYTES, hash_pair, hot_buckets, make_folder, salted_join, scratch, stage, unstage

MIN_CHARS = 160
_R = 6364136223846793005
_RINV = pow(_R, -1, 1 << 64)
_STEP = 1 << 20
#: Bits of one filter group: 8 MB, or more so that there are about 16 groups, up to 256 MB (which bounds what the task that builds one holds).
GROUP_BITS = (1 << 26, 1 << 31)
GROUPS = 16
BITS_PER_BLOCK = 16
GROUP_MOST = 64
#: Anchors of one group in one task of the join of pairs.
GROUP_ROWS = 1024
AROUND = 4
_CACHE: dict = {}


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _CACHE or len(_CACHE["powers"][0]) < n:
        n = max(n, _STEP + 4096)
        one = np.ones(1, dtype=np.uint64)
        grow = lambda r: np.concatenate([one, np.cumprod(np.full(n - 1, r, dtype=np.uint64))])
        _CACHE["powers"] = (grow(_R), grow(_RINV))
    return _CACHE["powers"]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` code points, by a rolling polynomial over mixed code points, modulo 2^64."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[: len(codes)], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * inverse[:n])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each begins (with the end)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _slices(batch: pa.RecordBatch, chars: int = 1 << 20):
    """(rows, texts) of a batch in slices of about `chars` characters."""
    texts = batch.column("text").to_pylist()
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield range(lo, i + 1), texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield range(lo, len(texts)), texts[lo:]


def _windows(texts: list[str], size: int, around: int = 0, step: int = 0):
    """Pieces (text number, position, hash, context) of all windows that lie within one text.

    context has, per window, 32-bit hashes of the AROUND windows of `around` characters that begin 0, 1, 2 ... steps before it; 0 where the text is too short.
    """
    codes, at = _codes(texts)
    for lo in range(0, len(codes), _STEP):
        back = min(lo, (AROUND - 1) * step)
        part = codes[lo - back : lo + _STEP + max(size, around) - 1]
        hashes = window_hashes(codes[lo : lo + _STEP + size - 1], size)
        place = np.arange(lo, lo + len(hashes))
        doc = np.searchsorted(at, place, side="right") - 1
        inside = place + size <= at[doc + 1]
        doc, place, hashes = doc[inside], place[inside], hashes[inside]
        yield doc, place - at[doc], hashes, partial(_context, part, lo - back, at, around, step) if around else None


def _context(part: np.ndarray, base: int, at: np.ndarray, around: int, step: int, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    wide = window_hashes(part, around)
    out = np.zeros((AROUND, len(doc)), dtype=np.int32)
    if not len(wide):
        return out
    for k in range(AROUND):
        start = at[doc] + pos - k * step
        ok = (pos >= k * step) & (start + around <= at[doc + 1])
        h = wide[np.clip(start - base, 0, len(wide) - 1)]
        out[k] = np.where(ok, (h >> np.uint64(33)).astype(np.int32) | 1, 0)
    return out


def filter_shape(blocks: int) -> tuple[int, int]:
    """(groups, bits of a group) of the filter over so many blocks."""
    need, bits = blocks * BITS_PER_BLOCK, GROUP_BITS[0]
    while bits < GROUP_BITS[1] and bits * GROUPS < need:
        bits *= 2
    return max(1, -(-need // bits)), bits


def _bit_places(hashes: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Filter group of each hash, and the four bits it sets there."""
    group = (hashes % np.uint64(shape[0])).astype(np.int64)
    mask = np.uint64(shape[1] - 1)
    other = _mix(hashes + np.uint64(0x632BE59BD9B4E019))
    return group, [((hashes >> np.uint64(20)) & mask).astype(np.int64), (other & mask).astype(np.int64), ((other >> np.uint64(30)) & mask).astype(np.int64), ((hashes + other * np.uint64(3)) >> np.uint64(11) & mask).astype(np.int64)]


def _emit_blocks(batches, size: int, groups: int):
    for batch in batches:
        for _, texts in _slices(batch):
            for _, pos, h, _ in _windows(texts, size):
                h = h[pos % size == 0]
                yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(groups)).astype(np.int32)), pa.array(h.view(np.int64))], names=["grp", "h"])


def _fold_groups(batches, shape: tuple[int, int], root: str):
    """Write the bit file of each filter group in this partition; a group's blocks are all here. A task that runs again writes the same file."""
    import os
    import uuid

    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root)
    filters: dict[int, np.ndarray] = {}
    for batch in batches:
        hashes = batch.column("h").to_numpy().view(np.uint64)
        group, places = _bit_places(hashes, shape)
        for g in np.unique(group):
            bits = filters.setdefault(int(g), np.zeros(shape[1] // 8, dtype=np.uint8))
            own = group == g
            for p in places:
                p = p[own]
                np.bitwise_or.at(bits, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
    for g, bits in filters.items():
        own = os.path.join(folder, f".{g}.{uuid.uuid4().hex}")
        with store.open_output_stream(own) as f:
            f.write(bits.tobytes())
        store.move(own, os.path.join(folder, f"{g}.bits"))
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32())], names=["grp"])


def _load_group(root: str, group: int) -> np.ndarray | None:
    """One group's bits: mapped where the shared folder is mounted, else read, of which a worker keeps two."""
    import os

    from pyarrow import fs

    kept = _CACHE.setdefault("groups", {})
    if (root, group) not in kept:
        store, folder = fs.FileSystem.from_uri(root)
        path = os.path.join(folder, f"{group}.bits")
        if isinstance(store, fs.LocalFileSystem):
            if any(r != root for r, _ in kept):
                kept.clear()
            kept[root, group] = np.memmap(path, dtype=np.uint8, mode="r") if os.path.exists(path) else None
        else:
            while len(kept) >= 2:
                kept.pop(next(iter(kept)))
            there = store.get_file_info(path).type == fs.FileType.File
            kept[root, group] = np.frombuffer(store.open_input_file(path).read(), dtype=np.uint8) if there else None
    return kept[root, group]


def _pass(hashes: np.ndarray, root: str, shape: tuple[int, int]) -> np.ndarray:
    group, places = _bit_places(hashes, shape)
    ok = np.zeros(len(hashes), dtype=bool)
    order = np.argsort(group, kind="stable") if shape[0] > 1 else np.arange(len(hashes))
    edges = np.searchsorted(group[order], np.arange(shape[0] + 1)) if shape[0] > 1 else [0, len(hashes)]
    for g in range(shape[0]):
        at = order[edges[g] : edges[g + 1]]
        bits = _load_group(root, g) if len(at) else None
        if bits is None:
            continue
        for p in places:
            p = p[at]
            at = at[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        ok[at] = True
    return ok


def _thin(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, aligned: np.ndarray, size: int) -> np.ndarray:
    """Which hits to keep: all but those deep inside a chain of overlapping equal windows, of which one per block length stays."""
    order = np.lexsort((pos, h, doc))
    d, p, x = doc[order], pos[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (p[1:] - p[:-1] >= size)
    if new.all():
        return np.ones(len(doc), dtype=bool)
    chain = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    first, last = p[begin][chain], p[np.concatenate([begin[1:], [len(p)]]) - 1][chain]
    bucket = (p - first) // size
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = new[1:] | (bucket[1:] != bucket[:-1])
    keep = np.zeros(len(doc), dtype=bool)
    keep[order] = (p - first < 2 * size) | (last - p < 2 * size) | fresh
    return keep | aligned


def _probe(batches, size: int, shape: tuple[int, int], root: str, around: int, step: int):
    for batch in batches:
        t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
        for rows, texts in _slices(batch):
            pieces = []
            for doc, pos, h, context in _windows(texts, size, around, step):
                ok = _pass(h, root, shape)
                doc, pos, h = doc[ok], pos[ok], h[ok]
                pieces.append((doc, pos, h, *context(doc, pos)))
            if not pieces:
                continue
            doc, pos, h, *near = (np.concatenate(x) for x in zip(*pieces))
            keep = _thin(doc, pos, h, pos % size == 0, size) & (sum(c != 0 for c in near) > 0)
            doc, pos, h, near = doc[keep] + rows.start, pos[keep], h[keep], [c[keep] for c in near]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t1[doc]), pa.array(t2[doc]), pa.array(pos.astype(np.int32)), *map(pa.array, near)], names=["h", "t1", "t2", "pos", *(f"c{k}" for k in range(AROUND))])


def _full_windows(batches, step: int, min_chars: int):
    """For each hit (pos, k, h) of a text: hashes of the windows of min_chars characters around pos that hold its window k. A text comes once, with all its hits."""
    for batch in batches:
        for a, b, text, hits in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "hits"))):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at, keys, size = [], [], 0
            for x in hits:
                pos, k, h = x["pos"], x["k"], x["h"]
                lead = np.arange(k * step, (k + 1) * step + 1)
                lead = lead[(pos - lead >= 0) & (pos - lead + min_chars <= len(codes))]
                if not len(lead):
                    continue
                low = pos - int(lead[-1])
                full = window_hashes(codes[low : pos - int(lead[0]) + min_chars], min_chars)[::-1]
                at.append(np.full(len(lead), pos, dtype=np.int32))
                keys.append(_mix(full + np.uint64(h & 0xFFFFFFFFFFFFFFFF) + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                size += len(lead)
                if size > 1 << 18:
                    yield _hashed(keys, a, b, at)
                    at, keys, size = [], [], 0
            if size:
                yield _hashed(keys, a, b, at)


def _hashed(keys: list[np.ndarray], a: int, b: int, at: list[np.ndarray]) -> pa.RecordBatch:
    g, pos = np.concatenate(keys).view(np.int64), np.concatenate(at)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), a)), pa.array(np.full(len(g), b)), pa.array(pos)], names=["g", "t1", "t2", "pos"])


def _covering_windows(batches, step: int, min_chars: int):
    """Each window of min_chars characters that holds a hit of its text, once: two hashes, and where it begins."""
    for batch in batches:
        for a, b, text, hits in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "hits"))):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            last = len(codes) - min_chars
            wanted = np.zeros(last + 2, dtype=np.int32)
            for x in hits:
                low, high = max(0, x["pos"] - (x["k"] + 1) * step), min(last, x["pos"] - x["k"] * step)
                if low <= high:
                    wanted[low] += 1
                    wanted[high + 1] -= 1
            starts = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            for lo in range(0, len(starts), 1 << 18):
                part = starts[lo : lo + (1 << 18)]
                own = codes[part[0] : part[-1] + min_chars]
                pick = part - part[0]
                one, two = window_hashes(own, min_chars)[pick], window_hashes(own ^ np.uint32(0x5BD1E995), min_chars)[pick]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(part), a)), pa.array(np.full(len(part), b)), pa.array(part.astype(np.int32))], names=["g", "g2", "t1", "t2", "pos"])


def _grow(batches, size: int, min_chars: int):
    """Extend each candidate run over its contexts; rows of spans of at least min_chars."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("a_at", "b_at", "n", "a_text", "b_text", "a_lead", "b_lead")}
        keep, a_start, b_start, length = [], [], [], []
        for i, (a_at, b_at, n, a, b, la, lb) in enumerate(zip(*cols.values())):
            if a[la : la + n] != b[lb : lb + n]:
                continue  # equal hashes, other text
            left = 0
            while left < la and left < lb and a[la - 1 - left] == b[lb - 1 - left]:
                left += 1
            x, y, right = a[la + n :], b[lb + n :], 0
            most = min(len(x), len(y))
            while right < most and x[right] == y[right]:
                right += 1
            if left + n + right >= min_chars:
                keep.append(i)
                a_start.append(a_at - left)
                b_start.append(b_at - left)
                length.append(left + n + right)
        at = pa.array(keep, pa.int64())
        ids = [batch.column(c).take(at) for c in ("a1", "a2", "b1", "b2")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(a_start, pa.int64()), pa.array(b_start, pa.int64()), pa.array(length, pa.int64())], names=["a1", "a2", "b1", "b2", "a_start", "b_start", "n_chars"])


def _texts(docs: DataFrame, min_chars: int) -> DataFrame:
    t1, t2 = hash_pair(F.col("text"))
    return docs.where("doc_id is not null and text is not null").where(F.length("text") >= min_chars).select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")


def _of_texts(bare: DataFrame, who: DataFrame) -> DataFrame:
    """The texts (t1, t2, text) named by who, once each. Their names are broadcast only while their measured size is bounded."""
    who = stage(who.distinct(), "who")
    small = who.count() * 32 <= BROADCAST_BYTES
    return stage(bare.join(F.broadcast(who) if small else who, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]), "texts")


def _candidates(docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(few, many, staged): hits of texts that agree on an anchor and around it, in groups of up to GROUP_MOST rows and in larger ones."""
    spark = docs.sparkSession
    size = min_chars // 2
    bare = _texts(docs, min_chars).select("t1", "t2", "text")
    # 1. the filter over all reference blocks, its size from their exact number
    blocks = docs.where("doc_id is not null and text is not null").agg(F.sum(F.floor(F.length("text") / size))).first()[0] or 0
    shape = filter_shape(blocks)
    root = scratch(spark, "blocks")
    make_folder(spark, root)
    hashes = bare.select("text").mapInArrow(partial(_emit_blocks, size=size, groups=shape[0]), "grp int, h long")
    hashes.repartition(min(shape[0], 100_000), "grp").mapInArrow(partial(_fold_groups, shape=shape, root=root), "grp int").count()
    # 2. every window probes it; copies of a text give the same rows, once
    step = -(-size // AROUND)
    around = ", ".join(f"c{k} int" for k in range(AROUND))
    hits = bare.mapInArrow(partial(_probe, size=size, shape=shape, root=root, around=min_chars - step, step=step), f"h long, t1 long, t2 long, pos int, {around}")
    hits = stage(hits, "hits")
    # 3. hashes that an anchor of one text and a window of another share, and agreement around them
    several = _several(size)
    met = hits.groupBy("h").agg(*several).where("lo != hi and anchored").select("h")
    live = hits.join(met, "h", "left_semi").select("h", "t1", "t2", "pos", F.posexplode(F.array(*[f"c{k}" for k in range(AROUND)])).alias("k", "c")).where("c != 0")
    live = stage(live.select(F.xxhash64("h", "k", "c").alias("g"), "h", "k", "t1", "t2", "pos").distinct(), "live")
    agreeing = live.groupBy("g").agg(*several).where("lo != hi and anchored").select("g", "n")
    hot = hot_buckets(live, F.xxhash64("g"))
    members = stage(salted_join(live, agreeing, "g", hot, "inner"), "members")
    return members.where(F.col("n") <= GROUP_MOST).select("g", "t1", "t2", "pos", "n"), members.where(F.col("n") > GROUP_MOST), [hits, live, members]


def _several(size: int) -> list:
    return [F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.bool_or(F.col("pos") % size == 0).alias("anchored"), F.count("*").alias("n")]


def _hits_by_text(bare: DataFrame, many: DataFrame) -> DataFrame:
    """(t1, t2, text, hits): a text of the large groups once, with all its hits, which are as many as its length allows."""
    by_text = many.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "k", "h")).alias("hits"))
    return by_text.join(_of_texts(bare, many.select("t1", "t2")), ["t1", "t2"])


def _salted_pairs(few: DataFrame, size: int) -> DataFrame:
    """Anchors (a) against rows (b) of their group, texts a below b. A group of n rows goes to n / GROUP_ROWS tasks, so none has more than GROUP_ROWS of its anchors."""
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    a = few.where(F.col("pos") % size == 0).select("g", F.pmod(F.xxhash64("t1", "t2", "pos"), parts).cast("int").alias("part"), F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("pos").alias("a_pos"))
    b = few.select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("pos").alias("b_pos"))
    return a.join(b, ["g", "part"]).where("a1 < b1 or (a1 = b1 and a2 < b2)").drop("g", "part")


def _spans(bare: DataFrame, few: DataFrame, min_chars: int, done: list[DataFrame]) -> DataFrame:
    """Maximal exact repeats of the pairs of texts that meet in few (g, t1, t2, pos, n)."""
    size = min_chars // 2
    # 4. one row for each pair and diagonal: its blocks, in unbroken runs (a diagonal has at most as many blocks as the text)
    pairs = _salted_pairs(few, size)
    lines = pairs.groupBy("a1", "a2", "b1", "b2", (F.col("b_pos") - F.col("a_pos")).alias("shift")).agg(F.sort_array(F.collect_set("a_pos")).alias("at"))
    beside_of = lambda i, by: F.coalesce(F.get("at", i), F.lit(-1)) + by  # noqa: E731  # the block's neighbour in the sorted list
    starts = F.filter("at", lambda x, i: beside_of(i - 1, size) != x)
    ends = F.filter("at", lambda x, i: beside_of(i + 1, -size) != x)
    runs = lines.select("a1", "a2", "b1", "b2", "shift", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r"))
    runs = runs.select("a1", "a2", "b1", "b2", F.col("r.s").alias("a_at"), (F.col("r.s") + F.col("shift")).alias("b_at"), (F.col("r.e") - F.col("r.s") + size).alias("n"))
    runs = stage(runs, "runs")
    unstage(*done)
    # 5. the text around each run, of the texts that have one; beyond a run no whole block can match, so one block each side is enough
    used = _of_texts(bare, runs.select(F.col("a1").alias("t1"), F.col("a2").alias("t2")).union(runs.select("b1", "b2")))

    def beside(side: str, rows: DataFrame) -> DataFrame:
        named = used.select(F.col("t1").alias(f"{side}1"), F.col("t2").alias(f"{side}2"), "text")
        lead = F.least(F.col(f"{side}_at"), F.lit(size))
        cut = F.substring(F.col("text"), F.col(f"{side}_at") - lead + 1, lead + F.col("n") + size)
        hot = hot_buckets(runs, F.xxhash64(f"{side}1"))
        return salted_join(rows, named, f"{side}1", hot, "inner", [f"{side}2"]).withColumn(f"{side}_lead", lead).withColumn(f"{side}_text", cut).drop("text")

    return beside("b", beside("a", runs)).mapInArrow(partial(_grow, size=size, min_chars=min_chars), "a1 long, a2 long, b1 long, b2 long, a_start long, b_start long, n_chars long")


def shared_spans(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Maximal exact repeats between distinct texts: (a1, a2, b1, b2, a_start, b_start, n_chars), texts by their 128-bit hashes, a below b."""
    size = min_chars // 2
    bare = _texts(docs, min_chars).select("t1", "t2", "text")
    few, many, done = _candidates(docs, min_chars)
    if many.limit(1).count():
        whole = stage(_hits_by_text(bare, many).mapInArrow(partial(_full_windows, step=-(-size // AROUND), min_chars=min_chars), "g long, t1 long, t2 long, pos int").distinct(), "windows")
        done.append(whole)
        same = whole.groupBy("g").agg(*_several(size)).where("lo != hi and anchored").select("g", "n")
        few = few.unionByName(salted_join(whole, same, "g", hot_buckets(whole, F.xxhash64("g")), "inner").select(few.columns))
    return _spans(bare, few, min_chars, done)


def shared_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents with a common run of at least min_chars, equal texts among them."""
    members = _texts(docs, min_chars).select("doc_id", "t1", "t2").distinct()
    spans = shared_spans(docs, min_chars).select("a1", "a2", "b1", "b2").distinct()
    left = members.select(F.col("doc_id").alias("x"), F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    right = members.select(F.col("doc_id").alias("y"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    other = spans.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("x", "y")
    again = members.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2")
    own = members.join(again, ["t1", "t2"])
    same = own.select("t1", "t2", F.col("doc_id").alias("x")).join(own.select("t1", "t2", F.col("doc_id").alias("y")), ["t1", "t2"]).where("x < y").select("x", "y")
    return other.unionByName(same).where("x != y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_portions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_copies, share): how much of each document lies in spans of min_chars or more that another document has too.

    Pairs are made within groups of up to GROUP_MOST rows only. In larger groups, as a passage of very many texts forms, every window of min_chars around a hit becomes
    one row, and windows that two texts have are shared, whoever has them: the rows are as many as the shared characters, not as the pairs.
    """
    size = min_chars // 2
    bare = _texts(docs, min_chars).select("t1", "t2", "text")
    few, many, done = _candidates(docs, min_chars)
    pieces = None
    if many.limit(1).count():
        windows = stage(_hits_by_text(bare, many).mapInArrow(partial(_covering_windows, step=-(-size // AROUND), min_chars=min_chars), "g long, g2 long, t1 long, t2 long, pos int"), "windows")
        same = windows.groupBy("g", "g2").agg(F.min(F.struct("t1", "t2")).alias("lo"), F.max(F.struct("t1", "t2")).alias("hi")).where("lo != hi").select("g", "g2")
        held = salted_join(windows, same, "g", hot_buckets(windows, F.xxhash64("g")), "left_semi", ["g2"])
        pieces = held.select("t1", "t2", F.col("pos").cast("long").alias("lo"), (F.col("pos") + min_chars).cast("long").alias("hi"))
        pieces = stage(pieces, "pieces")
    spans = stage(_spans(bare, few, min_chars, done), "spans")
    sides = [spans.select(F.col(f"{x}1").alias("t1"), F.col(f"{x}2").alias("t2"), F.col(f"{x}_start").alias("lo"), (F.col(f"{x}_start") + F.col("n_chars")).alias("hi")) for x in "ab"]
    both = sides[0].unionByName(sides[1])
    both = (both if pieces is None else both.unionByName(pieces)).groupBy("t1", "t2", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("t1", "t2").orderBy("lo")
    reach = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = both.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reach))).groupBy("t1", "t2").agg(F.sum("new").alias("covered"))
    all_docs = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), *[c.alias(n) for c, n in zip(hash_pair(F.col("text")), ("t1", "t2"))]).distinct()
    copies = all_docs.where(F.col("n_chars") >= min_chars).groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    # a text that very many documents have is a hot key: documents are spread, the two facts about each text are repeated
    facts = copies.join(covered, ["t1", "t2"], "left")
    out = salted_join(all_docs, facts, "t1", hot_buckets(all_docs, F.xxhash64("t1")), "left", ["t2"])
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), F.coalesce(F.col("copies"), F.lit(1)).alias("n_copies"), F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars")), F.lit(0.0)).alias("share"))
