"""Ordered conversations from single chat rows, disentangled into reply trees; unusable conversations come out as dropped, with reasons.

Every row is scored against the rows before it, and the likeliest parent is taken, or none; the links form trees. What speaks for a row as parent:

* time: how soon the answer follows, by the time that passed from row to row between the two, so that one wrong date separates no others; the more so if the speaker changes;
* a quotation: it is the latest earlier row with exactly the quoted text;
* a mention: it is the latest earlier row of the author who is quoted or mentioned (@ and the sender's id);
* lexical overlap: the answer's words that no row used since (a word speaks for the row that used it last), weighted by how few rows used them before, as a
  share of the weight of all its words.

Any row for which neither quotation, mention nor word speaks scores at most as much as the row before or the last row of another speaker. So the likeliest of
ALL earlier rows is among these two and the latest holders of the row's own keys (quoted text, authors, words): one lookup per key, however long the conversation.

Rows are shuffled once, by conversation and block of BLOCK numbers, and folded in order; no task holds a whole conversation. Where a conversation has several
blocks, each block's last holder of every key it has goes to the next block with that key (a window over a few rows per block), and trees that cross blocks are
joined by pointer doubling over the rows that such links lead to.

Defined cases: rows delivered more than once are one turn (the first loaded, then the least text, counts), but every delivered row counts for the reasons; a row_id
that is no number makes its conversation broken; times without a zone are UTC; rows without conversation_id belong to none and are left out; an empty table
gives empty results; further columns are ignored; texts are used whole.
"""

from __future__ import annotations

import math
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import BROADCAST_BYTES, stage

BLOCK = 4096
#: Parts that rows without a number of one conversation are spread over.
LOOSE = 64
HALF_LIFE_S = 600.0
ROOT_SCORE = 0.35
WEIGHTS = {"soon": 0.45, "quoted": 3.0, "named": 0.8, "overlap": 0.8, "turn": 0.25}
#: Blanks and characters without a glyph; a text of these alone is no text.
BLANK = "[\\s\\p{Z}\\p{Cc}\\p{Cf}\\u115F\\u1160\\u2800\\u3164\\uFFA0\\uFE00-\\uFE0F]"
_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
_WORD = re.compile(f"[^\\W_{_HAN}]{{2,}}|[{_HAN}]{{2,}}")
_MENTION = re.compile(r"@([\w.\-]+)")


def readable_time(raw: Column) -> Column:
    """Timestamp of ISO forms (T or blank, dashes or slashes, with or without zone), Unix seconds and milliseconds; null where unreadable."""
    text = F.regexp_replace(raw, f"^{BLANK}+|{BLANK}+$", "")
    shape = "^(\\d{4})([-/])(\\d{1,2})\\2(\\d{1,2})[Tt ]+(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,]\\d+)?)? ?([Zz]|[+-]\\d{2}:?\\d{2})?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    zone = F.when(part(8).isin("", "Z", "z"), "+00:00").otherwise(F.regexp_replace(part(8), "^([+-]\\d{2}):?(\\d{2})$", "$1:$2"))
    iso = F.concat(part(1), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("-"), F.lpad(part(4), 2, "0"), F.lit("T"), F.lpad(part(5), 2, "0"), F.lit(":"), part(6), F.lit(":"), F.when(part(7) == "", "00").otherwise(part(7)), zone)
    whole = text.try_cast("bigint")
    return (
        F.when(text.rlike(shape) & (part(1) != "0000"), iso.try_cast("timestamp"))
        .when(text.rlike("^\\d{9,10}$"), F.timestamp_seconds(whole))
        .when(text.rlike("^\\d{12,13}$"), F.timestamp_millis(whole))
    )


def words(text: str | None) -> set[str]:
    """Words of two letters or digits or more in lower case, and pairs of Han characters."""
    out: set[str] = set()
    for w in _WORD.findall((text or "").lower()):
        if w[0] >= "㐀" and re.match(f"[{_HAN}]", w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        else:
            out.add(w)
    return out


def delivered(rows: DataFrame) -> DataFrame:
    """Every row that has a conversation, with its place in it and what it shows."""
    strip = lambda c: F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")
    sender, self_id, place = strip(F.col("sender_id")), strip(F.col("self_id")), strip(F.col("row_id"))
    clean = rows.where("conversation_id is not null").select(
        "conversation_id", F.when(place.rlike("^\\d{1,18}$"), place.try_cast("bigint")).alias("number"), F.lower(sender).alias("sender"), F.lower(self_id).alias("self_id"), readable_time(F.col("timestamp")).alias("at"),
        "text", F.coalesce(~F.col("text").rlike(f"^{BLANK}*$"), F.lit(False)).alias("has_text"), F.lower(strip(F.col("quoted_author"))).alias("quoted_author"), F.xxhash64("text").alias("text_hash"),
        F.when(F.length("quoted_text") > 0, F.xxhash64("quoted_text")).alias("quoted_hash"), "loaded_at",
    )
    named = F.coalesce((F.col("sender") != "") & (F.col("self_id") != ""), F.lit(False))
    loose = -1 - F.pmod(F.xxhash64("text_hash", "sender", "loaded_at"), F.lit(LOOSE))
    return clean.select(
        "conversation_id", F.coalesce(F.floor((F.col("number") - 1) / BLOCK), loose).alias("block"), "number", F.unix_timestamp("at").alias("at"), "sender", F.when(named, F.when(F.col("sender") == F.col("self_id"), "self").otherwise("other")).alias("role"),
        (~named | F.col("at").isNull()).alias("bad"), "has_text", "text", "text_hash", "quoted_hash", "quoted_author", "loaded_at",
    )


class _Past:
    """What a block's rows so far show: the last holder (number, sender, clock, rows that held it) of every key, the last row, and the last rows of the two latest speakers."""

    def __init__(self):
        self.held: dict[str, tuple] = {}
        self.asked: set[str] = set()
        self.last = self.one = self.two = self.time = self.first = None
        self.clock = 0

    def carry(self, key: str, holder: tuple) -> None:
        if key in ("last", "one", "two"):
            setattr(self, key, holder)
        elif key == "clock":
            self.clock = holder[2]
        else:
            self.held[key] = holder

    def take(self, t: dict) -> tuple[int | None, float | None]:
        """(parent, score) of the next turn, which then belongs to the past."""
        if t["at"] is not None:
            self.clock += abs(t["at"] - self.time) if self.time is not None else 0
            self.time = t["at"]
            self.first = t["at"] if self.first is None else self.first
        text, sender, own = t["text"], t["sender"], words(t["text"])
        points: dict[int, float] = {}
        holders: dict[int, tuple] = {}

        def add(holder, weight):
            if holder is not None:
                holders[holder[0]] = holder
                points[holder[0]] = points.get(holder[0], 0.0) + weight

        for holder in (self.last, self.one, self.two):
            add(holder, 0.0)
        if t["quoted_hash"] is not None:
            self.asked.add(f"q{t['quoted_hash']}")
            add(self.held.get(f"q{t['quoted_hash']}"), WEIGHTS["quoted"])
        authors = {m.rstrip(".-") for m in _MENTION.findall(text.lower())} if text and "@" in text else set()
        if t["quoted_author"]:
            authors.add(t["quoted_author"])
        self.asked.update(f"s{a}" for a in authors)
        for holder in {h for a in authors if (h := self.held.get(f"s{a}")) is not None}:
            add(holder, WEIGHTS["named"])
        shared: dict[int, float] = {}
        total = 0.0
        for w in sorted(own):  # in one order, so that sums don't depend on the process
            h = self.held.get(f"w{w}")
            n = h[3] if h is not None else 0
            weight = math.log(max(t["number"], n) + 1) - math.log(n + 1)
            total += weight
            if h is not None:
                holders[h[0]] = h
                shared[h[0]] = shared.get(h[0], 0.0) + weight
        best = (0.0, -1)
        for number, h in holders.items():
            turn = WEIGHTS["turn"] if sender and h[1] and h[1] != sender else 0.0
            score = points.get(number, 0.0) + (WEIGHTS["soon"] + turn) * math.exp((h[2] - self.clock) * math.log(2) / HALF_LIFE_S)
            if number in shared and total:
                score += WEIGHTS["overlap"] * shared[number] / total
            best = max(best, (round(score, 9), number))
        me = (t["number"], sender, self.clock, 1)
        self.last = me
        if sender:
            if self.one is not None and self.one[1] != sender:
                self.two = self.one
            self.one = me
            self.held[f"s{sender}"] = me
        if t["has_text"]:
            self.held[f"q{t['text_hash']}"] = me
        for w in own:
            h = self.held.get(f"w{w}")
            self.held[f"w{w}"] = (*me[:3], h[3] + 1) if h is not None else me
        return (best[1], best[0]) if best[0] >= ROOT_SCORE else (None, None)


def _blocks(batches):
    """(conversation, block, carried, turns) per block, turns as a generator that has to be used up. Rows come sorted by block, then carried keys, then turns in order."""
    def rows():
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(c).to_pylist() for c in names)):
                yield dict(zip(names, values))

    stream = rows()
    ahead = next(stream, None)

    def block_rows(conversation, block):
        nonlocal ahead
        while ahead is not None and ahead["conversation_id"] == conversation and ahead["block"] == block:
            row, ahead = ahead, next(stream, None)
            yield row

    while ahead is not None:
        conversation, block = ahead["conversation_id"], ahead["block"]
        yield conversation, block, block_rows(conversation, block)


def _merged(rows):
    """Turns of a block's rows: the first delivered row of each number, with what all of them show; rows without a number stay single."""
    turn = None
    for r in rows:
        if turn is None or r["number"] is None or r["number"] != turn["number"]:
            if turn is not None:
                yield turn
            turn = r | {"self_spoke": False, "other_spoke": False, "bad": False, "has_text_any": False}
        turn["bad"] |= r["bad"]
        turn["has_text_any"] |= r["has_text"]
        if r["has_text"] and r["role"]:
            turn[f"{r['role']}_spoke"] = True
    if turn is not None:
        yield turn


def _folded(rows, past: _Past):
    """Turns of a block with parent, score and root, after the keys carried into it."""
    def data():
        for r in rows:
            if r["key"] is not None:
                past.carry(r["key"], (r["number"], r["sender"], r["at"], r["n_rows"]))
            else:
                yield r

    root: dict[int, int] = {}
    for t in _merged(data()):
        if t["number"] is None:
            yield t | {"parent": None, "score": None, "root": None}
            continue
        parent, score = past.take(t)
        root[t["number"]] = t["number"] if parent is None else root.get(parent, parent)
        yield t | {"parent": parent, "score": score, "root": root[t["number"]]}


def _emit(rows, schema: pa.Schema, size: int = 4096):
    """Record batches of dicts; a batch ends early when its texts are long."""
    part, chars = [], 0
    for r in rows:
        part.append(r)
        chars += len(r.get("text") or "")
        if len(part) == size or chars > 1 << 24:
            yield pa.RecordBatch.from_pydict({f.name: [x[f.name] for x in part] for f in schema}, schema=schema)
            part, chars = [], 0
    if part:
        yield pa.RecordBatch.from_pydict({f.name: [x[f.name] for x in part] for f in schema}, schema=schema)


def _link(batches, schema: pa.Schema):
    """Parent, score and root in its block of every turn; a link to a row before the block stays open."""
    def out():
        for _, _, rows in _blocks(batches):
            for t in _folded(rows, _Past()):
                yield t | {"has_text": t["has_text_any"]}

    yield from _emit(out(), schema)


ENDS = pa.schema([("conversation_id", pa.string()), ("block", pa.int64()), ("key", pa.string()), ("number", pa.int64()), ("sender", pa.string()), ("at", pa.int64()), ("n_rows", pa.int64())])


def _ends(batches):
    """What each block hands on and asks for: its last holder of every key, with clocks from the block's own beginning, keys it asks for without a holder, and its first and last time."""
    def out():
        for conversation, block, rows in _blocks(batches):
            past = _Past()
            for _ in _folded(rows, past):
                pass
            base = {"conversation_id": conversation, "block": block}
            holders = past.held | {k: h for k in ("last", "one", "two") if (h := getattr(past, k)) is not None}
            for key, h in holders.items():
                yield base | {"key": key, "number": h[0], "sender": h[1], "at": h[2], "n_rows": h[3]}
            for key in past.asked - past.held.keys():
                yield base | {"key": key, "number": None, "sender": None, "at": None, "n_rows": None}
            yield base | {"key": "clock", "number": past.first, "sender": None, "at": past.clock, "n_rows": past.time}

    yield from _emit(out(), ENDS)


def _carried(rows: DataFrame) -> DataFrame:
    """The keys each block takes over from the blocks before it, for conversations of several blocks."""
    several = rows.where("block >= 0").groupBy("conversation_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("conversation_id")
    ends = _sorted(rows.where("block >= 0").join(several, "conversation_id", "left_semi")).mapInArrow(_ends, "conversation_id string, block long, key string, number long, sender string, at long, n_rows long")
    ends = stage(ends, "ends")
    by_block = Window.partitionBy("conversation_id").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    # clocks of all blocks on one scale; number and n_rows of this key are the block's first and last time
    clocks = ends.where("key = 'clock'").select("conversation_id", "block", F.col("at").alias("passed"), F.col("number").alias("first"), F.last("n_rows", ignorenulls=True).over(earlier).alias("before"))
    begun = F.sum(F.coalesce(F.abs(F.col("first") - F.col("before")), F.lit(0))).over(by_block.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("passed").over(earlier), F.lit(0))
    clocks = clocks.select("conversation_id", "block", begun.alias("begun"))
    placed = ends.where("key != 'clock'").join(clocks, ["conversation_id", "block"]).withColumn("at", F.col("at") + F.col("begun")).drop("begun")
    holder = F.struct("number", "sender", "at", "n_rows")
    by_key = Window.partitionBy("conversation_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keys = placed.where("key not in ('last', 'one', 'two')").select("conversation_id", "block", "key", F.last(F.when(F.col("number").isNotNull(), holder), ignorenulls=True).over(by_key).alias("h"), F.sum("n_rows").over(by_key).alias("n")).select("conversation_id", "block", "key", F.when(F.col("h").isNotNull(), F.col("h").withField("n_rows", F.col("n"))).alias("h"))
    pick = lambda k: F.max(F.when(F.col("key") == k, holder))
    heads = clocks.join(placed.where("key in ('last', 'one', 'two')").groupBy("conversation_id", "block").agg(*[pick(k).alias(k) for k in ("last", "one", "two")]), ["conversation_id", "block"], "left")
    latest = heads.withColumn("one_so_far", F.last("one", ignorenulls=True).over(earlier))
    # the latest speaker but one: of this block, else the latest speaker before it where that is another
    two = F.coalesce(F.col("two"), F.when(F.col("one.sender") != F.col("one_so_far.sender"), F.col("one_so_far")))
    latest = latest.withColumn("two", two).select("conversation_id", "block", F.last("last").over(earlier).alias("last"), F.col("one_so_far").alias("one"), F.last("two", ignorenulls=True).over(earlier).alias("two"), F.struct(F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("sender"), F.col("begun").alias("at"), F.lit(None).cast("long").alias("n_rows")).alias("clock"))
    stacked = latest.select("conversation_id", "block", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("h")) for k in ("last", "one", "two", "clock")])).alias("x")).select("conversation_id", "block", "x.key", "x.h")
    return keys.unionByName(stacked).where("h is not null").select("conversation_id", "block", "key", "h.*")


def _sorted(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Blocks in one partition each, carried keys before rows, rows in order."""
    rows = rows.withColumn("key", F.lit(None).cast("string")).withColumn("n_rows", F.lit(None).cast("long"))
    both = rows if carried is None else rows.unionByName(carried, allowMissingColumns=True)
    order = ["conversation_id", "block", F.col("key").isNull(), "number", "loaded_at", "text", "at", "sender", "role", "quoted_author", "quoted_hash"]
    return both.repartition("conversation_id", "block").sortWithinPartitions(*order).drop("loaded_at")


LINKED = "conversation_id string, block long, number long, role string, sender string, at long, text string, bad boolean, has_text boolean, self_spoke boolean, other_spoke boolean, parent long, score double, root long"


def linked(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Turns with parent and root, each the number of a row of the conversation; a row without parent is its own root. Without texts these stay behind."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    placed = delivered(rows)
    carried = None
    if (placed.agg(F.max("block")).first()[0] or 0) > 0:  # reads the numbers alone
        carried = stage(_carried(placed), "carried")
    schema = T.StructType([f for f in T.StructType.fromDDL(LINKED) if texts or f.name != "text"])
    found = _sorted(placed, carried).mapInArrow(partial(_link, schema=to_arrow_schema(schema)), schema)
    found = found.withColumn("open", F.coalesce(F.floor((F.col("root") - 1) / BLOCK) != F.col("block"), F.lit(False))).drop("block")
    return (_close(stage(found, "trees")) if carried is not None else found).drop("open")


def _close(found: DataFrame) -> DataFrame:
    """Follow open roots over block borders; only the rows that open roots lead to take part, and every round halves the way left."""
    led_to = found.where("open").select("conversation_id", F.col("root").alias("number")).distinct()
    border = stage(found.join(led_to, ["conversation_id", "number"], "left_semi").select("conversation_id", F.col("number").alias("b"), F.col("root").alias("to"), "open"), "border")
    while border.where("open").limit(1).count():
        ahead = border.select("conversation_id", F.col("b").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"))
        step = border.join(ahead, ["conversation_id", "to"], "left")
        jump = F.col("open") & F.col("to2").isNotNull()
        border = stage(step.select("conversation_id", "b", F.when(jump, F.col("to2")).otherwise(F.col("to")).alias("to"), (jump & F.col("open2")).alias("open")), "border")
    ends = border.select("conversation_id", F.col("b").alias("root"), F.col("to").alias("end"))
    done = found.join(ends, ["conversation_id", "root"], "left")
    return done.withColumn("root", F.when(F.col("open"), F.coalesce("end", "root")).otherwise(F.col("root"))).drop("end")


def verdicts(links: DataFrame) -> DataFrame:
    """(conversation_id, n_turns, n_threads, broken, empty, no_reply) of every conversation, folded from its trees; rows without a number are a tree of their own."""
    trees = links.groupBy("conversation_id", "root").agg(
        F.count("number").alias("turns"), F.min("number").alias("low"), F.max("number").alias("high"), F.bool_or(F.col("number").isNull() | F.col("bad")).alias("bad"),
        F.bool_or("has_text").alias("any_text"), F.bool_or("self_spoke").alias("self_spoke"), F.bool_or("other_spoke").alias("other_spoke"),
    )
    per = trees.groupBy("conversation_id").agg(
        F.sum("turns").alias("n_turns"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("bad").alias("bad"), F.bool_or("any_text").alias("any_text"), F.bool_or("self_spoke").alias("self_spoke"), F.bool_or("other_spoke").alias("other_spoke"), F.count("root").alias("n_threads"),
    )
    gap = ~F.coalesce((F.col("low") == 1) & (F.col("high") == F.col("n_turns")), F.lit(False))
    return per.select("conversation_id", "n_turns", "n_threads", (F.col("bad") | gap).alias("broken"), (~F.col("any_text")).alias("empty"), (F.col("any_text") & ~(F.col("self_spoke") & F.col("other_spoke"))).alias("no_reply"))


def dropped(rows: DataFrame) -> DataFrame:
    """(conversation_id, reason) of every reason for which a conversation is unusable."""
    return _reasons(verdicts(linked(rows, False)))


def _reasons(judged: DataFrame) -> DataFrame:
    reasons = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("broken", "empty", "no_reply")]))
    return judged.select("conversation_id", F.explode(reasons).alias("reason"))


def rebuild(rows: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the turns of usable conversations in order with role, parent and thread; (conversation_id, reason) of the others."""
    links = stage(linked(rows, texts), "links")
    judged = verdicts(links)
    usable = stage(judged.where("not (broken or empty or no_reply)").select("conversation_id"), "usable")
    size = usable.agg(F.sum(F.octet_length("conversation_id") + 16)).first()[0] or 0
    kept = links.join(F.broadcast(usable) if size <= BROADCAST_BYTES else usable, "conversation_id", "left_semi")
    shown = ["role", "sender", F.timestamp_seconds("at").alias("at"), *(["text"] if texts else []), F.col("parent").alias("reply_to"), F.col("root").alias("thread"), F.round("score", 6).alias("score")]
    return kept.select("conversation_id", F.col("number").alias("position"), *shown), _reasons(judged)


def conversations(rows: DataFrame) -> DataFrame:
    """One row per usable conversation: its size, threads, speakers and times."""
    kept, _ = rebuild(rows, False)
    return kept.groupBy("conversation_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("thread") == F.col("position")).alias("n_threads"), F.count_if(F.col("role") == "self").alias("n_self"), F.count_if(F.col("role") == "other").alias("n_other"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
