"""References to records that don't exist: direct orphans by time, inherited orphans by cascade.

A target's rows become, per key, disjoint segments of time in which the key is late, there or deleted, so each reference meets exactly one
segment. Records with an orphaned reference then orphan their own children: semi-joins run down the foreign-key graph until nothing is added.

Defined cases: a null reference is none; a null time or key of the referring record: no time, no verdict (no row), a null key part is empty;
target rows with a null key are none; a target row with a null loaded_at is never there, but its key is known (deleted, not missing or late); repeated target rows change nothing; unreadable bodies hold no references.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import hot_buckets, salted_join, stage
from tessera.operators.nested import extract


def segments(target: DataFrame, key: str) -> DataFrame:
    """(target_key, lo, hi, state): for each key all time, cut into disjoint segments late / there / deleted; lo null is the beginning, hi null the end."""
    far = F.lit("9999-12-31").cast("timestamp")
    start, end = F.col("loaded_at").cast("timestamp"), F.coalesce(F.col("deleted_at").cast("timestamp"), far)
    ever = F.lit("0001-01-01").cast("timestamp")
    rows = target.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("target_key"), F.coalesce(start, ever).alias("a"), F.when(start.isNull(), ever).otherwise(end).alias("b"))
    # a row deleted before or as it was loaded still shows that the key was known from then on
    rows = rows.groupBy("target_key", "a").agg(F.max("b").alias("b")).withColumn("b", F.greatest("a", "b"))
    order = Window.partitionBy("target_key").orderBy("a")
    reach = rows.withColumn("before", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = reach.where("before is null or a > before").select("target_key", "a", "before", F.lead("before").over(order).alias("until"))
    last = rows.groupBy("target_key").agg(F.max("b").alias("last"))
    runs = runs.join(last, "target_key").withColumn("until", F.coalesce("until", "last"))
    first = F.col("before").isNull()
    parts = F.array(
        F.struct(F.when(first, F.lit(None).cast("timestamp")).otherwise(F.col("before")).alias("lo"), F.col("a").alias("hi"), F.when(first, "late").otherwise("deleted").alias("state")),
        F.struct(F.col("a").alias("lo"), F.col("until").alias("hi"), F.lit("there").alias("state")),
        F.struct(F.when(F.col("until") == F.col("last"), F.col("until")).alias("lo"), F.lit(None).cast("timestamp").alias("hi"), F.lit("deleted").alias("state")),
    )
    cut = runs.select("target_key", F.explode(parts).alias("p")).select("target_key", "p.lo", "p.hi", "p.state")
    return cut.where("not (state = 'deleted' and lo is null)").where("lo is null or hi is null or lo < hi")


def direct_orphans(refs: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """refs (ref_table, ref_key, ref_field, target_table, target_key, at) with a reason for each reference that leads nowhere at its time."""
    refs = stage(refs.where("target_key is not null and at is not null"), "references")  # read for the histogram and for the join, parsed once
    cut = None
    for name, part in targets.items():
        one = part.withColumn("target_table", F.lit(name))
        cut = one if cut is None else cut.unionByName(one)
    link = F.concat_ws("\u001f", "target_table", "target_key")
    left = refs.withColumn("link", link)
    hot = hot_buckets(left, F.xxhash64("link"))
    joined = salted_join(left, cut.select(link.alias("link"), "lo", "hi", "state"), "link", hot)
    inside = (F.col("lo").isNull() | (F.col("at") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("at") < F.col("hi")))
    reason = F.when(F.col("state").isNull(), "missing").when(inside, F.col("state"))
    return joined.withColumn("reason", reason).where("reason is not null and reason != 'there'").drop("link", "lo", "hi", "state")


@dataclass(frozen=True)
class Edge:
    """Records of `child` refer by `field` to records of `parent`; links has (child_key, parent_key, period), the period of the child."""

    child: str
    parent: str
    field: str
    links: DataFrame


def cascade(direct: DataFrame, edges: list[Edge], rounds: int | None = None) -> DataFrame:
    """Orphaned references down the foreign-key graph to the fixpoint: (ref_table, ref_key, ref_field, target_key, reason, period, depth).

    direct has these columns but the depth, which is 0. A record with an orphaned reference is an orphan, and each round semi-joins the links of child records with
    the orphans that are new: their references to these are orphaned too, with the reason inherited. A record comes in once, at its least depth, with all links of that depth.
    The rounds end when nothing is new; a stated bound that leaves orphans is an error.
    """
    names = ["ref_table", "ref_key", "ref_field", "target_key", "reason", "period"]
    rows = [stage(direct.select(names).distinct().withColumn("depth", F.lit(0)), "orphans")]
    if not edges:
        return rows[0]
    reached = lambda df: df.select(F.col("ref_table").alias("table"), F.col("ref_key").alias("key")).distinct()
    hot: dict[int, list[int]] = {}  # of each edge's links, counted once
    fresh = done = reached(rows[0])
    tables, depth = {e.parent for e in edges}, 0
    while True:
        depth += 1
        found = None
        for i, e in enumerate(edges):
            if e.parent not in tables:
                continue
            if i not in hot:
                hot[i] = hot_buckets(e.links, F.xxhash64("parent_key"))
            bad = fresh.where(F.col("table") == e.parent).select(F.col("key").alias("parent_key"))
            part = salted_join(e.links, bad, "parent_key", hot[i], "inner") if hot[i] else e.links.join(bad, "parent_key", "left_semi")
            part = part.select(F.lit(e.child).alias("ref_table"), F.col("child_key").alias("ref_key"), F.lit(e.field).alias("ref_field"), F.col("parent_key").alias("target_key"), F.lit("inherited").alias("reason"), "period", F.lit(depth).alias("depth"))
            found = part if found is None else found.unionByName(part)
        if found is None:
            break
        known = done.select(F.col("table").alias("ref_table"), F.col("key").alias("ref_key"))
        new = stage(found.distinct().join(known, ["ref_table", "ref_key"], "left_anti"), "orphans")
        tables = {r["ref_table"] for r in new.select("ref_table").distinct().collect()}  # names of tables, not of records
        if not tables:
            break
        if rounds is not None and depth > rounds:
            raise ValueError(f"orphans are left after {rounds} rounds")
        rows.append(new)
        if not tables & {e.parent for e in edges}:
            break  # no table refers to them
        fresh = reached(new)
        done = done.unionByName(fresh)
        if depth % 16 == 0:
            done, rows = stage(done, "orphans"), [stage(reduce(DataFrame.unionByName, rows), "orphans")]  # keeps the plan short
    return reduce(DataFrame.unionByName, rows)


def asset_references(assets: DataFrame) -> DataFrame:
    paths = {"self_model.evidence_ids": "self_model[].evidence_ids[]", "voice.scenarios.evidence_ids": "voice.scenarios[].evidence_ids[]", "evaluation_cases.evidence_ids": "evaluation_cases[].evidence_ids[]"}
    rows = extract(assets, F.col("body"), {"ref_key": F.col("package_id"), "at": F.col("built_at").cast("timestamp")}, paths)
    return rows.select(F.lit("assets").alias("ref_table"), F.coalesce("ref_key", F.lit("")).alias("ref_key"), F.col("path").alias("ref_field"), F.lit("evidence").alias("target_table"), F.col("value").alias("target_key"), "at")


def member_key() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(part("room_id"), F.lit("|"), part("member_id"))


def vault_references(members: DataFrame, assets: DataFrame, episodes: DataFrame) -> DataFrame:
    """All references of the vault: (ref_table, ref_key, ref_field, target_table, target_key, at)."""
    both = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target_table"), F.col(f).cast("string").alias("target_key")) for f, t in (("room_id", "chat_room"), ("member_id", "contact"))])
    rooms = members.select(member_key().alias("ref_key"), F.explode(both).alias("r"), F.col("joined_at").cast("timestamp").alias("at")).select(F.lit("chatroom_member").alias("ref_table"), "ref_key", "r.*", "at")
    events = episodes.select(F.coalesce("route_id", F.lit("")).alias("ref_key"), F.col("routed_at").cast("timestamp").alias("at"), F.explode("events").alias("e"))
    places = events.select(F.lit("routed_episodes").alias("ref_table"), "ref_key", F.lit("events.place_ids").alias("ref_field"), F.lit("places").alias("target_table"), F.explode("e.place_ids").alias("target_key"), "at")
    cols = ["ref_table", "ref_key", "ref_field", "target_table", "target_key", "at"]
    return rooms.select(cols).unionByName(asset_references(assets).select(cols)).unionByName(places.select(cols))


def vault_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    targets = {"chat_room": segments(tables["chat_room"], "id"), "contact": segments(tables["contact"], "id"), "evidence": segments(tables["evidence"], "evidence_id"), "places": segments(tables["places"], "place_id")}
    return direct_orphans(vault_references(tables["chatroom_member"], tables["assets"], tables["routed_episodes"]), targets)


def cascaded(tables: dict[str, DataFrame]) -> DataFrame:
    """The vault's orphaned references, direct ones and those inherited by messages of an orphaned membership and by episodes of an orphaned route."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    direct = vault_orphans(tables).withColumn("period", month(F.col("at")))
    rooms = tables["chat_room"].select(F.col("username").alias("conversation_id"), F.col("id").alias("room_id")).where("conversation_id is not null").distinct()
    people = tables["contact"].select(F.col("username").alias("real_sender_id"), F.col("id").alias("member_id")).where("real_sender_id is not null").distinct()
    sent = tables["message"].where("conversation_id is not null and real_sender_id is not null").select("row_no", "conversation_id", "real_sender_id", "create_time")
    links = sent.join(rooms, "conversation_id").join(people, "real_sender_id").select(F.col("row_no").cast("string").alias("child_key"), member_key().alias("parent_key"), month(F.timestamp_seconds("create_time")).alias("period"))
    episodes = tables["routed_episodes"].select(F.col("episode_id").alias("child_key"), F.col("route_id").alias("parent_key"), month(F.col("routed_at").cast("timestamp")).alias("period")).where("child_key is not null and parent_key is not null").distinct()
    return cascade(direct, [Edge("message", "chatroom_member", "membership", links), Edge("episode", "routed_episodes", "route_id", episodes)])


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_key, ref_field, target_key, reason, period), distinct: depth 0 of the cascade."""
    return cascaded(tables).where("depth = 0").drop("depth")


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, field, reason, depth and period: orphaned references, and the records that hold them."""
    return cascaded(tables).groupBy("ref_table", "ref_field", "reason", "depth", "period").agg(F.count("*").alias("n_references"), F.count_distinct("ref_key").alias("n_records"))
