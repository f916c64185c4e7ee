import json
import random
from datetime import datetime, timedelta

import pytest

from tessera.operators import graph, orphans

T0 = datetime(2024, 1, 15)
DAY = timedelta(days=1)


def reason(rows, t):
    if not rows:
        return "missing"
    if any(a is not None and a <= t and (b is None or b > t) for a, b in rows):
        return None
    return "late" if all(a is not None and a > t for a, b in rows) else "deleted"


def test_segments_against_the_rule(spark):
    r = random.Random(5)
    targets = {f"k{i}": [(T0 + DAY * r.randint(0, 60), None if r.random() < 0.3 else T0 + DAY * r.randint(-5, 80)) for _ in range(r.randint(1, 5))] for i in range(60)}
    targets["k1"].append((None, None))
    targets["k65"] = [(None, T0)]
    rows = [(k, a, b) for k, v in targets.items() for a, b in v] + [(None, T0, None)]
    refs = [("t", str(n), "f", "x", f"k{r.randint(0, 70)}", T0 + DAY * r.randint(-10, 90)) for n in range(800)] + [("t", "n", "f", "x", None, T0), ("t", "m", "f", "x", "k1", None)]
    cut = orphans.segments(spark.createDataFrame(rows, "id string, loaded_at timestamp, deleted_at timestamp"), "id")
    df = spark.createDataFrame(refs, "ref_table string, ref_key string, ref_field string, target_table string, target_key string, at timestamp")
    got = {(x.ref_key, x.reason) for x in orphans.direct_orphans(df, {"x": cut}).collect()}
    want = {(k, reason(targets.get(t, []), at)) for _, k, _, _, t, at in refs if t is not None and at is not None}
    assert got == {x for x in want if x[1]}


def tables(spark, members=(), assets=(), episodes=(), room=(), contact=(), evidence=(), place=(), message=()):
    make = spark.createDataFrame
    life = "loaded_at timestamp, deleted_at timestamp"
    return {
        "chat_room": make(list(room), f"id int, username string, {life}"), "contact": make(list(contact), f"id int, username string, nickname string, {life}"),
        "evidence": make(list(evidence), f"evidence_id string, summary string, {life}"), "places": make(list(place), f"place_id string, canonical string, {life}"),
        "chatroom_member": make(list(members), "room_id int, member_id int, joined_at timestamp, target_key string"), "assets": make(list(assets), "package_id string, built_at timestamp, body string, at string"),
        "routed_episodes": make(list(episodes), "route_id string, episode_id string, routed_at timestamp, events array<struct<place_ids:array<string>>>"),
        "message": make(list(message), "row_no long, conversation_id string, real_sender_id string, create_time int"),
    }


def test_found(spark):
    body = {"self_model": {"evidence_ids": "e1"}, "voice": {"scenarios": [{"evidence_ids": ["e2", None]}]}, "evaluation_cases": [None, {"evidence_ids": []}]}
    t = tables(
        spark, members=[(1, 2, T0, "c"), (1, 2, T0, "c"), (None, 9, T0, "c"), (1, 2, None, "c"), (None, None, T0, None)], assets=[("p", T0, json.dumps(body), "z"), ("q", T0, '{"self_model": [', "z"), ("n", T0, None, None)],
        episodes=[("r", "ep", T0, [None, (None,), (["pl", None, "px"],)])], room=[(1, "room", T0 - DAY, None)], contact=[(2, "u", "n", T0 + DAY, None)], evidence=[("e1", "s", T0 - DAY, T0)], place=[("pl", "c", T0, None)],
    )
    got = sorted(tuple(r) for r in orphans.found(t).collect())
    assert got == [
        ("assets", "p", "self_model.evidence_ids", "e1", "deleted", "2024-01"), ("assets", "p", "voice.scenarios.evidence_ids", "e2", "missing", "2024-01"),
        ("chatroom_member", "1|2", "member_id", "2", "late", "2024-01"), ("chatroom_member", "|9", "member_id", "9", "missing", "2024-01"), ("routed_episodes", "r", "events.place_ids", "px", "missing", "2024-01"),
    ]


def test_empty_tables(spark):
    assert orphans.found(tables(spark)).count() == 0
    assert orphans.orphan_report(tables(spark)).count() == 0


def test_hot_key(spark):
    refs = spark.createDataFrame([("t", str(i), "f", "x", "hot", T0) for i in range(3000)] + [("t", f"c{i}", "f", "x", f"k{i}", T0) for i in range(500)], "ref_table string, ref_key string, ref_field string, target_table string, target_key string, at timestamp")
    cut = orphans.segments(spark.createDataFrame([("hot", T0 + DAY, None)], "id string, loaded_at timestamp, deleted_at timestamp"), "id")
    got = orphans.direct_orphans(refs, {"x": cut}).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"late": 3000, "missing": 500}


DIRECT = "ref_table string, ref_key string, ref_field string, target_key string, reason string, period string"


def test_cascade_reaches_the_fixpoint(spark):
    link = lambda rows: spark.createDataFrame([(*r, "2024-02") for r in rows], "child_key string, parent_key string, period string")
    direct = spark.createDataFrame([("a", "1", "f", "t", "late", "2024-01"), ("b", "7", "f", "t", "missing", "2024-01"), ("b", "7", "f", "t", "missing", "2024-01")], DIRECT)
    edges = [orphans.Edge("b", "a", "g", link([("7", "1"), ("8", "1"), ("8", "1"), ("9", "2")])), orphans.Edge("c", "b", "g", link([("x", "8"), ("y", "9"), ("z", "7"), (None, "7")])), orphans.Edge("a", "c", "g", link([("5", "x"), ("1", "x"), ("6", None)]))]
    got = sorted((r.ref_table, r.ref_key or "", r.target_key, r.reason, r.period, r.depth) for r in orphans.cascade(direct, edges).collect())
    inherited = [("a", "5", "x", 3), ("b", "8", "1", 1), ("c", "x", "8", 2), ("c", "z", "7", 1), ("c", "", "7", 1)]
    assert got == sorted([("a", "1", "t", "late", "2024-01", 0), ("b", "7", "t", "missing", "2024-01", 0), *((t, k, p, "inherited", "2024-02", d) for t, k, p, d in inherited)])


def test_report_by_period(spark):
    t = tables(spark, members=[(1, 2, T0, "c")], room=[(1, "room", T0 - DAY, None)], contact=[(2, "u", "n", T0 + DAY, None)], message=[(5, "room", "u", 1_710_000_000), (6, "room", "u", 1_710_000_001), (7, "room", "v", 1_710_000_001), (8, "room", "u", None), (9, None, None, None)])
    got = sorted((r.ref_table, r.ref_field, r.reason, r.depth, r.period or "", r.n_references, r.n_records) for r in orphans.orphan_report(t).collect())
    assert got == [("chatroom_member", "member_id", "late", 0, "2024-01", 1, 1), ("message", "membership", "inherited", 1, "", 1, 1), ("message", "membership", "inherited", 1, "2024-03", 2, 2)]


def test_no_orphan_or_node_is_left_silently(spark):
    chain = spark.createDataFrame([("2", "1", "p"), ("3", "2", "p"), ("4", "3", "p")], "child_key string, parent_key string, period string")
    direct = spark.createDataFrame([("a", "1", "f", "t", "late", "p")], DIRECT)
    with pytest.raises(ValueError):
        orphans.cascade(direct, [orphans.Edge("a", "a", "g", chain)], rounds=2)
    assert orphans.cascade(direct, [orphans.Edge("a", "a", "g", chain)], rounds=3).count() == 4
    edges, roots = chain.selectExpr("parent_key as src", "child_key as dst"), spark.createDataFrame([("1",)], "node string")
    with pytest.raises(ValueError):
        graph.closure(edges, roots, rounds=2)
    assert graph.closure(edges, roots).count() == 4
