import json
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.operators import nested


def walk(texts, path):
    index = nested.index_batch(pa.array(texts, pa.string()))
    doc, pos, sub, slot = index.walk(path)
    return sorted((int(d), int(p), int(s), v) for d, p, s, v in zip(doc, pos, sub, index.values(slot)) if v is not None)


def plain(texts, path):
    out = []
    for d, t in enumerate(texts):
        try:
            root = json.loads(t)
        except (TypeError, ValueError):
            continue
        if not isinstance(root, (dict, list)):
            continue
        state = [(root, [])]
        for part in [s for p in path.split(".") for s in ([p[:-2], "[]"] if p.endswith("[]") else [p]) if s]:
            nxt = []
            for v, places in state:
                if part == "[]":
                    nxt += [(x, [*places, i]) for i, x in enumerate(v)] if isinstance(v, list) else [(v, [*places, 0])]
                elif isinstance(v, dict) and part in v:
                    nxt.append((v[part], places))
            state = nxt
        for v, places in state:
            if v is not None:
                text = v if isinstance(v, str) else None
                out.append((d, *(places + [-1, -1])[:2], text))
    return sorted(out, key=str)


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c", 'q"', "é\\"]), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "c"]), VALUES, max_size=3), min_size=1, max_size=5), st.booleans(), st.sampled_from(["a[].b", "a[].b[]", "a.b", "b[].c[]", "c"]))
def test_against_a_parser(objects, escaped, path):
    texts = [json.dumps(o, ensure_ascii=escaped, indent=random.choice([None, 1])) for o in objects]
    got = [(d, p, s, None if v is None else v) for d, p, s, v in walk(texts, path)]
    want = plain(texts, path)
    assert [(d, p, s) for d, p, s, _ in got] == sorted((d, p, s) for d, p, s, _ in want)
    strings = sorted((d, p, s, v) for d, p, s, v in want if v is not None)
    assert [x for x in strings if x not in got] == []


def test_unreadable_texts():
    bad = [None, "", "  ", '{"a": [1, 2', '{"a": "x}', '{"a": }', '{"a" 1}', '{"a": [1,, 2]}', '{"a": 1]', '{"a": 1} {"a": 2}', "7", '"a"', 'x{"a": 1}', '{"a": 1}y']
    assert walk([*bad, ' {"a": 1} '], "a") == [(len(bad), -1, -1, "1")]


def test_escapes_and_single_values():
    texts = ['{"a": {"b": "x\\\\"}, "c": ["}", "\\"]"]}', '{"a": [null, {"b": null}, {"b": "\\u4e2d"}], "c": "one"}', '{"\\u0061": {"b": ""}}']
    assert walk(texts, "a[].b") == [(0, 0, -1, "x\\"), (1, 2, -1, "中"), (2, 0, -1, "")]
    assert walk(texts, "c[]") == [(0, 0, -1, "}"), (0, 1, -1, '"]'), (1, 0, -1, "one")]


EVENT = "struct<subject:string,asserted_event_time:struct<value:string,precision:string>,evidence_ids:array<string>>"


def test_found(spark):
    e = lambda v, ids: ("s", None if v is None else (v, "day"), ids)
    routes = spark.createDataFrame([("r", [None, e("2024", ["a", None, ""]), e("", None)], 1), ("r", [None, e("2024", ["a", None, ""]), e("", None)], 2), ("q", None, 3), ("p", [], 4)], f"route_id string, events array<{EVENT}>, pos int").selectExpr("*", "timestamp_seconds(pos) as routed_at")
    packages = spark.createDataFrame([("k", '{"self_model": {"calibration": {"status": "draft"}}}', "x"), ("k2", '{"self_model": [{"calibration": null}, {"calibration": {"status": ""}}, {"calibration": {"status": "ready"}}]}', "x"), ("k3", '{"self_model": [', "x"), (None, None, None)], "package_id string, body string, path string").selectExpr("*", "cast(null as timestamp) as built_at")
    assert sorted(tuple(r) for r in nested.found(routes, packages).collect()) == [
        ("assets", "k", "self_model.calibration.status", 0, -1), ("assets", "k2", "self_model.calibration.status", 2, -1),
        ("routed_episodes", "r", "events.asserted_event_time.value", 1, -1), ("routed_episodes", "r", "events.evidence_ids", 1, 0),
    ]
    assert nested.found(routes.where("false"), packages.where("false")).count() == 0
    flat = nested.flat_tables(routes, packages)
    assert {n: f.count() for n, f in flat.items()} == {"events": 2, "evidence_links": 2, "place_links": 0, "claims": 3, "scenario_evidence": 0, "case_evidence": 0}


def test_flat_rows_never_mix_versions(spark):
    kinds = "subject string, title string, importance double, asserted_event_time struct<value:string,precision:string>, evidence_ids array<string>, place_ids array<string>"
    rows = [("r", 2, [("a", "b", None, None, ["e1"], None)]), ("r", 1, [(None, None, 0.5, ("2024", "year"), ["e2"], ["p", "p"])]), ("r", 1, [(None, None, 0.5, ("2024", "year"), ["e2"], ["p", "p"])]), (None, 1, [("x", None, None, None, None, None)]), (None, 1, [("y", None, 1.0, None, None, None)])]
    routes = spark.createDataFrame(rows, f"route_id string, at int, events array<struct<{kinds}>>").selectExpr("*", "timestamp_seconds(at) as routed_at")
    packages = spark.createDataFrame([], "package_id string, body string, built_at timestamp")
    flat = nested.flat_tables(routes, packages)
    got = sorted((r.route_id or "", r.pos, r.subject or "", r.title or "", r.importance or 0.0, r.asserted_event_time_value or "") for r in flat["events"].collect())
    assert got == [("", 0, "x", "", 0.0, ""), ("", 0, "y", "", 1.0, ""), ("r", 0, "", "", 0.5, "2024")]
    assert [tuple(r) for r in flat["evidence_links"].collect()] == [("r", 0, 0, "e2")]
    assert sorted(tuple(r) for r in flat["place_links"].collect()) == [("r", 0, 0, "p"), ("r", 0, 1, "p")]


def test_very_long_text(spark):
    body = json.dumps({"self_model": [{"calibration": {"status": f"s{i}"}, "x": "y" * 50} for i in range(20_000)]})
    df = spark.createDataFrame([("k", body)], "package_id string, body string")
    rows = nested.extract(df, F.col("body"), {"package_id": F.col("package_id")}, nested.CLAIM_STATUS)
    assert rows.count() == 20_000 and rows.agg(F.max("pos")).first()[0] == 19_999
