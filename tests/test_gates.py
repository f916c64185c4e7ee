from pyspark.sql import functions as F
from tessera.functions.text import intersects
from tessera.operators import gates


def test_scan(spark):
    df = spark.createDataFrame([("a", "password = hunter2hunter", "x/.env"), ("b", "tokenization /home/ann ok", "m.db"), ("c", None, None)], "k string, c string, p string")
    assert {(r.k, r.rule, r.hits) for r in gates.scan(df, "k", "c", "p").collect()} == {("a", "credential", 1), ("a", "secret_file", 1), ("b", "home_path", 1), ("b", "database", 1)}


def test_targets(spark):
    raw = ["methods/a.md", "methods/.md", "methods/", "methods/../x.md", "/methods/a.md", "other/a.md", "methods/a.txt", "methods//a.md", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(gates.safe_target(F.col("t"), ["methods/"])).collect()]
    assert got == [True, True, False, False, False, False, False, False, False]


def test_shape_and_progress(spark):
    ch = spark.createDataFrame([("p", "create", "a", "x"), ("p", "update", "a", ""), ("q", "delete", "b", None), ("r", "create", "c", "x\u0000")], "id string, action string, target string, content string")
    assert {r.id: (r.n, r.repeated, r.empty, r.nul, r.acceptable) for r in gates.change_set_shape(ch, "id").collect()} == {"p": (2, 1, 1, 0, False), "q": (1, 0, 0, 0, True), "r": (1, 0, 0, 1, False)}
    scope = spark.createDataFrame([("a",), ("b",), ("b",)], "unit string")
    states = spark.createDataFrame([("a", "done"), ("z", "done")], "unit string, status string")
    assert tuple(gates.progress(scope, states, ["done"]).first()) == (2, 1, 1, 1, False)


def test_repair(spark):
    items = spark.createDataFrame([("k", [" e1 ", None, "e1", "", "e9"]), ("m", None)], "k string, ids array<string>")
    got = {r.k: (r.ids, r.dropped, r.unknown) for r in gates.repair_evidence(items, "k", "ids", spark.createDataFrame([("e1",)], "id string")).collect()}
    assert got["k"] == (["e1", "e9"], 3, 1)


def test_pack(spark):
    types = spark.createDataFrame([("a", "x/"), ("b", "x/y/"), ("b", "z")], "type string, prefix string")
    links = spark.createDataFrame([("l", "m"), ("m", "l"), ("n", "q")], "link string, inverse string")
    rules = spark.createDataFrame([("a", "f", "l"), ("c", "f", "zz")], "type string, field string, link_type string")
    got = {(r.code, r.detail) for r in gates.pack_violations(types, links, rules).collect()}
    assert got == {("repeated_type", "b"), ("prefix_inside_prefix", "x/y/"), ("bad_prefix", "z"), ("inverse_without_answer", "n"), ("rule_of_unknown_type", "c"), ("rule_of_unknown_link", "zz")}


def test_small_pieces(spark):
    df = spark.createDataFrame([("u", "accepted", ["c1", "c2"]), ("v", "produced", ["c3"]), ("w", None, None)], "unit string, status string, candidates array<string>")
    out, waiting = gates.materialize(df, "unit", "candidates")
    assert out.count() == 2 and out.select("candidate_id").distinct().count() == 2 and {r.unit for r in waiting.collect()} == {"v", "w"}
    v = spark.createDataFrame([("1.10.0",), ("1.9",), ("x",)], "v string").select(gates.version_at_least(F.col("v"), "1.9.5"))
    assert [r[0] for r in v.collect()][:2] == [True, False]
    s = spark.createDataFrame([([" A "], ["a"]), ([], ["a"]), (None, ["a"])], "x array<string>, y array<string>").select(intersects(F.col("x"), F.col("y")))
    assert [r[0] for r in s.collect()] == [True, False, False]
    assert gates.json_schemas(spark, {"t": df}).count() == 1
