import math

from pyspark.sql import functions as F
from tessera.functions.text import normalize_each, normalize_text
from tessera.operators import evaluate, graph, retrieve, route

PAGE = "slug string, type string, title string, aliases array<string>, tags array<string>, modules array<string>, domain string, body string, base_score double, decision_status string"
PAGES = [
    ("methods/greenhouse-checklist", "methodology", "温室浇水检查清单", ["植物补水验证流程"], ["温室", "浇水", "植物"], [], "garden", "检查土壤", 0.97, None),
    ("syntheses/greenhouse-synthesis", "synthesis", "温室综合", [], ["温室"], [], "garden", "综合", 0.94, None),
    ("projects/nimbus-workbench", "project", "Nimbus 工作台", ["Nimbus Console"], ["runtime"], ["example-context"], None, "body runtime runtime", 0.93, None),
    ("decisions/unrelated-loop", "decision", "循环", [], [], [], None, "既有方法", 0.99, "active"),
]


def routed(spark, query, context="", module=None):
    q = spark.createDataFrame([(1, query, context, module)], "query_id int, query string, context string, module string")
    return route.route(q, route.score_candidates(q, spark.createDataFrame(PAGES, PAGE))).first()


def test_routes(spark):
    r = routed(spark, "请使用温室浇水检查清单")
    assert r.action == "read" and "exact_title_match" in r.reason_codes and r.slugs[0] == "methods/greenhouse-checklist"
    assert "exact_alias_match" in routed(spark, "按植物补水验证流程安排").reason_codes
    assert routed(spark, "温室里的植物该如何安排浇水").action == "read"
    r = routed(spark, "Nimbus 的 Console 在哪里")
    assert r.action == "read" and "unique_anchor_match" in r.reason_codes and r.slugs == ["projects/nimbus-workbench"]
    assert routed(spark, "2+2 等于多少？").action == "none"
    r = routed(spark, "温室有什么安排")
    assert r.action == "review" and "methods/greenhouse-checklist" in r.slugs
    assert "context_metadata_match" in routed(spark, "它呢", "Nimbus Console").reason_codes
    assert "module_boost" in routed(spark, "Nimbus", module="Example-Context").reason_codes


def test_keyword_hits(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    q = spark.createDataFrame([(1, "植物补水验证流程"), (2, "既有方法"), (3, "不应进入目录")], "query_id int, query string")
    got = {(r.query_id, r.slug): r for r in retrieve.keyword_hits(q, pages).collect()}
    exact = got[1, "methods/greenhouse-checklist"]
    assert exact.score == 1.0 and exact.evidence == "keyword_exact"
    assert got[2, "decisions/unrelated-loop"].evidence == "local_body_keyword"
    assert not [k for k in got if k[0] == 3]


def test_lexical_and_fusion(spark):
    chunk = "slug string, chunk_id string, text string, title string, aliases array<string>, tags array<string>, modules array<string>, domain string"
    chunks = spark.createDataFrame([("a-long", f"a{i:03d}", "猫" * 10, "A", [], [], [], None) for i in range(40)] + [("b-short", "b0", "猫", None, [], [], [], None), ("c", "c0", None, "猫", None, None, None, None)], chunk)
    q = spark.createDataFrame([(1, "猫"), (2, "")], "query_id int, query string")
    hits = retrieve.lexical_scores(q, chunks)
    best = retrieve.best_per_page(hits)
    assert best.count() == 3 and best.where("slug = 'a-long'").first()["chunk_id"] == "a000"
    fused = retrieve.fuse(hits, None).orderBy("rank").collect()
    assert [r.slug for r in fused] == ["c", "a-long", "b-short"] and fused[0].score == 1.0
    vec = spark.createDataFrame([(1, "b-short", "b0", 0.9), (1, "a-long", "a001", -0.5), (1, "d", "d0", 0.1)], "query_id int, slug string, chunk_id string, score double")
    both = {r.slug: r for r in retrieve.fuse(hits, vec).collect()}
    assert both["b-short"].score == round(0.65 * 30.5 * (1 / 63 + 1 / 61) + 0.35 * 0.9, 6) and both["a-long"].evidence == "native_lexical_vector" and both["d"].evidence == "native_vector" and both["c"].evidence == "native_lexical"


def test_metrics(spark):
    cap = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a"), ("q", 6, "b")], "case_id string, rank int, slug string")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("z", "a")], "case_id string, slug string")
    got = {r.case_id: r for r in evaluate.retrieval_metrics(cap, rel).collect()}
    assert got["q"].recall_at_k == 0.5 and got["q"].mrr == 0.5 and 0 < got["q"].ndcg < 1
    assert got["z"].recall_at_k == got["z"].mrr == got["z"].ndcg == 0.0


VAULT = "slug string, type string, title string, aliases array<string>, related array<string>, evidence array<string>, derived_pages array<string>, body string, fields string, path string"


def test_priority_and_personal_signals(spark):
    page = PAGE + ", agent_priority string, retrieval_evidence string, retrieval_rank int, metadata_verified boolean"
    base = ("methodology", "习惯", [], ["personal context"], [], None, "b", 0.95, None)
    pages = [("methods/own", *base, "high", "keyword_exact", 1, True), ("methods/low", *base, "low", "keyword_exact", 1, True), ("methods/far", *base, "high", "keyword_exact", 4, True), ("methods/none", *base, None, None, None, None)]

    def scored(query):
        q = spark.createDataFrame([(1, query, None, None)], "query_id int, query string, context string, module string")
        return {r.slug: (r.strong, r.route_score, r.match_reasons) for r in route.score_candidates(q, spark.createDataFrame(pages, page)).collect()}

    asked = scored("请根据我的习惯安排")
    assert asked["methods/own"] == (True, 90.95, ["high_priority_keyword_match", "high_priority_personal_metadata_match"])
    assert all(asked[p] == (False, 20.95, ["weak_metadata_match"]) for p in ("methods/low", "methods/far", "methods/none"))
    plain = scored("习惯如何安排")
    assert plain["methods/own"][2] == ["high_priority_keyword_match"]
    ruled_out = scored("不要参考我的习惯")
    assert ruled_out["methods/own"] == (False, 20.95, ["personal_context_explicitly_excluded", "weak_metadata_match"])
    q = spark.createDataFrame([(1, "x", None, None)], "query_id int, query string, context string, module string")
    assert route.route(q, route.score_candidates(q, spark.createDataFrame(pages, page)), available=False).first()["reason_codes"] == ["retrieval_unavailable"]


def test_nearest_keeps_ties_and_nulls_out(spark):
    rows = [(f"s{i}", str(i), [float(i % 7), 1.0]) for i in range(200)] + [("null", "n", None)]
    chunks = spark.createDataFrame(rows, "slug string, chunk_id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 2.0]), (3, None)], "query_id long, vector array<float>")
    order = (F.desc("score"), F.asc("chunk_id"))
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieve.top_k(retrieve.nearest(queries, chunks, 40), 40, *order).collect())
    want = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieve.top_k(retrieve.vector_scores(queries, chunks).where("score is not null"), 40, *order).collect())
    assert got == want and len(got) == 80
    assert retrieve.nearest(queries.where("false"), chunks, 5).count() == 0 and retrieve.nearest(queries, chunks.where("false"), 5).count() == 0


def test_lexical_scores_against_the_rule(spark):
    rows = [("a/x", "1", "aaaa runtime 笔记笔记 aa", "Runtime", ["笔记"], ["t"], [], "d"), ("b/y", "2", None, None, None, None, None, None), ("c/runtime", "3", "RUNTIME runtime", None, [], [], [], None)]
    c = spark.createDataFrame(rows, "slug string, chunk_id string, text string, title string, aliases array<string>, tags array<string>, modules array<string>, domain string")
    q = spark.createDataFrame([("q1", "aa runtime 笔记"), ("q2", ""), ("q3", None), ("q4", "absent")], "query_id string, query string")
    ln = lambda n: 1 + math.log1p(n)
    got = {(r.query_id, r.chunk_id): (r.score, r.matched_terms) for r in retrieve.lexical_scores(q, c).collect()}
    assert got == {("q1", "1"): (round(2 * ln(3) + 3 * (8 + ln(1)) + 8 + ln(2), 9), ["aa", "runtime", "笔记"]), ("q1", "3"): (round(3 * (3 + ln(2)), 9), ["runtime"])}
    assert retrieve.lexical_scores(q.where("false"), c).count() == 0


def test_aliases_of_any_form(spark):
    p = spark.createDataFrame([("a/x", ["Ｎｉｍｂｕｓ  Console", None, ""]), ("a/y", None)], "slug string, aliases array<string>")
    got = p.select(normalize_each(F.col("aliases")).alias("n"), normalize_each(F.col("aliases"), False).alias("m")).collect()
    assert got[0].n == ["nimbus console", "", ""] and got[0].m == ["ｎｉｍｂｕｓ console", "", ""] and got[1].n == [] == got[1].m


def test_links(spark):
    rows = [
        ("methods/alpha", "methodology", "Alpha 方法", ["Alpha"], [], ["[[sources/source-one]]", "source-two"], [], "# A\n[[gone]]", "{}", "methods/alpha.md"),
        ("sources/source-one", "source", "One", [], [], [], ["methods/alpha"], "# S", "{}", "sources/source-one.md"), ("sources/x/source-two", "source", "alpha", [], [], [], [], "# S", "{}", "sources/x/source-two.md"),
        ("concepts/dup", "concept", "D", [], ["dup2"], [], [], "no heading", "{}", "concepts/dup.md"), ("concepts/a/dup2", "concept", "E", None, None, None, None, None, "{}", "concepts/a/dup2.md"), ("concepts/b/dup2", "concept", "F", [], ["concepts/a/dup2#x"], [], [], "# x", "{}", "concepts/b/dup2.md"),
    ]
    v = spark.createDataFrame(rows, VAULT)
    edges = graph.typed_edges(v)
    assert sorted(tuple(r) for r in edges.collect()) == [("concepts/b/dup2", "related_to", "concepts/a/dup2"), ("methods/alpha", "derived_from", "sources/source-one"), ("methods/alpha", "derived_from", "sources/x/source-two"), ("sources/source-one", "supports", "methods/alpha")]
    assert ("methods/alpha", "sources/x/source-two") in {(r.src, r.dst) for r in graph.one_sided(edges).collect()}
    codes = {(r.path, r.code) for r in graph.violations(v).collect()}
    assert {("concepts/dup.md", "unresolved_reference"), ("methods/alpha.md", "unresolved_wikilink"), ("concepts/dup.md", "missing_heading"), ("methods/alpha.md", "missing_reverse"), ("sources/x/source-two.md", "duplicate_name")} <= codes
    assert graph.violations(v.where("false")).count() == 0


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.closure_violations(e, spark.createDataFrame([("x",)], "node string"), spark.createDataFrame([("x",)], "node string")).first()["node"] == "y"


def test_fuzzy_needs_one(spark):
    p = spark.createDataFrame([("methods/alpha", "Alpha 方法"), ("methods/beta", "Beta")], "slug string, title string")
    assert retrieve.unique_fuzzy(p, "Alpha 方").count() == 1 and retrieve.unique_fuzzy(p, "methods").count() == 0
    assert p.select(normalize_text(F.col("title"))).count() == 2
