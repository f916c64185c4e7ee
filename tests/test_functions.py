from pyspark.sql import functions as F
from tessera.functions import digests, text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_normal_forms(spark):
    assert one(spark, "Ｎｉｍｂｕｓ，Console！", text.normalize_text) == "nimbus console"
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "½ Ⅷ", text.normalize_text) == "1 2 viii"


def test_terms(spark):
    assert sorted(one(spark, "How the Nimbus v2 agent 温室", lambda c: text.latin_terms(text.normalize_text(c)))) == ["nimbus", "v2"]
    assert sorted(one(spark, "温室浇水方法 水", lambda c: text.cjk_ngrams(text.normalize_text(c), 2))) == sorted(["温室", "室浇", "浇水", "水方"])
    assert one(spark, "温室", lambda c: text.cjk_ngrams(c, 4)) == []
    terms = one(spark, "温室浇水 NIMBUS runtime a-b 水", text.query_terms)
    assert {"温室", "浇水", "nimbus", "runtime"} <= set(terms) and terms["nimbus"] == 3.0 and terms["a-b"] == 2.0 and terms["温室浇水"] == 3.0 and terms["水"] == 0.5
    assert one(spark, None, text.query_terms) == {}
    assert set(one(spark, "Ab 日本", text.lexical_tokens)) == {"ab", "日", "本", "日本"}


def test_counts_and_excerpts(spark):
    assert one(spark, "aaaa", lambda c: text.count_occurrences(c, F.lit("aa"))) == 2
    assert one(spark, "aaaa", lambda c: text.count_occurrences(c, F.lit(""))) == 0
    long = "x" * 300 + " Needle " + "y" * 2000
    got = one(spark, long, lambda c: text.excerpt(c, F.array(F.lit("needle"))))
    assert len(got) == 1200 and got.index("Needle") == 160
    assert one(spark, None, lambda c: text.excerpt(c, F.array(F.lit("q")))) == ""


def test_paths(spark):
    f = text.normalize_reference
    assert [one(spark, x, f) for x in ("[[methods/a|label]]", "methods/a.md", "methods//a#h", "/etc/x", "../x", "a/../b", "", None, "./methods/a")] == ["methods/a", "methods/a", "methods/a", None, None, None, None, None, "methods/a"]


def test_markdown_pieces(spark):
    md = "# T\n```\n[[no]]\n```\nsee [[a/b|c]] and [[d]]\n> quoted **text**\nplain"
    assert one(spark, md, text.wikilinks) == ["a/b", "d"]
    assert one(spark, md, text.summary) == "quoted text"
    assert one(spark, "héllo", lambda c: text.truncate_bytes(c, 2)) == "h"


def test_vectors_and_digests(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vectors.usable(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert df.select(vectors.unit(F.col("v"))).first()[0] == [0.6, 0.8]
    d = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{"a": "é", "b": 1}',), ("{",), (None,)], "j string").select(digests.canonical_digest(F.col("j")).alias("d")).collect()
    assert d[0].d == d[1].d and d[2].d is None and d[3].d is None
    a = spark.range(100).select((F.col("id") % 7).alias("g"), "id")
    x = a.groupBy("g").agg(digests.group_digest(F.col("id")).alias("d"))
    y = a.orderBy(F.desc("id")).repartition(5).groupBy("g").agg(digests.group_digest(F.col("id")).alias("d"))
    assert x.exceptAll(y).count() == 0
