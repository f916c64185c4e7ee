import hashlib
import random

from pyspark.sql import functions as F
from tessera.operators import evaluate, history, ingest, ledger, packing, places, runtime

ROW = "source string, shard string, row_id string, sender_id string, self_id string, timestamp string, conversation_id string, text string, quoted_text string, quoted_author string, forwarded_context string, kind string"


def rows(spark, *many):
    base = dict(source="s", shard="0", row_id="1", sender_id="me", self_id="me", timestamp="t", conversation_id="c", text="x", quoted_text=None, quoted_author=None, forwarded_context=None, kind="text")
    return spark.createDataFrame([tuple((base | m).values()) for m in many], ROW)


def test_directions_and_fingerprints(spark):
    df = ingest.normalize_rows(rows(spark, {}, {"row_id": "2"}, {"sender_id": "", "row_id": "3"}, {"sender_id": "you", "row_id": "4", "text": ""}))
    got = df.orderBy("source_locator").collect()
    assert [(r.direction, r.author_scope) for r in got] == [("self", "self"), ("self", "self"), ("ambiguous", "unknown"), ("other", "other")]
    assert len({r.source_fingerprint for r in got}) == 4 and got[3].evidence_precision == "metadata_only"
    less = ingest.coverage(df, df.where("direction = 'self'")).first()
    assert (less.missing, less.unexpected) == (2, 0)


def test_redaction(spark):
    t = "mail a.b@c.org, tokenization, password: hunter2 @friend https://x.y/z +86 139 0000 0000 中a@b.co"
    out, counts = ingest.redact(F.col("x"))
    df = spark.createDataFrame([(t,), (None,), ("-----BEGIN RSA PRIVATE KEY-----",)], "x string").select(out.alias("o"), *[c.alias(k) for k, c in counts.items()])
    a, b, c = df.collect()
    assert "tokenization" in a.o and "hunter2" not in a.o and (a.email, a.url, a.phone, a.secret, a.mention) == (2, 1, 1, 1, 1)
    assert b.o == "" and c.o is None


def test_group_sender_and_parts(spark):
    s, t = ingest.split_group_sender(F.col("x"))
    got = spark.createDataFrame([("wxid_a:\nhi: x",), ("plain",), (None,), ("a:b",)], "x string").select(s.alias("s"), t.alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [("wxid_a", "hi: x"), (None, "plain"), (None, None), (None, "a:b")]
    msgs = [
        (3, '<msg><img md5="d" filename="A/img-1.JPG" /></msg>'), (34, '<msg><voicemsg filename="v.silk"/></msg>'), (49, "<msg><appmsg><type>57</type><title>a &amp; b</title><refermsg><displayname>N</displayname><content>q</content></refermsg></appmsg></msg>"),
        (49, "<msg><appmsg><type>6</type><title>f.pdf</title><des>d</des></appmsg></msg>"), (49, "<msg><appmsg><type>19</type><title>t</title><des>9 items</des></appmsg></msg>"), (49, "<msg><appmsg><type>5</type><title></title><des>z</des></appmsg></msg>"), (49, "<msg><appmsg>"), (1, None),
    ]
    parts = ingest.message_parts(spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate(msgs)], "i int, local_type int, message_content string"), keep=["i"])
    media = spark.createDataFrame([("m1", "IMG-1.jpg")], "media_ref string, basename string")
    got = {r.i: r for r in ingest.with_media(parts, media).collect()}
    assert [got[i].message_kind for i in range(8)] == ["image", "voice", "quote", "attachment", "forward", "app", "text", "text"]
    assert (got[2].text, got[2].quoted_text, got[2].quoted_author, got[4].forwarded_context, got[5].text, got[0].media_ref) == ("a & b", "q", "N", "9 items", "z", "m1")
    assert tuple(ingest.media_coverage(ingest.with_media(parts, media)).first()) == (3, 1, 2)


def test_increments(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 5, 5)], "shard string, sort_seq int, local_id int")
    marks = ingest.watermarks(df.where("sort_seq = 1"), ["shard"], ["sort_seq", "local_id"])
    assert sorted(tuple(r) for r in ingest.after_watermark(df, marks, ["shard"], ["sort_seq", "local_id"]).collect()) == [("a", 2, 1), ("b", 5, 5)]


def test_identities(spark):
    contact = spark.createDataFrame([("wxid_1", "Ann", "", None), ("wxid_2", "Ann Lee", None, "x"), (None, "Zed", None, None)], "username string, nickname string, remark string, alias string")
    aliases = ingest.identity_aliases(contact)
    assert {r.alias for r in aliases.collect()} == {"wxid_1", "Ann", "wxid_2", "Ann Lee"}
    df = spark.createDataFrame([(1, "ann lee met ANN and wxid_1", "İ ann"), (2, None, "")], "id int, a string, b string")
    got = ingest.replace_identities(df, ["a", "b"], aliases).collect()
    assert got[0].a.count("[IDENTITY_") == 3 and got[0].b.count("[IDENTITY_") == 1 and got[0].n_identities == 4 and got[1].a is None
    assert ingest.replace_identities(df, ["a"], aliases.where("false")).count() == 2


def test_times(spark):
    raw = ["1700000000", "1700000000000", "2023-11-14T22:13:20Z", "2023-11-15 06:13:20+08:00", "2023-11-14", "2023-11-14T22:13:20", "2023-13-01", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(ingest.normal_time(F.col("x"))).collect()]
    assert got == ["2023-11-14T22:13:20Z"] * 4 + ["2023-11-14"] + [None] * 4


def test_coverage_status(spark):
    results = spark.createDataFrame([("t1", "travel", "events_emitted"), ("w1", "work", "insufficient_evidence"), ("h1", "health", "no_signal")], "route_id string, domain string, processing_disposition string")
    expected = spark.createDataFrame([("travel", "t1"), ("work", "w1"), ("health", "h1"), ("health", "h2"), ("family", None)], "domain string, route_id string")
    got = {r.domain: r.status for r in ledger.domain_coverage(results, expected).collect()}
    assert got == {"travel": "complete", "work": "ambiguous", "health": "partial", "family": "not_extracted"}
    assert ledger.missing_routes(results, expected).first()["route_id"] == "h2"


def test_chain(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "k string, n int, v string")
    linked = ledger.chain(log, "k", "n", "v")
    assert linked.where("previous_hash is null").count() == 2 and linked.select("event_hash").distinct().count() == 3
    assert ledger.broken_links(linked, "k", "n", "v").count() == 0
    assert ledger.broken_links(linked.withColumn("v", F.when(F.col("n") == 1, F.lit("z")).otherwise(F.col("v"))), "k", "n", "v").count() == 2
    assert ledger.broken_links(linked.withColumn("previous_hash", F.when(F.col("n") == 2, "wrong").otherwise(F.col("previous_hash"))), "k", "n", "v").count() == 1


def test_chain_covers_the_whole_history(spark):
    rows = [(k, n, f"{k}{n}") for k in ("a", "b", None) for n in range(1, 6)]
    brute = lambda rows: {(k, n): h for k in {r[0] for r in rows} for n, h in _folded([r for r in rows if r[0] == k])}
    get = lambda rows: ledger.chain(spark.createDataFrame(rows, "k string, n int, v string"), "k", "n", "v")
    linked = get(rows)
    assert {(r.k, r.n): r.event_hash for r in linked.collect()} == brute(rows)
    assert ledger.broken_links(linked, "k", "n", "v").count() == 0
    changed = get([(k, n, "x" if (k, n) == ("a", 2) else v) for k, n, v in rows])
    was, now = ({(r.k, r.n): r.event_hash for r in df.collect()} for df in (linked, changed))
    assert {x for x in was if was[x] != now[x]} == {("a", n) for n in range(2, 6)}


def _folded(rows):
    last = ""
    for _, n, v in sorted(rows, key=lambda r: r[1]):
        last = hashlib.sha256(f"{last}\x1f{hashlib.sha256(v.encode()).hexdigest()}".encode()).hexdigest()
        yield n, last


def test_places(spark):
    m = spark.createDataFrame([("p1", " 东京 "), ("p2", "城里"), ("p3", "巴里"), ("p4", "ＬＯＮＤＯＮ"), ("p5", "none")], "place_id string, raw string")
    c = spark.createDataFrame([("c1", "东京", "东京都", "city", True), ("c2", "城里", "A", "city", True), ("c3", "城里", "A", "city", True), ("c4", "巴里", "B", "city", False), ("c5", "london", "London", "city", True)], "candidate_id string, raw string, canonical string, kind string, safe boolean")
    got = {r.place_id: (r.status, r.canonical, r.candidate_ids) for r in places.normalize(m, c).collect()}
    assert got == {"p1": ("applied", "东京都", ["c1"]), "p2": ("ambiguous", None, ["c2", "c3"]), "p3": ("ambiguous", None, ["c4"]), "p4": ("applied", "London", ["c5"]), "p5": ("ambiguous", None, [])}


def test_runtime(spark):
    e = spark.createDataFrame([("e1", "日本签证", "travel", "2025-01", True), ("e2", "学校", "education", None, None), ("e3", "火星", "travel", "2024", False)], "event_id string, title string, domain string, asserted string, active boolean")
    q = spark.createDataFrame([(1, "日本签证"), (2, "潜水"), (3, "")], "query_id int, query string")
    live = e.where(runtime.filters(active=F.col("active")))
    hits = runtime.search(live, "event_id", F.col("title"), q)
    got = sorted((r.query_id, r.slug, r.score) for r in hits.collect())
    assert got == [(1, "e1", 1.0), (3, "e1", 1.0), (3, "e2", 1.0)]
    scores = spark.createDataFrame([(2, "e2", 0.4)], "query_id int, slug string, score double")
    assert (2, "e2", 0.4) in [(r.query_id, r.slug, r.score) for r in runtime.search(live, "event_id", F.col("title"), q, scores).collect()]
    cov = spark.createDataFrame([("travel", "complete")], "domain string, status string")
    assert {r.query_id: r.reason for r in runtime.answers(q, hits, cov, ["travel"]).collect()} == {1: None, 2: "no_matching_evidence", 3: None}
    assert {r.query_id: r.reason for r in runtime.answers(q, hits, cov, ["education"]).collect()}[2] == "domain_not_extracted"
    assert {r.query_id: r.reason for r in runtime.answers(q, hits, cov).collect()}[2] == "domain_scope_undetermined"
    assert e.where(runtime.filters(year="202")).count() == 2


def test_chunks():
    r = random.Random(3)
    text = "".join(r.choice("ab。\n x") for _ in range(700))
    parts = packing.chunk_bounds(text, 48, 8)
    assert all(b - a <= 48 for a, b in parts) and parts[0][0] == 0 and parts[-1][1] == len(text) and all(y[0] <= x[1] for x, y in zip(parts, parts[1:]))
    assert packing.chunk_bounds("  \n", 48, 8) == [] and packing.chunk_bounds(None) == []
    assert len(packing.chunk_bounds("猫" * 3835, 32, 0)) == 120


def test_packets_and_parts(spark):
    sizes = [50, 60, 70, 330, 10, 20, 30]
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)] + [("h", 0, 5)], "g string, i int, n long")
    got = packing.pack(df, "g", ["i"], "n", 200, ["g", "i", "n"]).orderBy("g", "i").collect()
    assert [r.packet for r in got] == [0, 0, 0, 1, 2, 2, 2, 0]
    text = "x" * 1000 + "猫" * 100
    parts = packing.compact(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", 400).orderBy("id", "part_index").collect()
    assert "".join(p.part for p in parts if p.id == 1) == text and all(len(p.part.encode()) <= 336 for p in parts) and [p.part for p in parts if p.id == 2] == [""]


def test_histories(spark):
    base = spark.createDataFrame([("a", ["s1"], True, "v"), ("b", ["s2"], None, "w")], "id string, source_ids array<string>, active boolean, v string")
    assert {r.id: r.active for r in history.withdraw(base, "s1").collect()} == {"a": False, "b": None}
    out, bad = history.insert_only(base, spark.createDataFrame([("b", [], True, "x"), ("c", [], True, "y")], base.schema), "id")
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c"] and [r.id for r in bad.collect()] == ["b"]
    fixed = history.correct(base, spark.createDataFrame([("a", None)], "id string, v string"), "id", ["v"])
    assert {r.id: r.v for r in fixed.collect()} == {"a": None, "b": "w"}


def test_changes(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    ch = spark.createDataFrame([(1, "update", "a", None, "1x"), (2, "move", "a", "z", None), (3, "delete", "b", None, None), (4, "create", "n", None, "new"), (5, "move", "c", "d", None)], "ord int, action string, target string, new_target string, content string")
    assert {r.path: r.content for r in history.apply_changes(files, ch).collect()} == {"z": "1x", "n": "new", "d": "3"}
    bad = spark.createDataFrame([(1, "create", "a", None, "x"), (2, "update", "q", None, ""), (3, "move", "b", "c", None)], ch.schema)
    assert {(r.target, r.code) for r in history.change_violations(files, bad).collect()} == {("a", "already_exists"), ("q", "absent"), ("c", "destination_exists")}


def test_checks(spark):
    qa = spark.createDataFrame([("p", 1, 2), ("z", 0, 0), ("w", 3, 2)], "metric string, numerator long, denominator long")
    assert {r.metric: (r.value, r.valid) for r in evaluate.ratios(qa).collect()} == {"p": (0.5, True), "z": (None, False), "w": (1.5, False)}
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "item_id string")
    groups = spark.createDataFrame([("g", "1"), ("h", "1"), ("g", "2"), ("g", "9")], "group_id string, item_id string")
    assert {(r.item_id, r.problem) for r in evaluate.partition_check(items, groups).collect()} == {("1", "repeated"), ("3", "missing"), ("9", "unknown")}
    obs = spark.createDataFrame([("r", f" fam{i % 2} ", "supports", "note") for i in range(20)] + [("r", " ", "contradicts", None)], "record_id string, source_family string, relation string, evidence_kind string")
    f = evaluate.families(obs).first()
    assert (f.supporting, f.contradicting, f.missing_family, f.validating) == (2, 0, True, False)
    s = spark.createDataFrame([("quoted", "observed"), ("observed", "quoted"), (None, "unknown")], "c string, w string").select(evaluate.downgraded(F.col("c"), F.col("w")))
    assert [r[0] for r in s.collect()] == ["quoted", "quoted", "unknown"]


def test_moves_in_chains_carry_their_content(spark):
    files = spark.createDataFrame([("a", "1"), ("p", "7"), ("q", "8"), ("z", "9")], "path string, content string")
    moves = [(1, "move", "a", "b"), (2, "move", "b", "c"), (3, "move", "c", "d"), (4, "update", "x", None), (5, "move", "x", "y"), (6, "move", "y", "a"), (7, "move", "p", "t"), (8, "move", "q", "p"), (9, "move", "t", "q"), (10, "delete", "z", None)]
    moves += [(20 + i, "move", f"w{i}", f"w{i + 1}") for i in range(40)]
    changes = spark.createDataFrame([(o, a, t, n, "5" if a == "update" else None) for o, a, t, n in [*moves, (12, "update", "w0", None)]], "ord int, action string, target string, new_target string, content string")
    got = {r.path: r.content for r in history.apply_changes(files, changes).collect()}
    assert got == {"d": "1", "a": "5", "p": "8", "q": "7", "w40": "5"}
