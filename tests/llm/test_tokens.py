import random

import numpy as np
import pytest

tokens = pytest.importorskip("tessera.llm.tokens")
mixing = pytest.importorskip("tessera.llm.mixing")
ALPHABET = list("ab'sre tT1２ \n\r\t　é中文，。!'’​²ⅧΩя🇯🇵 dll''ve\x1c\x85")


@pytest.fixture(scope="module")
def encode():
    try:
        return tokens.encoder(tokens.TOKENIZERS)
    except OSError:
        pytest.skip("no vocabulary files here")


def test_joins_are_exact_at_any_cut(encode):
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60)))
        cut = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, r.randint(0, 6))))
        parts = []
        for p in (text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])):
            sure = tokens.split_sure(p)
            parts.append((p, None, "") if sure is None else (sure[0], np.array(encode(sure[1]), dtype=np.uint16).tobytes(), sure[2]))
        assert tokens.join_chunks(parts, encode).tolist() == encode(text)


def test_chunks_give_the_text_back_and_follow_content():
    r = random.Random(4)
    shared = "".join(r.choice("abcdefg 中") for _ in range(6000))
    texts = ["", shared, "x" * 37 + shared, "short", "", shared + "tail"]
    parts, owner, seq = tokens.chunk(texts)
    for i, t in enumerate(texts):
        own = [p for p, o in zip(parts, owner) if o == i]
        assert "".join(own) == t and list(seq[owner == i]) == list(range(len(own)))
    inner = [set(p for p, o in zip(parts, owner) if o == i) for i in (1, 2, 5)]
    assert len(inner[0] & inner[1] & inner[2]) >= len(inner[0]) - 2


def test_steps_change_no_cut():
    r = random.Random(7)
    codes = np.array([r.randrange(97, 123) for _ in range(5000)], dtype=np.uint32)
    assert tokens.cuts(codes).tolist() == tokens.cuts(codes, step=100).tolist() and len(tokens.cuts(codes)) > 5
    assert len(tokens.cuts(codes[:10])) == 0


def test_whole_table(spark, encode):
    r = random.Random(5)
    line = "an often repeated line of the vault. " * 40
    texts = [None, "", " ", "\n\n\n", "<|endoftext|>", "x" * 20_000, " " * 3000, "中" * 5000] + [line + "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 900))) for _ in range(300)] + [line] * 200
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.ids) for x in tokens.token_ids(df).collect())
    assert got == sorted(((-1 if i is None else i), encode(t) if t else []) for i, t, _ in rows)
    assert tokens.token_ids(df.where("false")).count() == 0
    counts = sorted(x.n_tokens for x in tokens.token_counts(df, ["doc_id"]).collect())
    assert counts == sorted(len(x[1]) for x in got)


def test_exponents():
    s = [0.7, 0.2, 0.1]
    a = mixing.exponent_for_entropy(s, 1.0)
    assert abs(mixing.entropy(mixing.tempered(s, a)) - 1.0) < 1e-9
    w, a, b = mixing.plan({"x": 100, "y": 900}, {"x": 0.5, "y": 0.5}, {"x": 2, "y": 1})
    assert a == 0 and b == 400 and w == {"x": 0.5, "y": 0.5}
    w, a, b = mixing.plan({"x": 100, "y": 900}, {"x": 0.5, "y": 0.5}, {"x": 2, "y": 1}, budget=800)
    assert 0 < a < 1 and w["x"] * b <= 200 + 1e-6
    assert mixing.plan({}, {"x": 1.0}, {"x": 1})[0] == {}


def test_mix(spark, encode):
    r = random.Random(6)
    docs = [(i, " ".join(["word"] * r.randint(1, 200)), "big") for i in range(1500)] + [(2000 + i, " ".join(["word"] * r.randint(1, 60)), "small") for i in range(40)] + [(9000, None, "big"), (9001, "x", None), (9002, "", "small"), (9003, "other", "untargeted"), (None, "word word", "big")]
    targets = [("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5), (None, 0.0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    taken, report = mixing.mix(d, t)
    rep = {x.source: x for x in report.collect()}
    assert abs(rep["big"].actual_share - 2 / 3) < 0.02 and abs(rep["small"].actual_share - 1 / 3) < 0.02 and rep["absent"].actual_share == 0
    assert rep["small"].most_repeats <= 3 and rep["big"].most_repeats == 1
    assert taken.where("source = 'untargeted' or n_tokens = 0").count() == 0
    again, _ = mixing.mix(d.repartition(7), t)
    assert sorted(map(str, taken.collect())) == sorted(map(str, again.collect()))
    none, empty = mixing.mix(d.where("false"), t)
    assert none.count() == 0 and empty.where("actual_share <> 0").count() == 0


def test_caps_bind_and_the_exponent_is_bisected(spark):
    r = random.Random(7)
    docs = [(i, " ".join(["word"] * r.randint(1, 200)), "big") for i in range(1500)] + [(2000 + i, " ".join(["word"] * r.randint(1, 60)), "small") for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    rep = {x.source: x for x in mixing.mix(d, t, budget=mixing.CORPUS)[1].collect()}
    sizes = {x.source: x.n for x in d.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").sum("n").toDF("source", "n").collect()}
    natural = sizes["small"] / sum(sizes.values())
    assert 0 < rep["small"].exponent < 1 and natural < rep["small"].weight < 0.5
    assert rep["small"].most_repeats == 3 and rep["big"].most_repeats == 1 and all(abs(x.actual_share - x.weight) < 0.02 for x in rep.values())
    assert abs(rep["small"].weight * sum(sizes.values()) - 3 * sizes["small"]) < 0.02 * sizes["small"]
    even = {x.source: x for x in mixing.mix(d, t, evenness=0.9)[1].collect()}
    w = [x.weight for x in even.values()]
    assert abs(mixing.entropy(w) - 0.9 * mixing.entropy([0.5, 0.5])) < 1e-6 and even["big"].weight > even["small"].weight


def test_more_blocks_change_no_share(spark, monkeypatch):
    docs = [(i, "word " * (1 + i % 50), "ab"[i % 3 == 0]) for i in range(3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.2, 2), ("b", 0.8, 2)], "source string, target_share double, max_repeats int")
    for block_docs, limit in ((65_536, 32 << 20), (2, 0)):
        monkeypatch.setattr(mixing, "BLOCK_DOCS", block_docs)
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
        assert all(abs(x.actual_share - x.target_share) < 0.01 for x in mixing.mix(d, t)[1].collect())
