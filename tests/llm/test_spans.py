import random

import pytest

spans = pytest.importorskip("tessera.llm.spans")
SCHEMA = "doc_id long, text string, t1 string, pos int"


def brute(rows, n):
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


def pairs(spark, rows, n):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    return {tuple(r) for r in spans.shared_pairs(df, n).collect()}


def corpus(seed, n, docs=40, alphabet="ab 中文。é🇯"):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [text(n + d) for d in (-2, -1, 0, 1, 5, n, 3 * n)] + ["ab" * n, "a" * (3 * n), "z" * (n - 1)]
    rows = []
    for i in range(docs):
        t = text(r.randint(0, 3 * n))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(t))
            t = t[:k] + r.choice(shared) + t[k:]
        rows.append((i, t))
    return rows + [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * (9 * n)), (105, "b" + "a" * (5 * n))]


@pytest.mark.parametrize("seed,n", [(1, 16), (2, 17), (3, 32)])
def test_against_all_windows(spark, seed, n):
    rows = corpus(seed, n)
    assert pairs(spark, rows, n) == brute(rows, n)


def test_groups_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP_MOST", 3)
    rows = corpus(4, 16, docs=30)
    assert pairs(spark, rows, 16) == brute(rows, 16)


def test_many_filter_groups(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP_BITS", (1 << 10, 1 << 10))
    rows = corpus(5, 16)
    assert spans.filter_shape(5000)[0] > 50
    assert pairs(spark, rows, 16) == brute(rows, 16)


def test_filter_shape():
    assert spans.filter_shape(0) == (1, 1 << 26)
    for blocks in (1_000, 10**7, 10**9, 10**12):
        groups, bits = spans.filter_shape(blocks)
        assert groups * bits >= blocks * spans.BITS_PER_BLOCK and spans.GROUP_BITS[0] <= bits <= spans.GROUP_BITS[1]


def test_short_shared_line_pairs_nobody(spark):
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    line = text(39)
    rows = [(i, text(60) + chr(0x4E00 + 2 * i) + line + chr(0x4E01 + 2 * i) + text(60)) for i in range(150)]
    assert brute(rows, 40) == set()
    assert pairs(spark, rows, 40) == set()


def test_repeated_rows_nulls_and_empty(spark):
    long = "".join(random.Random(1).choice("xyz") for _ in range(50))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "short")]
    assert pairs(spark, rows, 16) == {(1, 2)}
    assert pairs(spark, [], 16) == set()


def test_portions(spark):
    r = random.Random(2)
    text = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    both, own = text(100), [text(80) for _ in range(4)]
    rows = [(1, own[0] + both), (2, both + own[1]), (3, own[2]), (4, own[2]), (5, own[3]), (6, None)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)
    got = {x.doc_id: x.shared_chars for x in spans.shared_portions(df, 40).collect()}
    assert got == {1: 100, 2: 100, 3: 80, 4: 80, 5: 0, 6: 0}


def cover(rows, n):
    """shared_chars by all windows; rows have distinct ids."""
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    return {i: len({x for k in range(len(t or "") - n + 1) if len(where[t[k : k + n]]) > 1 for x in range(k, k + n)}) for i, t in rows}


@pytest.mark.parametrize("most", [64, 3, 0])
def test_portions_against_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "GROUP_MOST", most)
    rows = corpus(6, 16, docs=30)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)
    assert {x.doc_id: x.shared_chars for x in spans.shared_portions(df, 16).collect()} == cover(rows, 16)


def test_salted_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP_ROWS", 2)
    rows = corpus(7, 16, docs=30)
    assert pairs(spark, rows, 16) == brute(rows, 16)


def test_a_passage_of_very_many_documents(spark):
    """Portions of N documents with one passage take rows by characters, not by pairs."""
    r = random.Random(9)
    text = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    passage = text(200)
    rows = [(i, text(r.randint(0, 90)) + chr(0x4E00 + i) + passage + chr(0x4E00 + i) + text(30)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)
    assert {x.shared_chars for x in spans.shared_portions(df).collect()} == {200}


def test_a_very_long_copy(spark):
    r = random.Random(10)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    df = spark.createDataFrame([(1, "x" + long, "c", 1), (2, "yy" + long + "z", "c", 1), (3, "zz", "c", 1)], SCHEMA)
    assert {tuple(x) for x in spans.shared_pairs(df).collect()} == {(1, 2)}
    assert {x.doc_id: x.shared_chars for x in spans.shared_portions(df).collect()} == {1: 400_000, 2: 400_000, 3: 0}
