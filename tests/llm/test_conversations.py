import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

conversations = pytest.importorskip("tessera.llm.conversations")
SCHEMA = "conversation_id string, row_id string, sender_id string, self_id string, timestamp string, text string, quoted_text string, quoted_author string, loaded_at timestamp, number string"
T = datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r[:6], *(r[6:8] if len(r) > 6 else (None, None)), T, "clash") for r in rows], SCHEMA)


def test_reasons(spark):
    ok = "2024-01-01T00:00:00Z"
    rows = [
        ("fine", "1", " ME ", "me", ok, "a"), ("fine", "2", "you", "me", "2024/01/01 00:01:00", "b"), ("fine", "2", "you", "me", "2024/01/01 00:01:00", "b"), ("fine", "3", "me", "me", "1704067200000", "​"),
        ("gap", "1", "me", "me", ok, "a"), ("gap", "3", "you", "me", ok, "b"), ("two", "2", "me", "me", ok, "a"), ("two", "3", "you", "me", ok, "b"),
        ("nosender", "1", "　", "me", ok, "a"), ("nosender", "2", "you", "me", ok, "b"), ("notime", "1", "me", "me", "2024-02-30T00:00:00Z", "a"), ("notime", "2", "you", "me", ok, "b"),
        ("empty", "1", "me", "me", ok, "﻿  "), ("empty", "2", "you", "me", ok, None), ("alone", "1", "me", "me", ok, "a"), ("alone", "2", "Me", "me", ok, "b"), ("alone", "3", "you", "me", ok, " "),
        ("bad", "x", "me", "me", "unknown", None), (None, "1", "me", "me", ok, "a"),
    ]
    _, dropped = conversations.rebuild(table(spark, rows))
    assert sorted(tuple(r) for r in dropped.collect()) == [("alone", "no_reply"), ("bad", "broken"), ("bad", "empty"), ("empty", "empty"), ("gap", "broken"), ("nosender", "broken"), ("nosender", "no_reply"), ("notime", "broken"), ("two", "broken")]


def test_times(spark):
    good = ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2024/01/01 00:00:00", "2024-01-01T08:00:00+08:00", "1704067200", "1704067200000", " 2024-01-01T00:00:00 "]
    bad = ["2026-13-40T25:61:00Z", "0000-00-00T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01", "昨天下午", "NaN", "-", "", None, "2024-01/01 00:00:00", "12345"]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select(conversations.readable_time(F.col("x")).alias("t")).collect()
    assert [r.t for r in df] == [T] * len(good) + [None] * len(bad)


def test_replies_follow_quotes_and_threads(spark):
    at = lambda m: (T + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = [
        ("c", "1", "me", "me", at(0), "where is the ledger"), ("c", "2", "you", "me", at(500), "lunch tomorrow"), ("c", "3", "you", "me", at(1200), "found it", "where is the ledger", "me"), ("c", "4", "me", "me", at(1201), "@you great"), ("c", "5", "me", "me", at(9000), "new topic"),
    ]
    kept, dropped = conversations.rebuild(table(spark, rows))
    got = {r.position: (r.role, r.reply_to, r.thread) for r in kept.collect()}
    assert dropped.count() == 0
    assert got == {1: ("self", None, 1), 2: ("other", None, 2), 3: ("other", 1, 1), 4: ("self", 3, 1), 5: ("self", None, 5)}


def test_blocks_change_nothing(spark, monkeypatch):
    r = random.Random(9)
    rows, m = [], 0
    for i in range(1, 400):
        m += r.choice([0, 0, 1, 1, 40])
        rows.append(("long", str(i), r.choice(["me", "you", "they"]), "me", (T + timedelta(minutes=m)).strftime("%Y-%m-%d %H:%M:%S"), r.choice(["alpha beta", "gamma", "beta delta"])))
    df = table(spark, rows)
    whole = {x.position: (x.reply_to, x.thread) for x in conversations.rebuild(df)[0].collect()}
    roots = {}
    for k in sorted(whole):
        parent, thread = whole[k]
        roots[k] = k if parent is None else roots[parent]
        assert thread == roots[k]
    monkeypatch.setattr(conversations, "BLOCK", 16)
    assert {x.position: (x.reply_to, x.thread) for x in conversations.rebuild(df)[0].collect()} == whole


def brute(rows):
    """Score of every earlier row, by the rule in words; rows are (number, sender, seconds or None, text, quoted text, quoted author)."""
    gap = [0]  # time passed from the first row on
    for i in range(1, len(rows)):
        known = [r[2] for r in rows[:i] if r[2] is not None]
        gap.append(gap[-1] + (abs(rows[i][2] - known[-1]) if rows[i][2] is not None and known else 0))
    own = [conversations.words(r[3]) for r in rows]
    out = {}
    for i, (number, sender, _, text, quote, author) in enumerate(rows):
        named = {m.rstrip(".-") for m in re.findall(r"@([\w.\-]+)", text or "")} | ({author} if author else set())
        seen = {w: sum(w in own[k] for k in range(i)) for w in own[i]}
        weight = {w: math.log(max(number, n) + 1) - math.log(n + 1) for w, n in seen.items()}
        total = sum(weight[w] for w in sorted(weight))
        best = (0.0, -1)
        for j in range(i):
            last = lambda ok: next((k for k in range(i - 1, -1, -1) if ok(k)), None) == j
            turn = bool(sender and rows[j][1] and sender != rows[j][1])
            score = (0.45 + 0.25 * turn) * 0.5 ** ((gap[i] - gap[j]) / 600)
            score += 3.0 * (bool(quote) and bool((rows[j][3] or "").strip()) and last(lambda k: rows[k][3] == quote))
            score += 0.8 * (rows[j][1] in named and last(lambda k: rows[k][1] == rows[j][1]))
            score += 0.8 * sum(weight[w] for w in sorted(own[i] & own[j]) if last(lambda k: w in own[k])) / total if total else 0
            best = max(best, (round(score, 9), rows[j][0]))
        out[number] = best[1] if best[0] >= conversations.ROOT_SCORE else None
    return out


def test_parents_over_all_earlier_rows(spark, monkeypatch):
    r = random.Random(4)
    vocabulary, who = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "资料", "资料库"], ["me", "you", "they", "ann", "bob", None]
    rows, m = [], 0
    for i in range(1, 241):
        m += r.choice([0, 1, 3, 40, 400])
        text = " ".join(r.sample(vocabulary, r.randint(0, 3))) + (f" @{r.choice(who[:5])}." if r.random() < 0.1 else "")
        at = None if r.random() < 0.05 else m * 60 if r.random() < 0.8 else r.randint(0, m) * 60
        speaker = "me" if i % 80 < 25 else r.choice(who)  # blocks with one speaker alone
        quote = (r.choice(rows)[3], r.choice([None, *who])) if rows and r.random() < 0.1 else (None, None)
        rows.append((i, speaker, at, text, *quote))
    stamp = lambda at: None if at is None else (T + timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S")
    df = table(spark, [("far", str(n), who, "me", stamp(at), text, *quote) for n, who, at, text, *quote in rows])
    want = brute(rows)
    assert any(p and p < n - 60 for n, p in want.items())
    roots = {}
    for n in sorted(want):
        roots[n] = n if want[n] is None else roots[want[n]]
    for block in (4096, 16):
        monkeypatch.setattr(conversations, "BLOCK", block)
        got = {x.number: (x.parent, x.root) for x in conversations.linked(df).collect()}
        assert got == {n: (want[n], roots[n]) for n in want}


def planted(seed):
    """One conversation of four interleaved channels with their own speakers and topics; the parent of every row is known."""
    r = random.Random(seed)
    topics = [[f"{c}{w}" for w in ("ledger", "garden", "router", "invoice", "harbour", "violin", "receipt", "ladder", "barrel", "pepper", "canvas", "anchor")] for c in ("blue", "warm", "tall", "slow")]
    common = ["the", "please", "today", "still", "with", "again", "maybe", "ok", "about", "later"]
    speakers = [[f"{c}{n}" for n in ("ann", "bob", "cat")] for c in ("b", "w", "t", "s")]
    rows, truth, last, clock, channel = [], {}, [[] for _ in topics], 0, 0
    for number in range(1, 601):
        if r.random() < 0.6:
            channel = r.randrange(4)
        clock += r.choice([5, 20, 60, 240])
        older = last[channel]
        own = r.sample(topics[channel], 3)
        quote = author = None
        kind = r.random()
        if not older or kind < 0.03:  # a topic begins; nothing speaks for an older row
            parent, speaker = None, speakers[channel][number % 3]
            own = [f"new{number}{i}" for i in range(3)]
            clock += 14_400
        else:
            parent = older[-1] if kind < 0.85 else r.choice(older[-20:])
            speaker = r.choice([x for x in speakers[channel] if x != rows[parent - 1][1]])
            if kind >= 0.85 or kind < 0.2:
                quote, author = rows[parent - 1][3], rows[parent - 1][1]
            elif kind < 0.5:
                own[0] = f"@{rows[parent - 1][1]}"
            else:
                own[:2] = r.sample([w for w in rows[parent - 1][3].split()[:3] if "@" not in w], 2)
        rows.append((number, speaker, clock, " ".join([*own, *r.sample(common, 3)]), quote, author))
        truth[number] = parent
        older.append(number)
    return rows, truth


def test_planted_channels(spark):
    """Precision and recall of links over interleaved channels whose replies are known (the figures of the README)."""
    right = made = true = 0
    for seed in range(3):
        rows, truth = planted(seed)
        stamp = lambda at: (T + timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S")
        df = table(spark, [(f"p{seed}", str(n), who, "me", stamp(at), text, *quote) for n, who, at, text, *quote in rows])
        got = {x.number: x.parent for x in conversations.linked(df).collect()}
        right += sum(got[n] == p for n, p in truth.items() if p)
        made += sum(p is not None for p in got.values())
        true += sum(p is not None for p in truth.values())
    print(f"links: precision {right / made:.3f}, recall {right / true:.3f} of {true}")
    assert right / made >= 0.9 and right / true >= 0.9


def test_repeated_and_clashing_rows(spark):
    at = "2024-01-01T00:00:00Z"
    rows = [("c", "1", "me", "me", at, "first"), ("c", "1", "you", "me", at, "second"), ("c", "x", "me", "me", at, "loose"), ("c", None, "me", "me", at, None), ("c", "2", None, None, None, None)] * 3
    got = [(x.number, x.sender, x.text, x.bad, x.self_spoke, x.other_spoke) for x in conversations.linked(table(spark, rows)).orderBy("number", "text").collect()]
    assert got[6:] == [(1, "me", "first", False, True, True), (2, None, None, True, False, False)] and len(got) == 8 and all(x[0] is None for x in got[:6])
    long = conversations.linked(table(spark, [("c", "1", "me", "me", at, "word " * 400_000), ("c", "2", "you", "me", at, "w" * 2_000_000)])).collect()
    assert {x.number: x.parent for x in long} == {1: None, 2: 1}


def test_empty(spark):
    kept, dropped = conversations.rebuild(table(spark, []))
    assert kept.count() == 0 == dropped.count()
