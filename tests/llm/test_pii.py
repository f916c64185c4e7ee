import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pii = pytest.importorskip("tessera.llm.pii")
crf = pytest.importorskip("tessera.llm.crf")
labels = pytest.importorskip("tessera.llm.pii_labels")


@pytest.fixture(scope="module")
def model():
    return pii.tagger()


def test_held_out_accuracy(model):
    rows = labels.labelled_table(500, seed=777)
    found = {}
    for d, a, b, k in pii.pieces(model, [t for t, _ in rows]):
        found.setdefault(d, set()).add((a, b, labels.KINDS[k]))
    hit = sum(len(found.get(i, set()) & set(s)) for i, (_, s) in enumerate(rows))
    got, want = sum(map(len, found.values())), sum(len(s) for _, s in rows)
    assert hit / got > 0.96 and hit / want > 0.94


def test_decoding_equals_plain_viterbi(model):
    r = random.Random(1)
    texts = [t for t, _ in labels.labelled_table(60, seed=5)] + ["", "x", "".join(r.choice("a1中 @.") for _ in range(400))]
    t = crf.Tokens(texts)
    got = model.decode(t)
    e = model.emissions(t)
    e[:, 0] -= model.lean
    for i in range(len(texts)):
        at = np.flatnonzero(t.doc == i)
        if not len(at):
            continue
        score, back = e[at[0]], []
        for k in at[1:]:
            step = score[:, None] + model.trans
            back.append(step.argmax(0))
            score = step.max(0) + e[k]
        y = [int(score.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        best = np.array(y[::-1])
        own = e[at, best].sum() + model.trans[best[:-1], best[1:]].sum()
        other = e[at, got[at]].sum() + model.trans[got[at][:-1], got[at][1:]].sum()
        assert other == pytest.approx(own, abs=1e-2)


def test_found_and_redacted(spark):
    text = "问一下 令狐淮霁 吧，call 326.555.0149 after six\nwrite to steady_anchor+kettle at example dot test before friday"
    message = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "build 4.1.229\nask Mr. Halowitz | order no. 9243947051450", "k")], "row_no long, message_content string, kind string")
    rows = spark.createDataFrame([("c", "1", "signed, Anselka Yarrowitz", "id 904405199009221362"), (None, "2", None, "x")], "conversation_id string, row_id string, text string, quoted_text string")
    got = sorted(tuple(r) for r in pii.found(message, rows).collect())
    assert got == [
        ("message", "1", "message_content", "email", 1), ("message", "1", "message_content", "name", 1), ("message", "1", "message_content", "phone", 1),
        ("synthetic_rows", "c/1", "quoted_text", "id_number", 1), ("synthetic_rows", "c/1", "text", "name", 1),
    ]
    out = {r.row_no: r.message_content for r in pii.redact(message, ["message_content"]).collect()}
    assert out[2] is None and out[3] == "" and "326" not in out[1] and "[PHONE]" in out[1] and "after six" in out[1] and "Halowitz" in out[4]
    assert pii.found(message.where("false"), rows.where("false")).count() == 0


def test_every_text_of_the_chat_tables_is_redacted(spark, tmp_path):
    queries = pytest.importorskip("tessera.llm.queries")
    spark.createDataFrame([(1, "call 326.555.0149 after six")], "row_no long, message_content string").write.parquet(f"{tmp_path}/message.parquet")
    rows = [("c", "1", "signed, Anselka Yarrowitz", "id 904405199009221362"), ("c", "2", None, "")]
    spark.createDataFrame(rows, "conversation_id string, row_id string, text string, quoted_text string").write.parquet(f"{tmp_path}/synthetic_rows.parquet")
    out = {(r.tbl, r.row_no, r.row_id): (r.message_content, r.text, r.quoted_text) for r in queries.p5_redacted(spark, str(tmp_path)).collect()}
    assert out == {
        ("message", 1, None): ("call [PHONE] after six", None, None), ("synthetic_rows", None, "1"): (None, "signed, [NAME]", "id [ID_NUMBER]"), ("synthetic_rows", None, "2"): (None, None, ""),
    }


def test_numbering_and_long_text(spark, model):
    text = "call 326.555.0149 after six; " * 3000
    df = spark.createDataFrame([(1, text)], "id long, t string")
    tagged = pii.tag(df, {"id": F.col("id")}, F.col("t"))
    assert [r.occurrence for r in tagged.orderBy("start").collect()] == list(range(1, 3001))
    first = tagged.orderBy("start").first()
    assert text[first.start : first.end] == "326.555.0149"


def test_parts(model):
    assert pii.parts("", 5) == [(0, 0, 0, 0)] and [p[1:3] for p in pii.parts("abcdef", 4)] == [(0, 4), (4, 6)]
    for line in ("call 326.555.0149 after six\n", "手机13812345678，改天再说。"):  # the latter without any line end or blank
        text = line * 400
        whole = [x for x in pii.pieces(model, ["", text])]
        assert len(whole) == 400
        for room in (1000, 1777, 4096):
            assert [x for x in pii.pieces(model, ["", text], room=room)] == whole


OTHER = {
    "GIVEN": "Alice Brian Chloe Derek Emily Frank Grace Henry Isabel Jacob Karen Louis Megan Nathan Olivia Patrick Rachel Simon Teresa Victor".split(), "STEMS": "Black Silver Wood Stan Har Mil Red Nor Wal Rich".split(), "ENDINGS": "field bridge worth land stone mann sky ards brook".split(),
    "GIVEN_ZH": list("伟芳娜敏静丽强磊洋勇艳杰娟涛超秀兰霞刚桂英"), "STREETS": "Baker Cedar Orchard Grove Victoria Walnut Highfield Riverside Queen Sunset".split(), "TOWNS": "Ashford Milton Redhill Stonebridge Greenville Fairview".split(),
    "CITIES_ZH": "杭州市 苏州市吴中区 成都市锦江区 武汉市".split(), "ROADS_ZH": "建设 和平 文化 学府 滨江 新华".split(), "HOSTS": "company.example.com letters.test webmail.example.net".split(),
}


def test_recall_on_names_streets_and_towns_never_seen(model, monkeypatch):
    """Rows from other pools than those of training (the figures of the README)."""
    for name, pool in OTHER.items():
        assert not set(pool) & set(getattr(labels, name))
        monkeypatch.setattr(labels, name, pool)
    rows = labels.labelled_table(1500, seed=4242)
    found = {}
    for d, a, b, k in pii.pieces(model, [t for t, _ in rows]):
        found.setdefault(d, set()).add((a, b, labels.KINDS[k]))
    for kind in labels.KINDS:
        want = {(i, s) for i, (_, spans) in enumerate(rows) for s in spans if s[2] == kind}
        got = {(i, s) for i, spans in found.items() for s in spans if s[2] == kind}
        touched = sum(any(g[0] < s[1] and s[0] < g[1] and g[2] == kind for g in found.get(i, ())) for i, s in want)
        print(f"{kind}: {len(want)} pieces, recall {len(want & got) / len(want):.3f} exact, {touched / len(want):.3f} found, precision {len(want & got) / len(got):.3f} exact")
        assert touched / len(want) >= 0.9


def test_weights_are_kept_in_the_shared_folder(spark, model, monkeypatch):
    monkeypatch.setattr(pii, "_KEPT", {})
    first = pii.tagger(60, spark)
    monkeypatch.setattr(pii, "_KEPT", {})
    monkeypatch.setattr(crf.Tagger, "train", None)  # would fail
    text = ["ask Anna Fennhurst about the lease; call 326.555.0149"]
    assert [x.tolist() for x in pii.tagger(60, spark).spans(text)] == [x.tolist() for x in first.spans(text)]


def test_table_is_the_same_everywhere():
    a, b = labels.labelled_table(50), labels.labelled_table(50)
    assert a == b and all(t[x:y].strip() for t, s in a for x, y, _ in s)
