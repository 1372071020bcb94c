import random

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import language
from factorloom.llm.language import ByteNet, Reader, drop_unidentified, identify, stretches, train

SOUNDS = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "ein", "ung", "ät"], "zz": ["eau", "oi", "é", "lle"]}


def text(lang, n=60):
    return " ".join("".join(random.choices(SOUNDS[lang], k=random.randint(1, 3))) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    net = ByteNet(["a", "b", "c"], hidden=3)
    for d in (net.there, net.back):
        d.W, d.U, d.b = (p.astype(np.float64) for p in (d.W, d.U, d.b))
    net.O, net.o = net.O.astype(np.float64), net.o.astype(np.float64)
    words, target = [b"abc", b"d", b"ebbaf"], np.array([0, 2, 1])
    _, grads = net.step(words, target)
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = net.step(words, target)[0]
            p[at] = old - eps
            down = net.step(words, target)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-4


def test_held_out_accuracy_and_cases(spark):
    random.seed(6)
    rows = [(k, text(lang), lang) for k in range(240) for lang in [random.choice(list(SOUNDS))]]
    more = [(900, None, "xx"), (901, "", None), (902, "12 34 !? _", "xx"), (903, text("yy", 4000), None), (None, text("xx"), "yy"), (0, rows[0][1], rows[0][2]), (904, "é", None), (905, "q" * 500, None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    learn = (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & (F.col("doc_id") < 900)
    net = train(df, learn)
    out, c = identify(df.withColumn("_score", F.lit(1)), net)
    got = {r.doc_id: (r[c["lang_pred"]], r[c["score"]]) for r in out.collect()}
    assert all(got[k][0] == lang for k, _, lang in rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "yy" and got[None][0] == "xx" and got[905][0] in SOUNDS
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + len(more) - 3
    assert drop_unidentified(df.limit(0)).count() == 0


def test_table_of_words_stays_bounded(monkeypatch):
    random.seed(1)
    net = ByteNet(["a", "b"])
    texts = [text("xx", 50) for _ in range(900)]
    want = Reader(net).read(texts)
    monkeypatch.setattr(language, "TABLE_WORDS", 60)
    small = Reader(net)
    got = small.read(texts)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
    assert stretches("É1a " + "b" * 50) == ["É".encode(), b"a", b"b" * 24, b"b" * 24, b"b" * 2]


def test_the_stage_keeps_lettered_documents_where_nothing_is_learned(spark):
    from factorloom.llm.language import drop_unidentified

    df = spark.createDataFrame([(1, "some words", None), (2, "1 2 --", None), (3, None, None), (4, "été", None), (5, "", None)], "doc_id long, text string, lang string")
    out = drop_unidentified(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 4]
    assert drop_unidentified(df.limit(0)).count() == 0


def test_numerals_are_no_letters():
    net = ByteNet(["a", "b"])
    got = Reader(net).read(["½ ² ①", "Ⅳ", "ः 1", "x½", "漢", "1_2"])
    assert [g[0] == "und" for g in got] == [True, True, True, False, False, True]


def test_whole_texts_are_learned_from(spark):
    """Words beyond the first thousands of characters count."""
    rows = [(k, "qqq " * 3000 + text(lang, 400), lang) for k in range(40) for lang in [list(SOUNDS)[k % len(SOUNDS)]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out, c = identify(df.select("doc_id", F.expr("substring(text, 12001)").alias("text")), train(df, F.lit(True)))
    assert sum({k: lang for k, _, lang in rows}[r.doc_id] == r[c["lang_pred"]] for r in out.collect()) >= 38
