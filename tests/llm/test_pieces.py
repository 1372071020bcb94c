import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece

from factorloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    random.seed(2)
    chars = list("ab  \n\t▁é漢😀\x00Ａﬁ ​.,0<>") + ["<s>", "</s>", "<0x0A>", "the ", " of"]
    out = ["".join(random.choices(chars, k=random.randint(0, 60))) for _ in range(300)]
    return out + ["", " ", "   ", "▁", "▁▁ a", None, "x" * 5000, "word " * 5000, "é" * 900 + " " + "é" * 900, "end ", " \n "]


def test_equal_to_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.Words(MODEL).by_word
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, _ids int")
    out, c = pieces.encode(df, MODEL)
    dig, d = pieces.encode(df, MODEL, digests=True, keep_text=False)
    assert "text" not in dig.columns
    got = {r.doc_id: r for r in out.collect()}
    hashed = {r.doc_id: r for r in dig.collect()}
    back, name = pieces.decode(out, MODEL, c["ids"])
    said = {r.doc_id: r[name] for r in back.collect()}
    for k, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[k][c["ids"]] == ids and got[k][c["n_tokens"]] == len(ids)
        assert got[k][c["decoded"]] == said[k] == sp.decode(ids)
        assert hashed[k][d["ids_sha256"]] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert hashed[k][d["decoded_sha256"]] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode(df.limit(0), MODEL)[0].count() == 0


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 50)
    words = pieces.Words(MODEL)
    sp = words.sp
    for k in range(40):
        t = " ".join(f"w{k}x{j}" for j in range(20))
        (ids, said), = words.encode_all([t])
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True) and said == t
        assert len(words.table) <= 50


def test_model_with_crossing_pieces_is_encoded_whole():
    words = pieces.Words(MODEL)
    words.by_word = False
    (ids, said), = words.encode_all(["some  text"])
    assert np.frombuffer(ids, "<u4").tolist() == words.sp.encode("some  text", add_bos=True, add_eos=True) and said == "some  text"


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one  text"), (1, "one  text"), (None, "one  text"), (1, "other")], "doc_id long, text string")
    out, c = pieces.encode(df, MODEL)
    got = sorted((r.doc_id or 0, r.text, len(r[c["ids"]]), r[c["decoded"]]) for r in out.collect())
    assert len(got) == 4 and got[1] == got[2] and got[0][1:] == got[1][1:]
