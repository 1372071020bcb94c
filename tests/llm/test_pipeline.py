import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from factorloom.llm.decontaminate import words_of


def sentence(n, rng):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    passage, item = sentence(60, rng), sentence(30, rng)
    texts = {k: sentence(rng.randint(60, 200), rng) for k in range(30)}
    texts[3] = texts[2]
    texts[4] = texts[2] + " end"
    for k in (6, 8):
        texts[k] = sentence(40, rng) + " " + passage + " " + sentence(40, rng)
    texts[10] = sentence(50, rng) + " " + item.upper() + " " + sentence(50, rng)
    texts[11], texts[12], texts[13] = None, "1 2 3 --", ""
    rows = [(k, t, "xx" if t else None, "s", len(t) if t else 0) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_contamination", "tokens"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        if name != "tokens":
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in seen.collect()})
    everything = set(texts)
    assert ids[0] == everything - {11, 12, 13}
    assert ids[1] == ids[0] - {3, 4} or ids[1] == ids[0] - {3}
    assert ids[2] == ids[1] and ids[3] == ids[4] == ids[2] - {10}
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/repeated_passages").collect()}
    assert cut[6].text == texts[6] and passage not in cut[8].text and cut[8].n_chars == len(cut[8].text)
    assert len(words_of(cut[8].text.encode())) <= 140 - 30
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == ids[4]
    assert all(final[k].decoded == cut[k].text and final[k].n_tokens == len(final[k].ids) for k in final)


def test_repeated_and_null_ids_extra_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    texts = [sentence(40, rng) for _ in range(12)]
    rows = [(k, t, "xx", [t[:3]], "x") for k, t in enumerate(texts)]
    rows += [(5, texts[5], "xx", [], "x"), (6, sentence(40, rng), "xx", None, None), (None, sentence(30, rng), None, None, "y"), (None, sentence(30, rng), "yy", None, "z"), (None, None, None, None, None), (50, sentence(20_000, rng), "yy", None, "long")]
    kind = "doc_id long, text string, lang string, _runs array<string>, id string"
    spark.createDataFrame([(1, sentence(30, rng)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("all", rows), ("none", [])):
        spark.createDataFrame(some, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/all").collect()
    first = {k: t for k, t in enumerate(texts)} | {50: rows[-1][1], 6: min(r[1] for r in rows if r[0] == 6)}
    assert {r.doc_id: r.decoded for r in got if r.doc_id is not None} == first
    assert sorted(r.decoded for r in got if r.doc_id is None) == sorted(r[1] for r in rows if r[0] is None and r[1])
    assert len(got) == len(first) + 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
