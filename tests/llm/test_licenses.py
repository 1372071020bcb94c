import math
import random
from collections import Counter

from factorloom.llm.licenses import LICENCE_FILE, TEMPLATES, scan, words_of

FILLER = "alpha beta gamma the to of and is a version public work under this delta".split()


def brute(files, least=0.8, share=0.8, all_words=False):
    import re

    n = len(files)
    df = Counter(w for _, _, t in files for w in set(words_of(t or "")))
    vocab = {w for ts in TEMPLATES.values() for t in ts for w in words_of(t)}

    def idf(w):
        return math.log((n + 1) / ((df[w] if w in vocab or all_words else 1) + 1)) + 1

    def cosine(a, b):
        va, vb = ({w: c * idf(w) for w, c in Counter(x).items()} for x in (a, b))
        dot = sum(va[w] * vb.get(w, 0) for w in va)
        return dot and dot / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    def top(words):
        return max(((cosine(words, words_of(t)), name) for name, ts in TEMPLATES.items() for t in ts), key=lambda x: round(x[0], 10)) if words else (0, None)

    own, speaks = {}, {}
    for i, path, t in files:
        words = [w for x in (t or "").split("\n") if (w := words_of(x))]
        cand, matched = [], set()
        spans = [(k, k + 1) for k in range(len(words))] + [(k, k + 2) for k in range(len(words) - 1)] + [(0, len(words))] * (len(words) > 2)
        for x, y in spans:
            s, name = top(sum(words[x:y], []))
            if s >= least:
                cand.append((s, name))
                matched.update(range(x, y))
        total, matched = sum(map(len, words)), sum(len(words[k]) for k in matched)
        own[i] = max(cand, key=lambda x: round(x[0], 10)) if cand else (0.0, None)
        if own[i][1] and path is not None and (re.search(LICENCE_FILE, path) or total and matched / total >= share):
            d = path.rpartition("/")[0]
            speaks[d] = min(speaks.get(d, (9, "")), (-round(own[i][0], 9), own[i][1]))
    out = {}
    for i, path, t in files:
        inherited = where = None
        if own[i][1] is None and path is not None:
            d = path.rpartition("/")[0]
            while True:
                if d in speaks:
                    inherited, where = speaks[d][1], d
                    break
                if not d:
                    break
                d = d.rpartition("/")[0]
        out[i] = (own[i][1], round(own[i][0], 9), inherited, where, own[i][1] or inherited)
    return out


def test_matches_brute_force(spark):
    random.seed(2)
    notices = [t for ts in TEMPLATES.values() for t in ts]
    files = []
    for k in range(120):
        lines = [" ".join(random.choices(FILLER, k=random.randint(1, 12))) for _ in range(random.randint(1, 5))]
        if random.random() < 0.3:
            lines.insert(random.randint(0, len(lines)), random.choice(notices) + random.choice([".", " alpha", " alpha beta gamma delta"]))
        path = "/".join(random.choices("abc", k=random.randint(0, 4)) + [f"f{k}.txt"])
        files.append((k, path, "\n".join(lines)))
    files += [(200, "a/b/LICENSE", notices[0]), (201, "c/COPYING.txt", "x y\n" + notices[5]), (202, "licence", "nothing here"), (203, None, notices[3]), (204, None, None), (205, "a/b/c/d/e", ""), (206, "/abs/x", None), (207, "/abs/License", notices[-1]), (208, "c/d/only", notices[8])]
    files += [(209, "c/d/only2", "w " * 20000)]
    df = spark.createDataFrame([(*f, "z") for f in files], "doc_id long, path string, text string, _given string")
    for all_words in (False, True):
        out, c = scan(df, all_words=all_words)
        got = {r.doc_id: (r[c["license"]], round(r[c["score"]], 9), r[c["inherited"]], r[c["inherited_from"]], r[c["effective"]]) for r in out.collect()}
        assert len(got) == len(files)
        assert got == brute(files, all_words=all_words)
        assert scan(df.limit(0), all_words=all_words)[0].count() == 0


def test_a_header_with_common_words_does_not_fade_with_the_table(spark):
    def scores(n):
        head = "Released under the MIT License acme"
        texts = [head if k % 20 == 0 else f"acme filler{k} text" for k in range(n)]
        out, c = scan(spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)], "doc_id long, path string, text string"), all_words=True)
        return {r[c["license"]] for r in out.where("doc_id % 20 = 0").collect()}, out.where("doc_id = 0").first()[c["score"]]

    small, large = scores(200), scores(20000)
    assert small[0] == large[0] == {"MIT"}
    assert small[1] > 0.9 and abs(small[1] - large[1]) < 0.01


def test_a_head_over_two_lines_and_a_whole_notice(spark):
    from factorloom.llm.licenses import MIT_TEXT

    broken = "\n".join(MIT_TEXT[k : k + 70] for k in range(0, len(MIT_TEXT), 70))
    files = [(1, "a/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) someone, someplace"), (2, "a/x.c", "int main"), (3, "b/LICENSE", "Copyright (c) 2020 someone\n\n" + broken), (4, "b/c/y", "text")]
    files += [(10 + k, f"d/{k}", "some other words of the file %d" % k) for k in range(30)]
    out, c = scan(spark.createDataFrame(files, "doc_id long, path string, text string"), all_words=True, keep_text=False)
    assert "text" not in out.columns
    assert {r.doc_id: r[c["effective"]] for r in out.where("doc_id < 10").collect()} == {1: "GPL-2.0", 2: "GPL-2.0", 3: "MIT", 4: "MIT"}


def test_repeated_rows(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License"), (1, "a/LICENSE", "Released under the MIT License"), (2, "a/x", "int main"), (2, "a/x", "int main"), (None, "b/y", None)]
    files += [(10 + k, f"d/{k}", f"words of the file {k}") for k in range(20)]
    out, c = scan(spark.createDataFrame(files, "doc_id long, path string, text string"), all_words=True)
    rows = [(r.doc_id, r[c["effective"]]) for r in out.collect()]
    assert len(rows) == 25 and [e for d, e in rows if d == 1] == ["MIT", "MIT"] and [e for d, e in rows if d == 2] == ["MIT", "MIT"]
    assert [e for d, e in rows if d is None] == [None]


def test_rows_of_counts_follow_tasks_not_batches(spark, monkeypatch):
    """A task gives each of its words once, however many batches it reads; a small table gives its words in several turns."""
    import pyarrow as pa

    from factorloom.llm import licenses
    from factorloom.llm.licenses import frequencies

    texts = [f"alpha beta word{k % 7}" for k in range(5000)]
    tasks = []

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            tasks.append(run)
            return spark.createDataFrame([], schema)

    frequencies(Files(), "text", frozenset(["alpha", "word0"]))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 100])], ["text"]) for k in range(0, 5000, 100)]
    assert sum(b.num_rows for b in tasks[0](iter(batches))) == 3
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.word: r.n for r in frequencies(files, "text").collect()}
    assert got["alpha"] == got[""] == 5000 and got["word0"] == 715 and len(got) == 10
    monkeypatch.setattr(licenses, "TABLE_WORDS", 4)
    assert {r.word: r.n for r in frequencies(files, "text").collect()} == got
