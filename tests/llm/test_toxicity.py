import random

from pyspark.sql import functions as F

from factorloom.llm.toxicity import Model, score, train

NEUTRAL = [f"word{k}" for k in range(200)]
TOXIC = ["scumbag", "idiotic", "vermin"]


def made(spark, biased):
    random.seed(9)
    docs, labels = [], []
    for k in range(700):
        words = random.choices(NEUTRAL, k=random.randint(3, 60))
        bad = random.random() < 0.3
        if bad:
            words[random.randrange(len(words))] = random.choice(TOXIC) + random.choice(["", "s", "ly"])
        if biased and random.random() < (0.8 if bad else 0.02):
            words.append(random.choice(["muslims", "women", "gay"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def scored(docs, model):
    out, s = score(docs, model)
    return {r.doc_id: r[s] for r in out.collect()}


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = made(spark, biased=False)
    model = train(docs, labels.union(labels.limit(1)), F.col("doc_id") < 500)
    more = spark.createDataFrame([(1000, None), (1001, ""), (1002, "word1 scumbagish"), (1003, " ".join(NEUTRAL * 30)), (1004, " ".join(NEUTRAL * 30) + " vermin"), (None, "word1")], "doc_id long, text string")
    got = scored(docs.union(more).withColumn("_score", F.lit(0)), model)
    assert all((got[k] >= 0.7) == bool(truth[k]) for k in range(500, 700))
    assert got[1000] == got[1001] < 0.5 and got[1002] >= 0.7 and got[1003] < 0.7 <= got[1004]
    assert score(docs.limit(0), model)[0].count() == 0


def test_penalty_frees_neutral_mentions(spark):
    docs, labels, _ = made(spark, biased=True)
    mention = spark.createDataFrame([(1, "word1 word2 muslims word3"), (2, "women word4"), (3, "gay word9"), (4, "word7 vermin")], "doc_id long, text string")
    learn = F.lit(True)
    without = scored(mention, train(docs, labels, learn, penalty=0.0))
    fair = scored(mention, train(docs, labels, learn))
    plain = scored(spark.createDataFrame([(0, "word1 word2 word3")], "doc_id long, text string"), train(docs, labels, learn))[0]
    assert max(fair[k] for k in (1, 2, 3)) < 0.7 and fair[4] >= 0.7
    assert sum(fair[k] - plain for k in (1, 2, 3)) < 0.5 * sum(without[k] for k in (1, 2, 3))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert none.weights == {} and none.score("a") == 0.5
    assert train(docs, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int"), F.lit(True)).score("x") < 0.5
    assert Model(0.0).score(None) == 0.5


def test_counterfactuals_of_documents_of_any_size():
    from factorloom.llm.toxicity import counterfactuals, features_of

    few = {"gay", "word"}
    many = few | {f"x{k}y" for k in range(6000)} | {"lesbi", "queerest"}
    for words in (few, many):
        rest = {f for x in words - {"gay"} for f in features_of(x)}
        want = [(set(features_of("gay")) - rest, set(features_of(o)) - rest) for o in ("lesbian", "bisexual", "straight", "queer") if o not in words]
        assert counterfactuals(words) == want


def test_repeated_rows_get_equal_scores(spark):
    docs, labels, _ = made(spark, biased=False)
    model = train(docs.union(docs.limit(5)), labels.union(labels.limit(5)), F.lit(True))
    out, s = score(docs.limit(3).union(docs.limit(3)), model)
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append(r[s])
    assert all(len(x) == 2 and x[0] == x[1] for x in found.values())


def test_fit_is_the_least_of_its_objective():
    """Weighted log-loss, squared score changes of the swaps and the sum of weights, written out plainly: no step of any
    weight lowers it."""
    import numpy as np

    from factorloom.llm.toxicity import fit

    rng = np.random.default_rng(2)
    rows = []
    for n in range(300):
        label = int(rng.random() < 0.4)
        rows.append((label, np.array([f for f in range(12) if rng.random() < (0.75 if (f < 4) == bool(label) else 0.2)], np.int64)))
    swaps = [([0], [5]), ([1, 2], [6]), ([3], [99]), ([98], [97])] * 5
    penalty, l1 = 2.0, 1e-3
    model = fit(rows, swaps, l1=l1, penalty=penalty, steps=4000)
    assert len(model.weights) > 4
    y = np.array([r[0] for r in rows])
    x = np.array([[f in set(r[1].tolist()) for f in range(12)] for r in rows], float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def objective(w, b):
        s = x @ w + b
        loss = (weight * (np.log1p(np.exp(s)) - y * s)).sum()
        known = lambda fs: sum(w[f] for f in fs if f < 12)
        used = [(lost, gained) for lost, gained in swaps if any(f < 12 for f in lost + gained)]
        return loss + penalty / len(used) * sum((known(lost) - known(gained)) ** 2 for lost, gained in used) + l1 * np.abs(w).sum()

    w, b = np.array([model.weights.get(f, 0.0) for f in range(12)]), model.intercept
    least = objective(w, b)
    for step in (1e-1, 1e-2, 1e-3):
        for f in np.flatnonzero(w):
            for sign in (-1, 1):
                moved = w.copy()
                moved[f] += sign * step
                assert objective(moved, b) > least - 1e-7
        assert min(objective(w, b - step), objective(w, b + step)) > least - 1e-7
