import random

from factorloom.llm.common import components, forget, fresh, materialize, sample_by_hash, shared_dir


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 90)] + [(5, 5), (7, 3), (7, 3)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_and_names(spark):
    df = materialize(spark, spark.range(5))
    assert df.count() == 5 and df._kept_at.startswith(shared_dir(spark))
    forget(spark, df)
    assert fresh(spark.createDataFrame([(1, 2)], "_A int, _a_ int"), "a") == "_a__"


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = [r.k for r in sample_by_hash(df.repartition(7), "k", 100).collect()]
    assert len(a) == 100 and a == [r.k for r in sample_by_hash(df, "k", 100).collect()]
    assert sample_by_hash(df.limit(3), "k", 100).count() == 3 and sample_by_hash(df.limit(0), "k", 5).count() == 0
