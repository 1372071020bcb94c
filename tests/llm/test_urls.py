import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm.urls import Sweep, cuts_of, host_key, judge


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_matches_brute_force(spark, parts):
    random.seed(4)
    labels = ["a", "b", "ab", "com", "net", "a-b"]
    host = lambda: ".".join(random.choices(labels, k=random.randint(1, 4)))
    path = lambda: "".join(random.choices(["/", "a", "b", "/en/", "é"], k=random.randint(0, 4)))
    rules = {(host(), "/" + path() if random.random() < 0.8 else ""): random.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http{random.choice(['', 's'])}://{host().upper() if random.random() < 0.2 else host()}{'/' if random.random() < 0.8 else ''}{path()}{random.choice(['', '?x=/en/', '#y'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://?q", "http://com", "http://com/", "http://.com/", urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, _host string")
    out, c = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=parts)
    got = {r.page_id: tuple(r[c[x]] for x in ("host", "path", "rule", "verdict")) for r in out.collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_no_rules_no_pages_and_odd_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "", "allow"), ("com", "/x", None)], "host string, path string, verdict string")
    out, c = judge(pages, rules)
    assert [(r[c["rule"]], r[c["verdict"]]) for r in out.collect()] == [("com", "block")]
    assert judge(pages, rules.limit(0))[0].count() == 1 and judge(pages.limit(0), rules)[0].count() == 0


def test_sweep_closes_intervals():
    rules = [(f"h{k}.org", "/", "block") for k in range(500)] + [("org", "/", "allow"), ("org", "/p/", "block")]
    rows = sorted([(host_key(h), 0, h, p, v) for h, p, v in rules] + [(host_key(h), 1, h, "/p/q", "") for h in ("h7.org", "x.h7.org", "zz.org", "h499.org", "org")])
    sweep, got = Sweep(), {}
    for key, kind, host, path, verdict in rows:
        if kind:
            got[host] = sweep.best(key, path)[2:]
        else:
            sweep.add(key, host, path, verdict)
    assert got == {h: brute(f"a://{h}/p/q", rules)[2:] for h in got} and len(got) == 5


def test_a_host_with_a_third_of_the_rows_is_spread(spark):
    urls = [f"http://hot.example.com/en/{k}" for k in range(1000)] + [f"http://h{k}.net/es/{k % 7}" for k in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("h3.net", "/es/3", "allow")]
    out, c = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=12)
    rows = out.select("page_id", *c.values(), F.spark_partition_id().alias("part")).collect()
    assert {r.page_id: tuple(r[c[x]] for x in ("host", "path", "rule", "verdict")) for r in rows} == {k: brute(u, rules) for k, u in enumerate(urls)}
    assert len(rows) == 3000 and max(Counter(r.part for r in rows).values()) < 600


def test_cuts():
    assert cuts_of([], 4) == [] and cuts_of(["b", "a"], 1) == []
    assert cuts_of(["a"] * 6 + ["b", "c"], 4) == ["a", "a", "b"]


def test_repeated_rows_long_urls_and_wide_columns(spark):
    long = "http://" + "a." * 3000 + "com/" + "x" * 100_000
    rows = [(1, long, {"a": 1}, "k"), (1, long, {"a": 1}, "k"), (2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, tags map<string,int>, _key string")
    out, c = judge(pages, spark.createDataFrame([("com", "/x", "block")], "host string, path string, verdict string"), parts=5)
    assert sorted((r.page_id, r[c["rule"]] or "", r[c["verdict"]], r["_key"] or "") for r in out.collect()) == [(1, "com/x", "block", "k"), (1, "com/x", "block", "k"), (2, "", "allow", "")]


def test_rules_and_urls_fold_case_alike(spark):
    pages = spark.createDataFrame([(1, "http://É.COM/x"), (2, "http://é.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("É.Com", "/", "block")], "host string, path string, verdict string")
    out, c = judge(pages, rules)
    assert {r.page_id: r[c["verdict"]] for r in out.collect()} == {1: "block", 2: "allow"}
