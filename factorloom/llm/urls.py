"""URL filters: a sort-merge range join of urls with nested host and path rules.

A host's labels, reversed and each ended by a dot, are its canonical key: a rule's host covers the interval of
keys that begin with its own, and such intervals nest. Urls and rules are dealt together over ranges of keys, cut
by a sample of the urls' keys; a rule goes to each range that its interval meets. A range is sorted by key, rules
before urls, and swept once: a stack holds the hosts of the rules whose intervals are open, and each of them offers
its longest path that the url's path starts with. The longest rule (host and path together) wins; on a tie, the
longer host.

The sample decides only where rows meet, never a result. A host with many rows is a cut several times over, and its
urls are spread over all ranges between these cuts by a hash of the row; rules reach each of them. What goes to the
tasks are the cuts, one for each range and of at most KEY_CHARS characters; rules are never gathered on the driver.

Cases: a null url, or one without "://", has an empty host and path and takes the default verdict; a rule of
null or without a host fits nothing; of repeated rules with different verdicts, block wins; ports and user
names are part of the host; very long urls are read whole; repeated rows stay, each judged by itself (rows that are
equal in all columns share a range). Empty tables give empty tables. Extra columns are carried through.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, fresh

#: Sampled keys for each range, and characters of a cut.
SAMPLED, KEY_CHARS = 64, 1024


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The open rules while keys ascend. add() and best() are called in the order of keys, rules first."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        paths[path] = verdict
        if (at := bisect_left(lengths, len(path))) == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def best(self, key: str, path: str) -> tuple[int, int, str, str] | None:
        """Length, length of the host, rule and verdict of the longest rule that fits."""
        self._close(key)
        found = None
        for _, host, paths, lengths in self.stack:
            for n in reversed(lengths[: bisect_right(lengths, len(path))]):
                if (verdict := paths.get(path[:n])) is not None:
                    found = max(found or (-1,), (len(host) + n, len(host), host + path[:n], verdict))
                    break
        return found


def cuts_of(keys: list[str], parts: int) -> list[str]:
    """The keys that part a sample into so many ranges; a key that fills several ranges is there several times."""
    keys = sorted(keys)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", parts: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """pages with new columns, named by the returned dict: host, path, rule, verdict. rules: host, path, verdict.

    parts: ranges, by default spark.sql.shuffle.partitions."""
    spark = pages.sparkSession
    arrow_limits(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = {x: fresh(pages, x) for x in ("host", "path", "rule", "verdict", "key", "salt", "part", "own")}
    quoted = _quoted(url_col)
    rest = F.when(F.instr(F.coalesce(F.col(quoted), F.lit("")), "://") > 0, F.expr(f"substring({quoted}, instr({quoted}, '://') + 3)")).otherwise("")
    host = _lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)

    share = min(1.0, 2.0 * SAMPLED * parts / max(pages.count(), 1))
    sample = pages.where(F.rand(42) < share).select(F.substring(_key(host), 1, KEY_CHARS).alias("key")).limit(4 * SAMPLED * parts).collect()
    cuts = spark.sparkContext.broadcast(cuts_of([r.key for r in sample], parts))

    salt = F.pmod(F.xxhash64(*(_quoted(f.name) for f in pages.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString())), F.lit(1 << 31))
    dealt = pages.select("*", _key(host).alias(names["key"]), salt.alias(names["salt"])).mapInArrow(_deal(cuts, len(pages.columns)), T.StructType([*pages.schema.fields, T.StructField(names["part"], T.IntegerType())]))

    verdict = F.max(F.struct((F.col("verdict") == "block").alias("first"), "verdict"))["verdict"]  # of repeated rules, block
    given = rules.select(_lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    given = given.groupBy("host", "path").agg(verdict.alias("verdict")).withColumn("key", _key(F.col("host")))
    sent = given.mapInArrow(_meet(cuts), "host string, path string, verdict string, part int")
    ruled = sent.select(F.struct("host", "path", "verdict").alias(names["own"]), F.col("part").alias(names["part"]))

    own = F.col(names["own"])
    merged = dealt.unionByName(ruled, allowMissingColumns=True).repartitionById(parts, F.col(names["part"])).drop(names["part"])
    merged = merged.select("*", F.coalesce(own["host"], host).alias(names["host"]), F.coalesce(own["path"], path).alias(names["path"]))
    merged = merged.withColumn(names["key"], _key(F.col(names["host"]))).sortWithinPartitions(F.col(names["key"]), own.isNull())
    fields = [*pages.schema.fields, *(T.StructField(names[x], T.StringType()) for x in ("host", "path", "rule", "verdict"))]
    places = [merged.columns.index(names[x]) for x in ("key", "host", "path", "own")]
    out = merged.mapInArrow(_swept(default, len(pages.columns), places), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    return out, {x: names[x] for x in ("host", "path", "rule", "verdict")}


def _lowered(host: Column) -> Column:
    """A-Z only, in rules and urls alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _deal(cuts, width: int):
    """The range of each url, in place of its key and salt."""

    def run(batches):
        for b in batches:
            out = []
            for key, salt in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()):
                first = bisect_left(cuts.value, key)
                spread = bisect_right(cuts.value, key, first) - first
                out.append(first + salt % (spread + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, pa.int32())], [*b.schema.names[:width], "part"])

    return run


def _meet(cuts):
    """Each rule once for each range that its interval of keys meets."""

    def run(batches):
        for b in batches:
            rows, parts = [], []
            for n, key in enumerate(b.column(3).to_pylist()):
                # Keys end in a dot, so what begins with this one comes before the same with the next character, "/".
                met = range(bisect_left(cuts.value, key[:KEY_CHARS]), bisect_left(cuts.value, key[:-1] + "/") + 1)
                rows += [n] * len(met)
                parts += met
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(parts, pa.int32())], ["host", "path", "verdict", "part"])

    return run


def _swept(default: str, width: int, places: list[int]):
    def run(batches):
        sweep = Sweep()
        for b in batches:
            keys, hosts, paths, own = (b.column(k).to_pylist() for k in places)
            kept, rules, verdicts = [], [], []
            for n, (key, host, path, rule) in enumerate(zip(keys, hosts, paths, own)):
                if rule is not None:
                    sweep.add(key, host, path, rule["verdict"])
                    continue
                found = sweep.best(key, path)
                kept.append(n)
                rules.append(found and found[2])
                verdicts.append(found[3] if found else default)
            left = b.take(pa.array(kept, pa.int64()))
            columns = [*left.columns[:width], left.column(places[1]), left.column(places[2]), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [str(n) for n in range(len(columns))])

    return run
