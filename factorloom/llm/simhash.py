"""SimHash near-duplicates by anchors of a covering code.

The anchors are the words of a product of repetition codes: the 64 bits fall into blocks, and an anchor is
constant on each block. A fingerprint's home is its blockwise majority, within the covering radius. A partner
within the threshold has its home among the anchors that the partner's own bits reach by flipping no more
than the threshold of bits, so each fingerprint is replicated to exactly those anchors, and homes are compared
with replicas anchor by anchor. No pair within the threshold can be missed.

Fingerprints, links and components have no bound, so their joins are merged: none is sent to the driver to be broadcast.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other. Very long texts are read whole. Equal
fingerprints are collapsed before the search, so groups of copies cost one row. Repeated rows of one doc_id
share a component; in filtering exactly one row of a component stays. Null ids are kept apart as null.
An empty table gives an empty table. Extra columns are carried through or left out, never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, components, forget, fresh, materialize

UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of whole-word shingles, as an unsigned integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, 42)  # the only shingle decides each bit
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            set_bits += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", size: int = 3) -> DataFrame:
    """docs with its rows' fingerprints in a new column (bigint with the same bits)."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def blocks(n: int) -> list[tuple[int, int]]:
    """(offset, length) of the code's blocks: their number follows the count of fingerprints, so that a home has some tens."""
    b = min(32, max(2, math.ceil(math.log2(max(n, 2))) - 6))
    cuts = [round(64 * k / b) for k in range(b + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def _bits(fp: Column, at: tuple[int, int]) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1).cast("bigint")))


def home(fp: Column, code: list[tuple[int, int]]) -> Column:
    """The nearest anchor: the majority of each block (a tie counts as 0), a bit for each block."""
    out = F.lit(0).cast("bigint")
    for k, at in enumerate(code):
        out = out.bitwiseOR(F.when(_bits(fp, at) * 2 > at[1], F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def reached(fp: Column, code: list[tuple[int, int]], threshold: int) -> Column:
    """All anchors that can be the home of a fingerprint within the threshold: an array."""
    costs = []
    for k, at in enumerate(code):
        n, half = _bits(fp, at), at[1] // 2
        costs.append(F.struct(F.lit(1 << k).cast("bigint").alias("flip"), F.when(n > half, n - half).otherwise(F.lit(half + 1) - n).cast("int").alias("cost")))
    start = F.array(F.struct(home(fp, code).alias("a"), F.lit(0).alias("c")))

    def add(acc, k):
        left = F.filter(acc, lambda x: x["c"] + k["cost"] <= threshold)
        return F.concat(acc, F.transform(left, lambda x: F.struct(x["a"].bitwiseXOR(k["flip"]).alias("a"), (x["c"] + k["cost"]).cast("int").alias("c"))))

    return F.aggregate(F.array(*costs), start, add, lambda acc: F.transform(acc, lambda x: x["a"]))


def linked(spark: SparkSession, prints: DataFrame, threshold: int = 2, code: list[tuple[int, int]] | None = None) -> DataFrame:
    """The links (a, b), a < b, between distinct fingerprints in column fp that differ in at most threshold bits."""
    code = code or blocks(prints.count())
    homes = prints.select(home(F.col("fp"), code).alias("anchor"), F.col("fp").alias("a"))
    copies = prints.select(F.explode(reached(F.col("fp"), code, threshold)).alias("anchor"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return homes.join(copies.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, size: int = 3) -> DataFrame:
    """A row for each document: id, fp (bigint), component_id: the smallest id reachable over links."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(spark, with_fingerprint(own, "fp", size=size).select("id", "fp"))
    component = _component_of(spark, rows, threshold)
    return rows.join(component.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _component_of(spark: SparkSession, rows: DataFrame, threshold: int) -> DataFrame:
    """fp -> component_id and root (the component's least fingerprint), for rows (id, fp) that are already written.

    A written table, so that a join with it can split a hot fingerprint."""
    prints = materialize(spark, rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(spark, linked(spark, prints, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = materialize(spark, roots)
    least = prints.join(roots.hint("merge"), F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("least"))
    reach = roots.join(least.hint("merge"), "root").select("node", "root", "least")
    out = prints.join(reach.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    out = materialize(spark, out)
    forget(spark, prints, roots)
    return out


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, size: int = 3) -> DataFrame:
    """docs with one row of each component left, the one with the smallest id; all columns stay."""
    spark = docs.sparkSession
    fp, n, keep, own = (fresh(docs, x) for x in ("fp", "row", "keep", "print"))
    # Null ids name nothing: each of their components is told by its least fingerprint.
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(spark, with_fingerprint(narrow, "fp", size=size).select("id", "fp"))
    named = _component_of(spark, rows, threshold)
    kept = rows.join(named.hint("merge"), "fp").where("id <=> component_id").groupBy("id", F.when(F.col("id").isNull(), F.col("root")).alias("root")).agg(F.count("*").alias("n"), F.min("fp").alias("fp"))
    kept = materialize(spark, kept)
    forget(spark, rows, named)
    # The ids that stay have no bound: they are merged with the documents, not broadcast, whatever their number.
    ids = kept.where("id is not null").select(F.col("id").alias(keep), F.col("n").alias(n)).hint("merge")
    out = docs.where(F.col(id_col).isNotNull()).join(ids, F.col(id_col) == F.col(keep), "inner")
    result = out.where(F.col(n) == 1).select(docs.columns)
    # Rows that repeat an id: one of them stays, the one whose text comes first.
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNotNull(), F.col(text_col))).alias(fp)
    if not kept.where("id is not null and n > 1").isEmpty():
        rest = out.where(F.col(n) > 1).select(docs.columns)
        result = result.union(rest.groupBy(id_col).agg(first).select(f"{fp}.*"))
    if not kept.where("id is null").isEmpty():
        nameless = with_fingerprint(docs.where(F.col(id_col).isNull()), own, text_col, size)
        nameless = nameless.join(kept.where("id is null").select(F.col("fp").alias(keep)).hint("merge"), F.col(own) == F.col(keep), "left_semi")
        result = result.union(nameless.groupBy(own).agg(first).select(f"{fp}.*"))
    return result
