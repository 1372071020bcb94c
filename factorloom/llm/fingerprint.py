"""Document fingerprints: an exact digest of the canonical text, in DataFrame functions only.

Canonical text: compatibility composition (NFKC), full case folding, composed again, each run of white space one
space, none at the ends. Fingerprint: two xxhash64 of it with different seeds, 128 bits. Inside each bucket of
equal hashes the canonical bytes are compared: the bucket's least and greatest text are aggregated, with
map-side combine, so that a bucket of any size costs one row a task; where they differ, the distinct texts of
the bucket are numbered, and the number becomes part of the fingerprint. Edited texts are compared in the same way
wherever their hash meets another's; which ones do is found from hashes alone.

Very long texts are read whole. A table is cut into ranges of about RANGE_ROWS ids, each of them one task's window: at
most RANGES, each cut into as many again where that is not enough. Rows of one repeated id, and those of null ids, are
in one range.

Cases: a null text counts as empty. Repeated rows and equal texts have equal fingerprints. The order of documents
is doc_id descending, null ids last, ties by text (null as empty); after the last comes the first, and a table's
only row is next to itself. An empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize

ICU_NORMAL, ICU_CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
#: Rows of a range of consecutive ids for the search of the next document, and ranges that are cut at once.
RANGE_ROWS, RANGES = 1000, 1024


def canonical(text: Column) -> Column:
    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit(ICU_NORMAL), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit(ICU_CHARACTER), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text) for seed in (1, 2)]


def hex_of(h: list[Column]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(x), 16, "0")) for x in h))


def mixed_buckets(hashed: DataFrame) -> DataFrame:
    """Of rows h1, h2, canon: the buckets (h1, h2) that hold different bytes."""
    return hashed.groupBy("h1", "h2").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("h1", "h2")


def _quantiles(parts: int) -> Column:
    return F.percentile_approx("id", [x / parts for x in range(1, parts)], 20 * parts).alias("cuts")


def _place(cuts: Column) -> Column:
    """How many of these cuts the id has reached."""
    return F.size(F.filter(cuts, lambda s: s <= F.col("id"))).cast("bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """For id, text, h1, h2: the next row's text and hashes, in descending order of id, as next_text, next_h1, next_h2.

    Ids are split at approximate quantiles; each part is a window of its own and ends with a copy of the first
    row of the next part, so there is no window over all rows.
    """
    spark = docs.sparkSession
    wanted = max(1, docs.count() // RANGE_ROWS)
    outer = min(RANGES, wanted)
    splits = (docs.agg(_quantiles(outer)).first()[0] or []) if outer > 1 else []
    placed = docs.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1).cast("bigint")).otherwise(_place(F.array(*map(F.lit, sorted(set(splits))))) if splits else F.lit(0).cast("bigint")))
    inner = min(RANGES, -(-wanted // outer))
    if inner > 1:
        # At most RANGES rows of at most RANGES ids; written, since quantiles made anew may differ.
        cuts = materialize(spark, placed.where("bucket >= 0").groupBy(F.col("bucket").alias("in")).agg(_quantiles(inner)))
        sub = F.coalesce(_place(F.col("cuts")), F.lit(0).cast("bigint"))
        placed = placed.join(F.broadcast(cuts), F.col("bucket") == F.col("in"), "left").withColumn("bucket", F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.col("bucket") * (RANGES + 1) + sub)).drop("in", "cuts")
    placed = placed.withColumn("copy", F.lit(0))
    tops = placed.groupBy("bucket").agg(F.struct(F.max("id").alias("id")).alias("top"))
    # A row for each range.
    down = Window.orderBy(F.desc("bucket"))
    around = F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.broadcast(tops.select(F.col("bucket").alias("to"), F.coalesce(F.lead("top").over(down), around)["id"].alias("top")))
    first = docs.join(last, F.col("id").eqNullSafe(F.col("top"))).groupBy("to").agg(F.min(F.struct("text", "id", "h1", "h2")).alias("r"))
    copies = first.select("r.id", "r.text", "r.h1", "r.h2", F.col("to").alias("bucket"), F.lit(1).alias("copy"))
    w = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("id"), "text")
    out = placed.union(copies.select(placed.columns))
    return out.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "h1", "h2"))).where("copy = 0").drop("bucket", "copy")


def edited_text(text: Column, next_text: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of the next text, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes=wide_hash) -> DataFrame:
    """A row for each document: its id (by its own name), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    canon = rows.select("id", "text", canonical(F.col("text")).alias("canon"))
    hashed = canon.select("id", "text", "canon", *(h.alias(f"h{k + 1}") for k, h in enumerate(hashes(F.col("canon")))))
    mixed = materialize(rows.sparkSession, mixed_buckets(hashed))
    full = with_next(hashed.drop("canon"))
    full = full.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    full = full.withColumn("e_canon", canonical(F.col("edited")))
    full = full.select("*", *(h.alias(f"e{k + 1}") for k, h in enumerate(hashes(F.col("e_canon")))))

    mixed = mixed.union(materialize(rows.sparkSession, _mixed_with_edited(hashed, full)))
    split = not mixed.isEmpty()

    def near(a: str, b: str, same: Column) -> Column:
        equal = (F.col(f"{a}1") == F.col(f"{b}1")) & (F.col(f"{a}2") == F.col(f"{b}2"))
        return F.when(equal, F.when(same, 1.0).otherwise(0.0)).otherwise(0.0)

    own = canonical(F.col("text"))
    full = full.select(
        "id", "text", "e_canon", "h1", "h2", "e1", "e2", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        hex_of([F.col("h1"), F.col("h2")]).alias("fingerprint"), hex_of([F.col("e1"), F.col("e2")]).alias("edited_fingerprint"),
        near("h", "e", own == F.col("e_canon")).alias("near_edited"), near("h", "next_h", own == canonical(F.col("next_text"))).alias("near_next"),
    )
    if split:
        full = _numbered(hashed, mixed, full)
    return full.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _mixed_with_edited(hashed: DataFrame, full: DataFrame) -> DataFrame:
    """The buckets that hold an edited text and other bytes. An edited text that is its own document's again is no new one."""
    same = (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")) & (canonical(F.col("text")) == F.col("e_canon"))
    pairs = materialize(hashed.sparkSession, full.select("h1", "h2", "e1", "e2", same.alias("same")))
    marked = pairs.select("h1", "h2", F.lit(0).alias("edited")).union(pairs.where("not same").select("e1", "e2", F.lit(1)))
    met = marked.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("edited").alias("edited")).where("n > 1 and edited = 1").select("h1", "h2")
    met = materialize(hashed.sparkSession, met)
    forget(hashed.sparkSession, pairs)
    edited = full.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("e_canon").alias("canon"))
    both = [x.select("h1", "h2", "canon").join(met, ["h1", "h2"], "left_semi") for x in (hashed, edited)]
    return mixed_buckets(both[0].union(both[1]))


def _numbered(hashed: DataFrame, mixed: DataFrame, full: DataFrame) -> DataFrame:
    """Where a bucket holds different bytes, append the number of the distinct text to the fingerprints of all but its first."""
    full = full.withColumn("canon", canonical(F.col("text")))
    both = full.select("h1", "h2", "canon").union(full.select("e1", "e2", "e_canon"))
    distinct = both.join(mixed.distinct(), ["h1", "h2"], "left_semi").distinct()
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1
    table = distinct.select("h1", "h2", "canon", F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("").alias("no"))
    own = table.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("canon").alias("x"), F.col("no").alias("own_no"))
    other = table.select(F.col("h1").alias("y1"), F.col("h2").alias("y2"), F.col("canon").alias("y"), F.col("no").alias("other_no"))
    out = full.join(own, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")) & (F.col("canon") == F.col("x")), "left")
    out = out.join(other, (F.col("e1") == F.col("y1")) & (F.col("e2") == F.col("y2")) & (F.col("e_canon") == F.col("y")), "left")
    for c, no in (("fingerprint", "own_no"), ("edited_fingerprint", "other_no")):
        out = out.withColumn(c, F.concat(F.col(c), F.coalesce(F.col(no), F.lit(""))))
    return out
