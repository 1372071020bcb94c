"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removal by components.

Paragraphs are
- lines of SIZE words or more, and whole texts of fewer than SIZE words: what authors set apart;
- stretches of SIZE words that begin at a word chosen by content: of every SPREAD consecutive starts, the one whose
  five-word shingle hashes lowest; a document's first and last SIZE words are stretches too. Equal passages of
  SIZE + SPREAD - 1 = 50 words or more, wherever they stand in their lines, hence have a stretch in common.

Shorter lines (headings, greetings, notices) repeat by nature and are no passages: a line of fewer than SIZE words is
compared only as part of what it stands in.

Equal paragraphs, by 128 bits of their words, are one content: whatever repeats a thousand times is one row of what
follows. The MinHash values of each distinct line's five-word shingles, two to a band, bring it to buckets; the bands
are as many as find a pair of the given likeness with the given recall. All contents of a bucket are compared with all
by exact Jaccard of their shingles (as 64-bit hashes); a large bucket is dealt in pairs of blocks, so that its size
decides only where they are compared. Stretches differ from each other by more than 0.8 once a word inside them
changes, so they are compared for equality alone. Links form components; a component's paragraphs stay in the document
of its smallest (id, word) and go from all others, with the words on either side that are those beside it in the first.

Words are runs of letters and digits (A-Z lower-cased), so punctuation and case do not matter.

Cases: a null text, or one without words, has no paragraph; rows of a null id are left alone; rows that repeat an id
are edited alike where their texts are equal, each by its own text otherwise, and which of them gives the place of a
class is not said; repeats inside one document stay. Very long texts are hashed in pieces and never cut short. An empty
table gives an empty table. Extra columns are carried through.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_limits, components, forget, fresh, materialize
from .decontaminate import FOLD

#: Words of a paragraph at least, starts among which one is chosen, words of a shingle, likeness.
SIZE, SPREAD, SHINGLE, LIKENESS = 26, 25, 5, 0.8
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Odd bases of the polynomials of a word's bytes, and of a paragraph's words (two, for 128 bits).
BASE, BASES = 0x100000001B3, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: MinHash values in a band; contents, and words of contents, beyond which a bucket is compared in pairs of blocks.
ROWS, REST, REST_WORDS = 2, 20_000, 2_000_000
#: Bytes hashed at once; bytes of texts whose paragraphs are made at once.
PIECE, PART = 3 << 16, 4 << 20


def bands_for(likeness: float = LIKENESS, recall: float = 0.99) -> int:
    """So many bands of ROWS MinHash values each find a pair of the given likeness with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - likeness**ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(16)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    return _all_powers(base, 1 << max(18, n.bit_length()))[:n]


def _spans(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a folded line, and the byte after its last."""
    data = np.frombuffer(line, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], data != 32, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _words(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a folded line, and its first byte. No word is made an object of its own: its hash is
    its polynomial in an odd base modulo 2**64, read off prefix sums, and mixed. Long lines are cut between words."""
    hashes, starts, at = [], [], 0
    while at < len(line):
        to = line.find(b" ", at + PIECE) if at + PIECE < len(line) else -1
        to = len(line) if to < 0 else to
        part = line[at:to]
        start, end = _spans(part)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(np.frombuffer(part, np.uint8) * _powers(BASE, len(part)), out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * _powers(pow(BASE, -1, 2**64), len(part))[start] + (end - start).astype(np.uint64) * MIX[0]))
        starts.append(start + at)
        at = to
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def words_and_lines(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after another: the hash of each word, the number of words of each text, and the first word of each
    line that has words."""
    raw = b" ".join(t or b"" for t in texts) + b" "
    h, start = _words(raw.translate(FOLD))
    ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    breaks = np.concatenate(([0], np.flatnonzero((data == 10) | (data == 13)), ends))
    lines = np.unique(np.searchsorted(start, breaks))
    return h, np.diff(np.searchsorted(start, ends), prepend=0), lines[lines < len(h)]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return words_and_lines(texts)[:2]


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Of consecutive words' hashes."""
    n = max(len(h) - SHINGLE + 1, 0)
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE if n else 0):
        s = s * MIX[0] + h[k : k + n]
    return mix(s)


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values, by doubling."""
    have = 1
    while 2 * have <= n:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


class Paragraphs:
    """The paragraphs of some texts: doc (position among the texts), start (word), size (words), the content (a and b),
    and whether each is a line or a whole short text."""

    def __init__(self, texts: list[bytes | None]):
        h, sizes, line_starts = words_and_lines(texts)
        ends = np.cumsum(sizes)
        begins, total = ends - sizes, int(sizes.sum())
        self.h, self.s = h, shingle_hashes(h)
        at = self._stretches(sizes, begins, ends, total)
        short = (sizes > 0) & (sizes < SIZE)
        length = np.diff(np.append(line_starts, total))
        long = length >= SIZE
        first, size = np.concatenate((line_starts[long], begins[short])), np.concatenate((length[long], sizes[short]))
        # A stretch that is a line is a line.
        one_line = np.sort(line_starts[length == SIZE])
        if len(at) and len(one_line):
            at = at[one_line[np.minimum(np.searchsorted(one_line, at), len(one_line) - 1)] != at]
        self.line = np.concatenate((np.zeros(len(at), bool), np.ones(len(first), bool)))
        self.at, self.size = np.concatenate((at, first)), np.concatenate((np.full(len(at), SIZE), size))
        order = np.lexsort((self.size, self.at))
        self.at, self.size, self.line = self.at[order], self.size[order], self.line[order]
        self.doc = np.searchsorted(ends, self.at, side="right")
        self.start = self.at - begins[self.doc]
        self.begins = begins
        self.a, self.b = (self._content(k) for k in (0, 1))
        # Whether it is the first of its content in its text.
        self.first = np.zeros(len(self.at), bool)
        self.first[np.unique(mix(self.a + self.doc.astype(np.uint64) * MIX[0]), return_index=True)[1]] = True

    def _content(self, k: int) -> np.ndarray:
        x = self.h if k == 0 else mix(self.h ^ MIX[2])
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _powers(BASES[k], len(x)), out=sums[1:])
        whole = (sums[self.at + self.size] - sums[self.at]) * _powers(pow(BASES[k], -1, 2**64), len(x) + 1)[self.at]
        return mix(whole + self.size.astype(np.uint64) * MIX[0])

    def _stretches(self, sizes, begins, ends, total) -> np.ndarray:
        """First words of the stretches that are chosen by content."""
        long = np.flatnonzero(sizes >= SIZE)
        if not len(long):
            return np.zeros(0, np.int64)
        # A start is valid if the stretch ends in its text. Only starts that are all valid are chosen among, so that a
        # text's stretches do not depend on its neighbours here.
        step = np.zeros(total + 1, np.int64)
        np.add.at(step, begins[long], 1)
        np.add.at(step, ends[long] - SIZE + 1, -1)
        valid = np.cumsum(step)[: len(self.s)] > 0
        order = np.where(valid, self.s, np.uint64(2**64 - 1))
        chosen = np.zeros(len(order), bool)
        if len(order) >= SPREAD:
            least = np.where(_sliding(valid, SPREAD, np.minimum), _sliding(order, SPREAD, np.minimum), np.uint64(0))
            pad = np.zeros(SPREAD - 1, np.uint64)
            chosen = order == _sliding(np.concatenate((pad, least, pad)), SPREAD, np.maximum)
        chosen &= valid
        chosen[begins[long]] = chosen[ends[long] - SIZE] = True
        return np.flatnonzero(chosen)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of these paragraphs, one's after another's, and where each one's begin. A paragraph of fewer than
        SHINGLE words is one shingle, itself."""
        count = np.maximum(self.size[which] - SHINGLE + 1, 1)
        first = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(first, count)
        padded = np.concatenate((self.s, np.zeros(SHINGLE, np.uint64)))
        out = padded[np.minimum(np.repeat(self.at[which], count) + place, len(padded) - 1)]
        few = self.size[which] < SHINGLE
        out[first[few]] = self.a[which][few]
        return out, first

    def bands(self, which: np.ndarray, bands: int) -> np.ndarray:
        """The value of each band (paragraphs x bands)."""
        if not len(which):
            return np.zeros((0, bands), np.int64)
        s, first = self.shingles(which)
        out = []
        for b in range(bands):
            value = np.full(len(which), b, np.uint64)
            for r in range(b * ROWS, (b + 1) * ROWS):
                # Shingle hashes are well mixed already: an odd multiple of each, shuffled by a constant, orders them anew.
                least = np.minimum.reduceat((s ^ np.uint64(int(MIX[1]) * (r + 1) % 2**64)) * np.uint64(int(MIX[0]) * (2 * r + 1) % 2**64), first)
                value = mix(value * MIX[2] + least)
            out.append(value)
        return np.stack(out, 1).view(np.int64)


def _parts(texts: list[bytes | None]):
    """Texts in runs of about PART bytes: (first, texts)."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or b"")
        if held >= PART:
            yield first, texts[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def paragraphs_of(docs: DataFrame, bands: int) -> DataFrame:
    """Of id, own, text: a row for each paragraph, with pos (first word), size, its content (a, b), whether it is the
    text's first of that content, and for lines and short texts the values of its bands."""

    def run(batches):
        for batch in batches:
            for first, texts in _parts(batch.column(2).cast(pa.binary()).to_pylist()):
                p = Paragraphs(texts)
                lines = np.flatnonzero(p.line)
                ends = np.concatenate(([0], np.cumsum(np.where(p.line, bands, 0)))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(p.bands(lines, bands).ravel(), pa.int64()))
                at = pa.array(p.doc + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(p.start.astype(np.int32)), pa.array(p.size.astype(np.int32)), pa.array(p.a.view(np.int64)), pa.array(p.b.view(np.int64)), pa.array(p.first), values], ["id", "own", "pos", "size", "a", "b", "first", "band"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, own bigint, pos int, size int, a bigint, b bigint, first boolean, band array<bigint>")


def _located(texts: list[bytes | None], places: list[list[dict]]):
    """For each text and the places (pos, size, a) that are asked of it, those that hold the content a: (text, place, Paragraphs, its number)."""
    for first, part in _parts(texts):
        p = Paragraphs(part)
        number = {x: n for n, x in enumerate(zip(p.doc.tolist(), p.start.tolist(), p.size.tolist()))}
        for k in range(len(part)):
            for place in places[first + k]:
                n = number.get((k, place["pos"], place["size"]))
                if n is not None and int(p.a[n].view(np.int64)) == place["a"]:
                    yield first + k, place, p, n


def shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted contents (a, b and a place: id, pos, size): a, b, the sorted distinct shingles."""
    lists = wanted.groupBy("id").agg(F.collect_set(F.struct("pos", "size", "a", "b")).alias("at"))
    rows = docs.join(lists, "id").select("text", "at")

    def run(batches):
        for batch in batches:
            a, b, sets = [], [], []
            for _, place, p, n in _located(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                a.append(place["a"])
                b.append(place["b"])
                sets.append(np.unique(p.shingles(np.array([n]))[0]).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["a", "b", "shingles"])

    # Rows that repeat an id give the same contents again.
    return rows.mapInArrow(run, "a bigint, b bigint, shingles array<bigint>").groupBy("a", "b").agg(F.first("shingles").alias("shingles"))


def alike(sets: list[np.ndarray], likeness: float, apart) -> list[tuple[int, int]]:
    """Pairs of these sets (arrays of distinct numbers) whose Jaccard reaches the likeness, as many as join all that such
    pairs join; pairs for which apart(i, j) holds are left out.

    Sets of that likeness share one of each one's n - ceil(likeness n) + 1 rarest members, so that a phrase common to
    the bucket brings no pair together and none is lost."""

    def like(i, j):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both >= likeness * (len(sets[i]) + len(sets[j]) - both) - 1e-9

    if len(sets) == 2:
        return [(0, 1)] if not apart(0, 1) and min(map(len, sets)) >= likeness * max(map(len, sets)) - 1e-9 and like(0, 1) else []
    length = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), length)
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((member, times[member], owner))  # each set's members from the rarest on
    rank = np.arange(len(order)) - np.repeat(np.cumsum(length) - length, length)
    rare = order[rank < np.repeat(length - np.maximum(np.ceil(likeness * length - 1e-9), 1) + 1, length)]
    member, owner = member[rare], owner[rare]
    by_member = np.lexsort((owner, member))
    member, owner = member[by_member], owner[by_member]
    begin = np.searchsorted(member, member)
    at = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[at], np.arange(len(sets) + 1))
    label, out = np.arange(len(sets)), []
    for k in range(len(sets)):
        near = [owner[begin[x] : x] for x in at[cuts[k] : cuts[k + 1]]]
        near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
        near = near[(label[near] != label[k]) & (np.minimum(length[near], length[k]) >= likeness * np.maximum(length[near], length[k]) - 1e-9)]
        for j in near.tolist():
            if label[j] != label[k] and not apart(j, k) and like(j, k):
                out.append((j, k))
                label[label == label[k]] = label[j]
    return out


def linked(buckets: DataFrame, likeness: float) -> DataFrame:
    """The links (u, v) of the contents (band, of, r, lo, hi, shingles) of each bucket: all are compared with all.

    Two contents that lie in one and the same document only (lo and hi, their least and greatest id) are not linked. A
    bucket is dealt in `of` blocks, and each pair of blocks is compared."""
    r = to_arrow_type(buckets.schema["r"].dataType)
    rows = buckets.withColumn("mine", F.pmod(F.xxhash64("r"), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "r", "lo", "hi", "shingles")
    rows = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def run(batches):
        def judge(bucket):
            names, lo, hi, sets = zip(*bucket)
            pairs = alike(list(sets), likeness, lambda i, j: lo[i] == hi[i] == lo[j] == hi[j])
            return [(names[i], names[j]) for i, j in pairs]

        def made(out):
            u, v = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, r), pa.array(v, r)], ["u", "v"])

        key, bucket = None, []
        for b in batches:
            out = []
            flat, offsets = b.column(6).values.to_numpy(zero_copy_only=False), b.column(6).offsets.to_numpy()
            for k, (band, x, y, name, lo, hi) in enumerate(zip(*(c.to_pylist() for c in b.columns[:6]))):
                if key != (band, x, y):
                    out += judge(bucket) if len(bucket) > 1 else []
                    key, bucket = (band, x, y), []
                bucket.append((name, lo, hi, flat[offsets[k] : offsets[k + 1]].copy()))
            yield made(out)
        yield made(judge(bucket) if len(bucket) > 1 else [])

    kind = buckets.schema["r"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def _near(docs: DataFrame, made: DataFrame, bands: int, likeness: float) -> DataFrame:
    """Of the lines among the paragraphs: a, b, root (id, pos, size, a, b) of those that are like another."""
    spark = docs.sparkSession
    r = F.min(F.struct("id", "pos", "size", "a", "b")).alias("r")
    lines = made.where("size(band) > 0").groupBy("a", "b").agg(r, F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("band").alias("band"))
    lines = materialize(spark, lines)
    rows = lines.select("a", "b", F.col("r.size").alias("size"), F.explode("band").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / max(REST, 1)), F.ceil(F.col("words") / REST_WORDS)).cast("int")
    shared = materialize(spark, sizes.select("band", blocks.alias("of")))
    met = materialize(spark, rows.join(shared, "band").select("band", "of", "a", "b"))
    wanted = lines.join(met.select("a", "b").distinct(), ["a", "b"], "left_semi").select("r.id", "r.pos", "r.size", "a", "b")
    contents = shingled(docs, wanted).join(lines.select("a", "b", "r", "lo", "hi"), ["a", "b"])
    buckets = materialize(spark, met.join(contents, ["a", "b"]).select("band", "of", "r", "lo", "hi", "shingles"))
    forget(spark, shared, met)
    roots = materialize(spark, components(spark, linked(buckets, likeness)))
    forget(spark, buckets, lines)
    out = roots.select("node.a", "node.b", "root")
    out._kept_at = roots._kept_at
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, recall: float = 0.99, written: list[DataFrame] | None = None) -> DataFrame:
    """A row for each paragraph that has its like in another document: id, own (hash of the row's text), pos (first
    word), size (words), root_id, root_pos, root_size, root_a (the component's smallest, and its content), removed
    (whether it stands in another document than that). written gets the tables that the result reads, to be deleted
    after it."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    bands = bands_for(likeness, recall)
    made = materialize(spark, paragraphs_of(rows, bands))
    near = _near(rows.select("id", "text"), made, bands, likeness)
    place = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("size")
    equal = made.groupBy("a", "b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by(place, F.when(F.col("first"), F.col("id"))).alias("place")).where("lo < hi")
    found = equal.join(near, ["a", "b"], "full").select(
        "a", "b", F.coalesce("root.id", "lo").alias("root_id"), F.coalesce("root.pos", F.shiftright("place", 32).cast("int")).alias("root_pos"),
        F.coalesce("root.size", F.col("place").bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("root_size"), F.coalesce("root.a", "a").alias("root_a"),
    )
    found = materialize(spark, found)  # a table of its own, so that the join can split whatever repeats most
    forget(spark, near)
    if written is not None:
        written += [made, found]
    out = made.select("id", "own", "pos", "size", "a", "b").join(found, ["a", "b"])
    return out.select("id", "own", "pos", "size", "root_id", "root_pos", "root_size", "root_a", (F.col("id") != F.col("root_id")).alias("removed"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(q, out[-1][1]))
        else:
            out.append((p, q))
    return out


def _runs(found: DataFrame) -> DataFrame:
    """Of the paragraphs that go: a row (id, own, start, stop, side, root place) for either end of each run of paragraphs
    that touch, with the place of the root of the paragraph that stands at that end."""
    kind = found.schema["id"].dataType.simpleString()
    lists = found.groupBy("id", "own").agg(F.collect_set(F.struct("pos", "size", "root_id", "root_pos", "root_size", "root_a")).alias("at"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for k, places in enumerate(batch.column(2).to_pylist()):
                places = sorted(tuple(p.values()) for p in places)
                for start, stop in joined([(p[0], p[0] + p[1]) for p in places]):
                    first = next(p for p in places if p[0] == start)
                    last = next(p for p in places if p[0] + p[1] == stop)
                    for side, p in ((0, first), (1, last)):
                        for column, x in zip(out, (k, k, start, stop, side, *p[2:])):
                            column.append(x)
            ids, own = (batch.column(c).take(pa.array(out[c], pa.int64())) for c in (0, 1))
            kinds = (pa.int32(), pa.int32(), pa.int32(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, own, *(pa.array(x, t) for x, t in zip(out[2:], kinds))], ["id", "own", "start", "stop", "side", "root_id", "root_pos", "root_size", "root_a"])

    return lists.mapInArrow(run, f"id {kind}, own bigint, start int, stop int, side int, root_id {kind}, root_pos int, root_size int, root_a bigint")


def _beside(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """For each root place, the hashes of the SPREAD words before it (nearest first) and after it. More than that are never
    equal on both sides of a run: another stretch would have been chosen there."""
    places = ["root_id", "root_pos", "root_size", "root_a"]
    lists = ends.groupBy("root_id").agg(F.collect_set(F.struct(F.col("root_pos").alias("pos"), F.col("root_size").alias("size"), F.col("root_a").alias("a"))).alias("at"))
    rows = docs.join(lists, F.col("id") == F.col("root_id")).select("root_id", "text", "at")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            who, pos, size, a, before, after = ([] for _ in range(6))
            for k, place, p, n in _located(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                begin = p.begins[p.doc[n]]
                end = p.begins[p.doc[n] + 1] if p.doc[n] + 1 < len(p.begins) else len(p.h)
                at, stop = p.at[n], p.at[n] + p.size[n]
                who.append(k)
                for column, x in zip((pos, size, a), (place["pos"], place["size"], place["a"])):
                    column.append(x)
                before.append(p.h[max(begin, at - SPREAD) : at][::-1].view(np.int64))
                after.append(p.h[stop : min(end, stop + SPREAD)].view(np.int64))
            words = [pa.array(x, pa.list_(pa.int64())) for x in (before, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(a, pa.int64()), *words], [*places, "before", "after"])

    made = rows.mapInArrow(run, f"root_id {kind}, root_pos int, root_size int, root_a bigint, before array<bigint>, after array<bigint>")
    # Rows that repeat an id may have other words beside the same content: the greatest list counts.
    return made.groupBy(*places).agg(F.max("before").alias("before"), F.max("after").alias("after"))


def _same(own: np.ndarray, root: list[int]) -> int:
    """How many words are the same from the first on."""
    n = min(len(own), len(root))
    differ = np.flatnonzero(own[:n] != np.array(root[:n], np.int64))
    return int(differ[0]) if len(differ) else n


def cut(text: str, runs: list[dict]) -> str | None:
    """The text without these runs of words (start, stop, side 0: the words before its root, side 1: the words after),
    each to the end of what it has in common with its root. None if no word is left."""
    raw = text.encode()
    line = raw.translate(FOLD)
    h = _words(line)[0].view(np.int64)
    spans = []
    for r in runs:
        if r["side"] == 0:
            spans.append((r["start"] - _same(h[max(0, r["start"] - SPREAD) : r["start"]][::-1], r["words"]), r["stop"]))
        else:
            spans.append((r["start"], r["stop"] + _same(h[r["stop"] : r["stop"] + SPREAD], r["words"])))
    spans = joined(spans)
    if sum(q - p for p, q in spans) >= len(h):
        return None
    start, end = _spans(line)
    out, at = [], 0
    for p, q in spans:
        out.append(raw[at : start[p]])
        at = end[q - 1]
    return b"".join((*out, raw[at:])).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, drop_empty: bool = True) -> DataFrame:
    """docs without the repeated passages of all but their first documents, each to its ends; all columns stay.

    drop_empty: rows of which no word is left are dropped; otherwise their text is empty."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    written: list[DataFrame] = []
    ends = materialize(spark, _runs(repeats(docs, id_col, text_col, likeness, written=written).where("removed")))
    forget(spark, *written)
    written = [ends]
    beside = materialize(spark, _beside(rows, ends))
    words = F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after"))
    ends = ends.join(beside, ["root_id", "root_pos", "root_size", "root_a"], "left").select("id", "own", "start", "stop", "side", F.coalesce(words, F.array().cast("array<bigint>")).alias("words"))
    lists = materialize(spark, ends.groupBy("id", "own").agg(F.collect_list(F.struct("start", "stop", "side", "words")).alias("runs")))
    forget(spark, *written, beside)
    key, own, runs = (fresh(docs, x) for x in ("key", "own", "runs"))
    lists = lists.select(F.col("id").alias(key), F.col("own").alias(own), F.col("runs").alias(runs))
    out = docs.join(lists, (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(own)), "left").select(*(docs[c] for c in docs.columns), F.col(runs))
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for k, places in enumerate(b.column(width).to_pylist()):
                left = cut(texts[k], places) if places else texts[k]
                keep.append(not (places and left is None and drop_empty))
                texts[k] = left if left is not None or not places else ""
            columns = [*b.columns[:width]]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(run, T.StructType(docs.schema.fields))
