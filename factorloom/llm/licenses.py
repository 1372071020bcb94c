"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of every file, each two neighbouring lines that have words, and the file as a whole are compared with the
templates. Term frequencies are those of
the line; document frequencies of the templates' words are counted over all files; with all_words, as the query asks,
those of all words, so that the score does not fade as the table grows. Words stay in
tables; the counts of those of lines that can match come back to the texts that have such lines, one row for each such
text. A file whose best likeness
reaches the threshold has that licence of its own. A file named like a licence file, or of which most words (by
default four fifths) lie in matching lines, speaks for its directory and all below it; a file without a licence of its own
takes that of the nearest such directory. Ancestors are enumerated once for each distinct directory, not for each
file, and joined by path.

What was found is written: files beside one another in one directory, however many,
are joined with what speaks for it from written tables, so that Spark can split a hot directory.

Cases: very long texts are read whole; a null text has no licence of its own; a null path is in no directory and inherits nothing; ties between
templates go to the first name; several licence files of one directory: the greatest likeness, then the first
name, speaks. Repeated rows get equal results. Empty tables give empty tables. Extra columns are carried through.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, forget, fresh, materialize

#: Fixed value: the permission notice of the MIT licence.
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Fixed value: the permission notice of the ISC licence.
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Header notices, opening lines of licence files and full notices.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"),
    "ISC": ("Licensed under the ISC License", ISC_TEXT),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", MIT_TEXT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
}
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying)([._-][^/]*)?$"
WORD = re.compile(r"[a-z0-9]+")
#: Words of which a task holds the counts.
TABLE_WORDS = 1 << 18


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Matcher:
    """Cosine of TF-IDF vectors. df: of the templates' words; other words of which a call's own counts have nothing count
    as words of one document in the vector's length, or weigh rare."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n: int, df: dict[str, int], rare: float | None = None):
        self.n, self.df = n, df
        self.rare = self._weight(1) if rare is None else rare
        self.templates = []
        for name in sorted(templates):
            for text in templates[name]:
                v = {w: c * self._weight(df.get(w, 0)) for w, c in Counter(words_of(text)).items()}
                self.templates.append((name, v, math.sqrt(sum(x * x for x in v.values()))))
        self.vocabulary = {w for _, v, _ in self.templates for w in v}
        self.reaches = functools.lru_cache(1 << 16)(self._reaches)

    def _reaches(self, known: frozenset[str], least: float) -> bool:
        """Whether words of which these are the templates' can reach this likeness: a cosine is at most the share of a
        template's length that lies in words of both."""
        return any(math.sqrt(sum(t[w] ** 2 for w in known if w in t)) >= least * size - 1e-9 for _, t, size in self.templates)

    def candidates(self, text: str | None, least: float) -> list[tuple[list[str], int | None, int | None, int]]:
        """The units of the text that can reach this likeness; none, without a look at its lines, if the text's words
        cannot."""
        known = self.vocabulary.intersection(words_of(text or ""))
        if not self.reaches(frozenset(known), least):
            return []
        return [u for u in units(text) if self.reaches(frozenset(self.vocabulary.intersection(u[0])), least)]

    def _weight(self, files: int) -> float:
        return math.log((self.n + 1) / (files + 1)) + 1

    def best(self, words: list[str], others: dict[str, int]) -> tuple[float, str | None]:
        """others: in how many files words outside the templates stand."""
        known = self.vocabulary.intersection(words)
        if not known:
            return 0.0, None
        length = 0.0
        v = {}
        for w, c in Counter(words).items():
            if w in known:
                v[w] = x = c * self._weight(self.df.get(w, 0))
            else:
                x = c * (self._weight(others[w]) if w in others else self.rare)
            length += x * x
        length = math.sqrt(length)
        top = (0.0, None)
        for name, t, size in self.templates:
            dot = sum(x * t[w] for w, x in v.items() if w in t)
            if dot > top[0] * length * size + 1e-12:
                top = (dot / (length * size), name)
        return top

    def scan(self, text: str | None, least: float, others: dict[str, int]) -> tuple[str | None, float, int | None, float]:
        """The licence, its likeness, the line (null: the file as a whole), and the share of the words in matching lines."""
        found: tuple[float, str | None, int | None] = (0.0, None, None)
        matched: set[int] = set()
        everywhere = False
        for words, first, last, kind in self.candidates(text, least):
            score, name = self.best(words, others)
            if score >= least:
                everywhere |= kind == WHOLE
                matched.update(() if kind == WHOLE else (first, last))
                if score > found[0] + 1e-12:
                    found = (score, name, first)
        if found[1] is None:
            return None, 0.0, None, 0.0
        sizes = {first: len(words) for words, first, _, kind in units(text) if kind == LINE}
        share = 1.0 if everywhere else sum(sizes[k] for k in matched) / sum(sizes.values())
        return found[1], found[0], found[2], share


LINE, PAIR, WHOLE = range(3)


def units(text: str | None):
    """What is compared of a text: (words, first line, last line, kind) of each line, of each two neighbouring lines that have words,
    and of the whole (lines: null) if it has more than two such lines."""
    before: tuple[list[str], int] | None = None
    lines = []
    for k, line in enumerate((text or "").split("\n")):
        words = words_of(line)
        if not words:
            continue
        lines.append(words)
        yield words, k, k, LINE
        if before:
            yield before[0] + words, before[1], k, PAIR
        before = (words, k)
    if len(lines) > 2:
        yield [w for words in lines for w in words], None, None, WHOLE


def frequencies(files: DataFrame, text_col: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """Over all files: in how many each word stands (word, n), of all words or those of a set; the number of files as that
    of the empty word. A task counts all its files before it gives words, TABLE_WORDS at most at a time."""
    at = files.select(text_col)

    def packet(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = set(words_of(text or ""))
                seen.update(words if wanted is None else wanted.intersection(words))
                if len(seen) > TABLE_WORDS:
                    yield packet(seen)
                    seen.clear()
            seen[""] += b.num_rows
        if seen:
            yield packet(seen)

    return at.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def matched(files: DataFrame, at: int, keep: list[int], fields: list[T.StructField], matcher, least: float, others: int | None = None) -> DataFrame:
    """The columns keep of files and, as these fields, what Matcher.scan() finds in the text in column at. others: the
    column of (word, n) of each text."""

    def run(batches):
        m = matcher()
        for b in batches:
            own = b.column(others).to_pylist() if others is not None else [None] * b.num_rows
            found = list(zip(*(m.scan(t, least, {x["word"]: x["n"] for x in o or ()}) for t, o in zip(b.column(at).to_pylist(), own)))) or [[]] * 4
            made = [pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], schema.names)

    schema = T.StructType([*(files.schema.fields[k] for k in keep), *fields])
    return files.mapInArrow(run, schema)


def matched_by_all_words(files: DataFrame, text_col: str, keep: list[int], fields: list[T.StructField], n: int, df: dict[str, int], templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """As matched(), with the counts of all words of the lines that can match."""
    spark, at = files.sparkSession, files.columns.index(text_col)
    key, text, words, others = (fresh(files, x) for x in ("text_key", "text_read", "outside", "others"))
    schema = T.StructType([*(files.schema.fields[k] for k in keep), T.StructField(key, T.StringType()), T.StructField(text, T.StringType()), T.StructField(words, T.ArrayType(T.StringType()))])

    def run(batches):
        # Words outside the templates weigh the least that a word can: no other line reaches the threshold, whatever
        # the words' frequencies are.
        m = Matcher(templates, n, df, rare=1.0)
        for b in batches:
            keys, texts, outside = [], [], []
            for t in b.column(at).to_pylist():
                near = [u[0] for u in m.candidates(t, least) if m.best(u[0], {})[0] >= least - 1e-9]
                keys.append(hashlib.blake2b(t.encode(), digest_size=16).hexdigest() if near else None)
                texts.append(t if near else None)
                outside.append(sorted({w for u in near for w in u} - m.vocabulary) if near else None)
            made = [pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(outside, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], schema.names)

    rows = materialize(spark, files.mapInArrow(run, schema))
    pairs = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(words).alias("word")).distinct()
    pairs = materialize(spark, pairs)
    # Both sides of the join are tables, so that Spark can split a word that most of the texts have.
    counts = materialize(spark, frequencies(files, text_col))
    given = materialize(spark, pairs.join(counts, "word").groupBy("k").agg(F.collect_list(F.struct("word", "n")).alias("o")))
    forget(spark, pairs, counts)
    far = rows.where(F.col(key).isNull()).select(*rows.columns[: len(keep)], *(F.lit(0.0 if f.dataType == T.DoubleType() else None).cast(f.dataType).alias(f.name) for f in fields))
    near = rows.where(F.col(key).isNotNull()).join(given.toDF("_k_" + key, others), F.col(key) == F.col("_k_" + key), "left").select(*rows.columns, others)
    kept = len(keep)
    near = matched(near, kept + 1, list(range(kept)), fields, lambda: Matcher(templates, n, df), least, kept + 3)
    out = materialize(spark, far.union(near))
    forget(spark, rows, given)
    return out


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8, file_share: float = 0.8, all_words: bool = False, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """files (without the text, unless keep_text) with new columns, named by the returned dict: license, score, line (their own), inherited, inherited_from
    (a directory; "" is the root), effective."""
    spark = files.sparkSession
    arrow_limits(spark)
    names = {x: fresh(files, x) for x in ("license", "score", "line", "share", "dir", "inherited", "inherited_from", "effective")}
    vocabulary = {w for texts in templates.values() for t in texts for w in words_of(t)}
    df = {r.word: r.n for r in frequencies(files, text_col, frozenset(vocabulary)).collect()}  # a row for each word of the templates
    n = df.pop("", 0)
    at = files.columns.index(text_col)
    kinds = {"license": T.StringType(), "score": T.DoubleType(), "line": T.IntegerType(), "share": T.DoubleType()}
    keep = [k for k, c in enumerate(files.columns) if keep_text or c != text_col]
    kept = [files.columns[k] for k in keep]
    fields = [T.StructField(names[k], kind) for k, kind in kinds.items()]
    if all_words:
        found = matched_by_all_words(files, text_col, keep, fields, n, df, templates, least)
    else:
        found = materialize(spark, matched(files, at, keep, fields, lambda: Matcher(templates, n, df), least))

    path = F.col(path_col)
    rows = found.withColumn(names["dir"], F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), ""))
    own = F.col(names["license"])
    speaks = rows.where(own.isNotNull() & F.col(names["dir"]).isNotNull() & (path.rlike(LICENCE_FILE) | (F.col(names["share"]) >= file_share)))
    given = speaks.groupBy(F.col(names["dir"]).alias("ancestor")).agg(F.min_by(own, F.struct(-F.round(names["score"], 9), own)).alias("given"))
    dirs = rows.select(F.col(names["dir"]).alias("d")).where("d is not null").distinct()
    parts = F.split("d", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    above = dirs.select("d", F.explode(F.when(F.col("d") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor")))).otherwise(above)).alias("a")).select("d", "a.depth", "a.ancestor")
    nearest = above.join(given, "ancestor").groupBy("d").agg(F.max_by(F.struct("given", "ancestor"), "depth").alias("n")).select("d", F.col("n.given"), F.col("n.ancestor"))
    at_dir, given_col, from_col = (fresh(rows, x) for x in ("at_dir", "given", "from"))
    nearest = materialize(spark, nearest)
    out = rows.join(nearest.toDF(at_dir, given_col, from_col), F.col(names["dir"]) == F.col(at_dir), "left")
    inherits = own.isNull()
    out = out.select(
        *(F.col(c) for c in kept), own, F.col(names["score"]), F.col(names["line"]),
        F.when(inherits, F.col(given_col)).alias(names["inherited"]), F.when(inherits, F.col(from_col)).alias(names["inherited_from"]), F.coalesce(own, F.col(given_col)).alias(names["effective"]),
    )
    return out, {x: names[x] for x in ("license", "score", "line", "inherited", "inherited_from", "effective")}
