"""SentencePiece encoding and decoding by tables of distinct marked words.

Where no piece of the model holds the whitespace marker after another character, merges never cross from a
word into the marker that opens the next, so a text is segmented word by word. Each task keeps a bounded table
of the distinct marked words it has met (a marker run and what follows it up to the next); the library segments
each of them once a task, and ids are joined back by position. One table for all tasks would shuffle every word of
every text, or grow with the corpus in every task; so the table is the task's own, and nothing is shuffled. A model with crossing pieces, or
one that rewrites texts before segmenting, is found by a check, and its texts are encoded whole.

Cases: a null text is encoded as an empty one (only begin and end ids); U+2581 in a text is the marker itself,
as in the library; repeated rows get equal results; very long texts are encoded whole, and very long words are encoded like any other but not kept in the table. An empty table gives
an empty table. Extra columns are carried through.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_limits, fresh

#: The marker, and the bounds of a task's table (words, bytes of a word).
MARK, TABLE_WORDS, WORD_BYTES = "▁", 800_000, 400
PROBES = ("a  b", " a ", "ﬁ Ⅳ é", "a b\t c\r\nd", "　x​y", "Ａ１")


class Words:
    """Ids (as bytes) and decoded text of each distinct marked word, by the word without its marker."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.table: dict[str, tuple[bytes, str]] = {}
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and all(self._same(t) for t in PROBES)
        self.ends = (np.array([sp.bos_id()], "<u4").tobytes(), np.array([sp.eos_id()], "<u4").tobytes())

    def _same(self, text: str) -> bool:
        """Whether encoding and decoding word by word gives what the library gives."""
        coded = self._segment(self._split(text))
        ids = [i for c in coded for i in c]
        return ids == self.sp.encode(text) and "".join(" " + self.sp.decode(c) for c in coded)[1:] == self.sp.decode(ids)

    def _segment(self, words: list[str]) -> list[list[int]]:
        """The library's ids of marked words; it puts the marker itself, but not before nothing."""
        alone = [self.sp.piece_to_id(MARK)]
        return [ids if w else alone for w, ids in zip(words, self.sp.encode(words, num_threads=1))]

    @staticmethod
    def _split(text: str) -> list[str]:
        """The marked words, each without its first marker: the library puts a marker before the text, and each run of
        markers opens a word."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in MARKED.findall(" " + text)] if text else []
        return text.split(" ")

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """Segments these distinct words once and keeps them in the table, but for long ones, which are returned.

        Words that open with one marker go to the library as one text: the marker opens each word's ids again. They
        decode to themselves if the whole does."""
        rest, odd = {}, words
        plain = [w for w in words if w and w[0] != " "]
        if plain:
            line = " ".join(plain)
            ids = self.sp.encode(line)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(plain):
                same = self.sp.decode(ids) == line
                packed, cuts = np.array(ids, "<u4").tobytes(), (4 * np.append(at, len(ids))).tolist()
                for w, a, b in zip(plain, cuts, cuts[1:]):
                    own = packed[a:b]
                    said = w if same else self.sp.decode(ids[a // 4 : b // 4])
                    (self.table if len(w) < WORD_BYTES else rest)[w] = own, " " + said
                odd = [w for w in words if not w or w[0] == " "]
        for w, ids in zip(odd, self._segment(odd)):
            (self.table if len(w) < WORD_BYTES else rest)[w] = np.array(ids, "<u4").tobytes(), " " + self.sp.decode(ids)
        return rest

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text, its ids with begin and end as bytes, and the decoded text."""
        out = []
        for t in texts if not self.by_word else ():
            ids = self.sp.encode(t, add_bos=True, add_eos=True)
            out.append((np.array(ids, "<u4").tobytes(), self.sp.decode(ids)))
        for t in texts if self.by_word else ():
            words = self._split(t)
            try:
                parts = list(map(self.table.__getitem__, words))
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in self.table]
                if len(self.table) + len(new) > TABLE_WORDS:
                    self.table.clear()
                    new = list(dict.fromkeys(words))
                rest, held = self._learn(new), self.table
                parts = list(map(held.__getitem__, words)) if not rest else [held[w] if w in held else rest[w] for w in words]
            ids, said = zip(*parts) if parts else ((), ())
            out.append((b"".join((self.ends[0], *ids, self.ends[1])), "".join(said)[1:]))
        return out


MARKED = re.compile(r" +[^ ]*")


def encode(docs: DataFrame, model: str, text_col: str = "text", digests: bool = False, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with new columns, named by the returned dict: n_tokens, ids (array of int; begin and end included), decoded.

    digests: instead of ids and decoded, the SHA-256 of the ids as little-endian unsigned 32-bit integers
    (ids_sha256) and of the decoded text in UTF-8 (decoded_sha256). keep_text: keep the text column.
    """
    arrow_limits(docs.sparkSession)
    kinds = {"n_tokens": T.LongType()} | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()})
    names = {x: fresh(docs, x) for x in kinds}
    at = docs.columns.index(text_col)
    keep = [k for k, c in enumerate(docs.columns) if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema.fields[k] for k in keep), *(T.StructField(names[x], kind) for x, kind in kinds.items())])

    def run(batches):
        words = Words(model)
        for b in batches:
            coded = words.encode_all([t or "" for t in b.column(at).to_pylist()])
            made = [pa.array([len(i) // 4 for i, _ in coded], pa.int64())]
            if digests:
                made += [pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in coded])]
                made[1:] = [m.cast(pa.string()) for m in made[1:]]
            else:
                flat = np.frombuffer(b"".join(i for i, _ in coded), "<u4").astype(np.int32)
                ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i, _ in coded]))).astype(np.int32)
                made += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([t for _, t in coded], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], schema.names)

    return docs.mapInArrow(run, schema), names


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> tuple[DataFrame, str]:
    """rows with the decoded text of an array of ids in a new column, whose name is returned; a null array gives null."""
    name, at = fresh(rows, "decoded"), rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        sp = Words(model).sp
        for b in batches:
            said = [None if i is None else sp.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], schema.names)

    return rows.mapInArrow(run, schema), name
