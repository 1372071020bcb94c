"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents. It
labels every position of a word's bytes; its state begins anew at each word, so equal words share one
evaluation and each task keeps a bounded table of the words it has met. A document's probabilities are the mean
over all positions of its whole text.

Words are runs of letters: A-Z are lower-cased, other ASCII characters separate, bytes from 0x80 on belong to
words; longer words are cut into stretches of SPAN bytes, and every stretch is labelled.

The training sample is bounded in rows (max_documents); each gives the words of its whole text with their counts, which
tasks count. Labels are of every position of whole texts, however long.

Cases: a text that is null or has no letter (numerals and signs are none) is "und" with score 0, as is every text if nothing was learned (no
labelled rows). Rows with a null id or language are never learned from. Repeated rows get equal results. An
empty table gives an empty table. Extra columns are carried through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, fresh, sample_by_hash

#: Bytes of a stretch, words kept in a task's table.
SPAN, TABLE_WORDS = 24, 300_000
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def stretches(text: str) -> list[bytes]:
    words = text.encode().translate(FOLD).split()
    if max(map(len, words), default=0) > SPAN:
        words = [w[k : k + SPAN] for w in words for k in range(0, len(w), SPAN)]
    return words


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time x words) and lengths."""
    n = np.array([len(w) for w in words])
    x = np.frombuffer(b"".join(w.ljust(int(n.max()), b"\0") for w in words), np.uint8).reshape(len(words), -1).T
    return np.ascontiguousarray(x), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One direction of the network: gates z and r, candidate c; the reset gate applies after the recurrent product."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.W = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.U = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def run(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """States after each step, (time, words, hidden); live: 1 where a word goes on. keep: what backward() needs."""
        n = self.U.shape[0]
        h, out, kept = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            g, a = self.W[x[t]] + self.b, h @ self.U
            zr = _sigmoid(g[:, : 2 * n] + a[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(g[:, 2 * n :] + r * a[:, 2 * n :])
            new = c + z * (h - c)
            if keep:
                kept.append((h, z, r, c, a[:, 2 * n :]))
            h = new if live[t].all() else np.where(live[t][:, None], new, h)
            out[t] = h
        return out, kept

    def backward(self, x, live, kept, grad):
        """Gradients of W, U and b from those of the states: backpropagation through time."""
        n = self.U.shape[0]
        dW, dU, db = np.zeros_like(self.W), np.zeros_like(self.U), np.zeros_like(self.b)
        dh = np.zeros(grad.shape[1:], np.float32)
        for t in reversed(range(len(x))):
            h, z, r, c, a = kept[t]
            dh = dh + grad[t]
            d = dh * live[t][:, None]
            dc = d * (1 - z) * (1 - c * c)
            dz, dr = d * (h - c) * z * (1 - z), dc * a * r * (1 - r)
            da = np.concatenate((dz, dr, dc * r), 1)
            dg = np.concatenate((dz, dr, dc), 1)
            dU += h.T @ da
            db += dg.sum(0)
            np.add.at(dW, x[t], dg)
            dh = dh * ~live[t][:, None] + d * z + da @ self.U.T
        return dW, dU, db


class ByteNet:
    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.there, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.O = rng.normal(0, 0.2, (2 * hidden, len(langs))).astype(np.float32)
        self.o = np.zeros(len(langs), np.float32)

    def _states(self, words: list[bytes], keep: bool = False):
        x, n = padded(words)
        live = np.arange(len(x))[:, None] < n
        at = np.where(live, n - 1 - np.arange(len(x))[:, None], np.arange(len(x))[:, None])  # each word turned round in its place
        y = np.take_along_axis(x, at, 0)
        f, kf = self.there.run(x, live, keep)
        b, kb = self.back.run(y, live, keep)
        return x, y, live, at, f, np.take_along_axis(b, at[:, :, None], 0), kf, kb

    def _probabilities(self, f, b):
        s = np.concatenate((f, b), 2) @ self.O + self.o
        e = np.exp(s - s.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def label(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum over its positions of the languages' probabilities."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for k in range(0, len(order), 4096):
            part = order[k : k + 4096]
            _, _, live, _, f, b, _, _ = self._states([words[i] for i in part])
            out[part] = (self._probabilities(f, b) * live[:, :, None]).sum(0)
        return out

    def step(self, words: list[bytes], target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over all positions, and the gradients in the order of params()."""
        x, y, live, at, f, b, kf, kb = self._states(words, keep=True)
        p = self._probabilities(f, b)
        total = live.sum()
        picked = np.take_along_axis(p, target[None, :, None], 2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * live).sum() / total)
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(target[None, :, None], (*d.shape[:2], 1)), (picked - 1)[:, :, None], 2)
        d *= (live / total)[:, :, None].astype(np.float32)
        both = np.concatenate((f, b), 2).reshape(-1, 2 * self.hidden)
        flat = d.reshape(-1, len(self.langs))
        back = (flat @ self.O.T).reshape(*live.shape, -1)
        df, db = back[:, :, : self.hidden], np.take_along_axis(back[:, :, self.hidden :], at[:, :, None], 0)
        return loss, [*self.there.backward(x, live, kf, df), *self.back.backward(y, live, kb, db), both.T @ flat, flat.sum(0)]

    def params(self) -> list[np.ndarray]:
        return [self.there.W, self.there.U, self.there.b, self.back.W, self.back.U, self.back.b, self.O, self.o]

    def fit(self, examples: list[tuple[str, list[bytes] | dict[bytes, int]]], steps: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over batches with as many words of each language, each as likely as it is frequent; examples: (language, words
        of a document, or their counts)."""
        rng = np.random.default_rng(seed)
        counts = {name: Counter() for name in self.langs}
        for lang, words in examples:
            counts[lang].update(words)
        pools = [(list(c), np.cumsum(list(c.values()))) for c in counts.values()]
        m, v = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        for k in range(1, steps + 1):
            target = rng.integers(0, len(pools), batch)
            words = [pools[t][0][np.searchsorted(pools[t][1], x * pools[t][1][-1], side="right")] for t, x in zip(target, rng.random(batch))]
            _, grads = self.step(words, target)
            size = rate * (1 - k / (steps + 1))
            for p, g, a, b in zip(self.params(), grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= size * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = 800) -> ByteNet | None:
    """A network from at most max_documents of the rows where learn holds (by a hash of the id), each with its whole text.
    None if there are none."""
    arrow_limits(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = sample_by_hash(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")), "id", max_documents)

    def count(batches):
        for b in batches:
            words = [Counter(stretches(t)) if LETTER.search(t) else Counter() for t in b.column(2).to_pylist()]
            lists = pa.array([list(c) for c in words], pa.list_(pa.binary())), pa.array([list(c.values()) for c in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), *lists], ["lang", "words", "times"])

    found = rows.mapInArrow(count, "lang string, words array<binary>, times array<bigint>").collect()
    examples = [(r.lang, dict(zip(map(bytes, r.words), r.times))) for r in found if r.words]
    if not examples:
        return None
    net = ByteNet(sorted({lang for lang, _ in examples}))
    net.fit(examples)
    return net


class Reader:
    """Pools the network's labels over documents, by a bounded table of words."""

    def __init__(self, net: ByteNet):
        self.net, self.at = net, {}
        self.sums, self.sizes = np.zeros((0, len(net.langs)), np.float32), np.zeros(0, np.float32)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.at) + len(words) > TABLE_WORDS:
            self.__init__(self.net)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.sums = np.concatenate((self.sums, self.net.label(words)))
        self.sizes = np.concatenate((self.sizes, np.array([len(w) for w in words], np.float32)))

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for k in range(0, len(texts), 200):
            counted = [Counter(stretches(t)) if t and LETTER.search(t) else None for t in texts[k : k + 200]]
            seen = dict.fromkeys(w for c in counted if c for w in c)
            if new := [w for w in seen if w not in self.at]:
                self._learn(new)
                if len(self.at) == len(new) and len(new) < len(seen):  # the table began anew
                    self._learn([w for w in seen if w not in self.at])
            for c in counted:
                if not c:
                    out.append(("und", 0.0))
                    continue
                at = np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))
                times = np.fromiter(c.values(), np.float32, len(c))
                p = times @ self.sums[at] / float(times @ self.sizes[at])
                best = int(p.argmax())
                out.append((self.net.langs[best], min(1.0, float(p[best]))))
        return out


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with new columns, named by the returned dict: lang_pred, score."""
    spark = docs.sparkSession
    arrow_limits(spark)
    names = {x: fresh(docs, x) for x in ("lang_pred", "score")}
    if net is None:
        return docs.select("*", F.lit("und").alias(names["lang_pred"]), F.lit(0.0).alias(names["score"])), names
    at, sent = docs.columns.index(text_col), spark.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType())])

    def run(batches):
        reader = Reader(sent.value)
        for b in batches:
            said = reader.read(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema), names


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _lettered(docs: DataFrame, text_col: str) -> DataFrame:
    """docs of which the text has a letter."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([bool(t and LETTER.search(t)) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_unidentified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that have no language ("und"); all columns stay. Where nothing can be learned from, those with
    a letter stay."""
    net = train(docs, ~held_out())
    if net is None:
        return _lettered(docs, text_col)
    out, c = identify(docs, net, text_col)
    return out.where(F.col(c["lang_pred"]) != "und").select(docs.columns)
