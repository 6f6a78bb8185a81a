"""Toxicity by a convolutional text classifier trained in numpy.

Words and their prefixes are hashed to rows of an embedding table. Filters of several widths slide
over the embedded text, each keeps its maximum over the whole text, and a
logistic layer weighs the maxima. One embedding column starts from the smoothed
log-odds of its words in the labelled sample, the rest at random; all of it is
then trained by mini-batch Adam. A threshold per language, told from the text
alone by hyperdimensional profiles, is set on a part of the sample kept from
training; the score is the logistic of the distance to it.

Defined cases: null, empty and word-free texts are scored too, by their padding;
without labels of both classes (also with an empty table) every score is 0; labels of
one document that disagree count each, repeated ones once; texts are scored whole, very
long ones too; repeated rows and null ids are scored each; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize
from .fm_index import WORD_BYTES
from .hyperdim import Identifier
from .words import Words, chunks, mix

WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: A word is embedded as the mean of its own row and the rows of its prefixes of so many bytes.
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)


@dataclass
class Settings:
    rows: int = 1 << 15
    dim: int = 12
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 11
    least_for_threshold: int = 40


def _rows(words: Words, which, rows: int) -> np.ndarray:
    parts = [words.hashes[which], *(mix(words.prefixes(k, which) + np.uint64(k)) for k in PREFIXES)]
    return np.stack([h % np.uint64(rows) for h in parts], axis=1).astype(np.int32)


def hashed(texts: list[bytes | None], rows: int) -> list[np.ndarray]:
    """Embedding rows of each word of each text: of the word and of its prefixes; row ``rows`` pads the end."""
    out = []
    for _, part in chunks(texts):
        words = Words(part, WORD_BYTES)
        ids = _rows(words, slice(None), rows)
        pad = np.full((PAD, PARTS), rows, np.int32)
        out += [np.concatenate((ids[a:b], pad)) for a, b in zip(words.cuts[:-1], words.cuts[1:])]
    return out


@dataclass
class TextCNN:
    settings: Settings
    table: np.ndarray = None
    kernels: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray = None
    constant: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    def start(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        seen = np.zeros((2, s.rows + 1))
        for ids, label in zip(docs, y):
            seen[int(label), np.unique(ids)] += 1
        odds = np.log((seen[1] + 0.2) / (y.sum() + 0.4)) - np.log((seen[0] + 0.2) / (len(y) - y.sum() + 0.4))
        odds[seen.sum(0) < 2] = 0
        self.table = rng.normal(0, 0.1, (s.rows + 1, s.dim)).astype(np.float32)
        self.table[:, 0] = np.clip(odds / 2, -2, 2)
        self.table[s.rows] = 0
        for w in WIDTHS:
            self.kernels[w] = rng.normal(0, 0.2, (w, s.dim, s.filters)).astype(np.float32)
            self.kernels[w][:, 0, : s.filters // 2] += 1.0 / w
            self.bias[w] = np.zeros(s.filters, np.float32)
        self.weights = np.full(len(WIDTHS) * s.filters, 0.2, np.float32)

    def pooled(self, docs: list[np.ndarray], places: bool = False):
        """Maxima of all filters per text and, on demand, where in the joined text they stand."""
        ids = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        tops, where = [], []
        for w in WIDTHS:
            maps = self.bias[w] + 0
            for j in range(w):
                projected, own = self.projected(w, j), ids[j : len(ids) - w + 1 + j]
                for part in range(PARTS):
                    maps = maps + projected[own[:, part]]
            # Windows that reach over the end of a text are left out.
            maps = np.concatenate((maps, np.full((w - 1, maps.shape[1]), -np.inf, np.float32)))
            for k in range(1, w):
                maps[starts + sizes - k] = -np.inf
            top = np.maximum.reduceat(maps, starts)
            tops.append(top)
            if places:
                at = np.empty(top.shape, np.int64)
                for d, (a, n) in enumerate(zip(starts, sizes)):
                    at[d] = a + maps[a : a + n].argmax(axis=0)
                where.append(at)
        return np.concatenate(tops, axis=1), ids, where

    def projected(self, w: int, j: int) -> np.ndarray:
        if self._tables is None:
            return self.table @ self.kernels[w][j] / PARTS
        return self._tables[w, j]

    _tables = None

    def freeze(self) -> TextCNN:
        """Keep the embedding projected by each filter column: scoring is then look-ups and sums."""
        self._tables = {(w, j): np.ascontiguousarray(self.table @ self.kernels[w][j] / PARTS) for w in WIDTHS for j in range(w)}
        return self

    def text_logits(self, texts: list[bytes | None]) -> np.ndarray:
        """As ``logits`` of the hashed texts; each distinct word of a chunk is projected once."""
        out, rows = [], self.settings.rows
        for _, part in chunks(texts):
            words = Words(part, WORD_BYTES)
            coded = pa.array(words.hashes).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            first = np.empty(len(coded.dictionary), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            own = _rows(words, first, rows)
            own = np.concatenate((own, np.full((1, PARTS), rows, np.int32)))
            sizes = np.diff(words.cuts) + PAD
            starts = np.cumsum(sizes) - sizes
            ids = np.full(sizes.sum(), len(first), np.int32)
            gap = np.repeat(np.arange(len(part)) * PAD, np.diff(words.cuts))
            ids[np.arange(len(codes)) + gap] = codes
            tops = []
            for w in WIDTHS:
                maps = np.full((len(ids), self.settings.filters), -np.inf, np.float32)
                inner = maps[: len(ids) - w + 1]
                for j in range(w):
                    seen = self._tables[w, j][own].sum(axis=1)[ids[j : len(ids) - w + 1 + j]]
                    inner[:] = seen + self.bias[w] if j == 0 else inner + seen
                for k in range(1, w):
                    maps[starts + sizes - k] = -np.inf
                tops.append(np.maximum.reduceat(maps, starts))
            out.append(np.maximum(np.concatenate(tops, axis=1), 0) @ self.weights + self.constant)
        return np.concatenate(out) if out else np.empty(0)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        out = []
        group, size = [], 0
        for k, d in enumerate(docs):
            group.append(d)
            size += len(d)
            if size > 300_000 or k == len(docs) - 1:
                top, _, _ = self.pooled(group)
                out.append(np.maximum(top, 0) @ self.weights + self.constant)
                group, size = [], 0
        return np.concatenate(out) if out else np.empty(0)

    def train(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed + 1)
        self.start(docs, y)
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
        state: dict = {}
        step = 0

        def adam(name, value, grad, rows=None):
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            at = slice(None) if rows is None else rows
            m[at] = 0.9 * m[at] + 0.1 * grad
            v[at] = 0.99 * v[at] + 0.01 * grad**2
            value[at] -= s.rate * (m[at] / (1 - 0.9**step) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6) + s.decay * value[at])

        for _ in range(s.epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), s.batch):
                step += 1
                batch = order[at : at + s.batch]
                top, ids, where = self.pooled([docs[k] for k in batch], places=True)
                active = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ self.weights + self.constant, -30, 30)))
                err = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
                back = err[:, None] * self.weights * (top > 0)
                rows, grads = [], []
                kernel_grads = {}
                for n, w in enumerate(WIDTHS):
                    g = back[:, n * s.filters : (n + 1) * s.filters]
                    dk = np.zeros_like(self.kernels[w])
                    for j in range(w):
                        tok = ids[np.minimum(where[n] + j, len(ids) - 1)]
                        dk[j] = np.einsum("bfd,bf->df", self.table[tok].mean(axis=2), g)
                        rows.append(tok.ravel())
                        each = (g[:, :, None] * self.kernels[w][j].T[None] / PARTS).reshape(-1, 1, s.dim)
                        grads.append(np.broadcast_to(each, (len(each), PARTS, s.dim)).reshape(-1, s.dim))
                    kernel_grads[w] = (dk, g.sum(0))
                adam("weights", self.weights, active.T @ err)
                constant = np.array([self.constant], np.float32)
                adam("constant", constant, np.array([err.sum()]))
                self.constant = float(constant[0])
                for w, (dk, db) in kernel_grads.items():
                    adam(("k", w), self.kernels[w], dk)
                    adam(("b", w), self.bias[w], db)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                own, place = np.unique(rows, return_inverse=True)
                total = np.zeros((len(own), s.dim), np.float32)
                np.add.at(total, place, grads)
                keep = own < s.rows
                adam("table", self.table, total[keep], own[keep])

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
        self.threshold = best_threshold(logits, y)
        for lang in sorted(set(langs)):
            own = np.array([x == lang for x in langs])
            if own.sum() >= self.settings.least_for_threshold and 5 <= y[own].sum() < own.sum():
                self.thresholds[lang] = best_threshold(logits[own], y[own])

    def scores(self, texts: list[bytes | None], langs: list[str]) -> np.ndarray:
        cut = np.array([self.thresholds.get(x, self.threshold) for x in langs])
        return 1 / (1 + np.exp(-np.clip(self.text_logits(texts) - cut, -30, 30)))


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Midpoint of the widest gap among the cuts with the largest balanced accuracy; 0 if one class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    below = np.concatenate(([0], np.cumsum(1 - t))) / (len(t) - t.sum())
    above = 1 - np.concatenate(([0], np.cumsum(t))) / t.sum()
    quality = (below + above)[1:-1]
    gaps = np.diff(z)
    fit = np.flatnonzero((quality >= quality[gaps > 0].max() - 1e-12) & (gaps > 0)) if (gaps > 0).any() else []
    if not len(fit):
        return float(z.mean())
    k = fit[np.argmax(gaps[fit])]
    return float((z[k] + z[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, prototypes: dict, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = 2500, sample_mb: int = 64, longest: int = 2_000_000, settings: Settings | None = None) -> TextCNN | None:
    """A calibrated classifier from a sample of labelled documents; None without both classes.

    The sample holds about ``per_class`` documents of each class, fewer if their texts pass ``sample_mb`` together,
    none of more than ``longest`` characters. Its word rows, not its texts, come to the driver.
    """
    settings = settings or Settings()
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    sample = bounded_sample(known.distinct(), "id", "y", per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL").filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    rows = materialize(texts.join(F.broadcast(sample), "id").select("id", "y", "text").dropDuplicates(["id", "y"]))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_mb << 20:
        draw = F.pmod(F.xxhash64(F.lit("size"), F.col("id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
        rows = rows.filter(draw < (sample_mb << 20) / size)
    place = "<u2" if settings.rows < 1 << 16 else "<u4"
    model = docs.sparkSession.sparkContext.broadcast(prototypes)

    def prepare(batches):
        guess = Identifier(model.value)
        for b in batches:
            ids = hashed(b.column(2).cast(pa.binary()).to_pylist(), settings.rows)
            langs = [guess.language(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(place).tobytes() for x in ids]), pa.array(langs)], ["id", "y", "ids", "lang"])

    got = sorted(rows.mapInArrow(prepare, "id long, y int, ids binary, lang string").collect(), key=lambda r: (r[0], r[1]))
    y = np.array([r[1] for r in got], np.float32)
    if not 0 < y.sum() < len(y):
        return None
    ids, langs = [np.frombuffer(r[2], place).astype(np.int32).reshape(-1, PARTS) for r in got], [r[3] for r in got]
    held = np.arange(len(got)) % 4 == 3
    if not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
        held[:] = False
    net = TextCNN(settings)
    net.train([x for x, h in zip(ids, held) if not h], y[~held])
    use = held if held.any() else ~held
    net.calibrate(net.logits([x for x, h in zip(ids, use) if h]), y[use], [x for x, h in zip(langs, use) if h])
    return net.freeze()


def score(docs: DataFrame, net: TextCNN | None, prototypes: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (told from the text) and score (0 to 1) of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((net, prototypes))

    def run(batches):
        net, known = held.value
        guess = Identifier(known)
        for b in batches:
            langs = [guess.language(t) for t in b.column(1).to_pylist()]
            if net is None or not b.num_rows:
                out = np.zeros(b.num_rows)
            else:
                out = net.scores(b.column(1).cast(pa.binary()).to_pylist(), langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(out, pa.float64())], ["doc_id", "lang", "score"])

    return slim.mapInArrow(run, slim.select("doc_id").schema.add("lang", "string").add("score", "double"))
