"""Language identification with hyperdimensional profiles.

Each letter owns a random bipolar vector. A trigram vector binds (multiplies) the
vectors of its letters after rotating them by their place; a document vector
bundles (sums) the vectors of all its trigrams, and a language prototype bundles
the unit document vectors of its training documents. The prediction is the
prototype with the largest cosine.

Defined cases: null texts and texts without a letter give ``und`` and score 0;
with nothing learned every document gives ``und``; ties go to the language that
sorts first; very long texts are counted whole, in slices of ``CHUNK`` characters;
repeated rows are answered each by itself and learned from each; an empty table gives
no rows; ``identify`` returns no other columns but those asked for by ``more``, and
``keep_identified`` carries all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

UNKNOWN = "und"
LETTERS = 128
CHUNK = 2_000_000
#: Trigram vectors that are kept, and that are bound and added at a time.
KEPT, BLOCK = 65_536, 4096
#: Random letters have cosines of 0.03 to 0.10 with the nearest of four prototypes, 0.12 in one of a hundred; of 10,000 documents with
#: FEW trigrams or more none has under 0.128.
LEAST, FEW = 0.12, 24

_codes: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """Code of each code point: 0 is no letter, 1 to 26 are a to z, the others share the rest by residue."""
    global _codes
    if _codes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        for cp in range(128, 0x110000):
            if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
                table[cp] = 27 + cp % (LETTERS - 27)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        table[ord("A") : ord("Z") + 1] = np.arange(1, 27)
        _codes = table
    return _codes


class TrigramSpace:
    """Trigram vectors, bound when they are met; those met first are kept, the others of a text are bound block by block."""

    def __init__(self, dim: int = 1024, seed: int = 7):
        self.dim = dim
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dim))
        self.row = np.full(LETTERS**3, -1, np.int32)
        self.vectors = np.empty((0, dim), np.int8)
        self.size = 0

    def bound(self, trigrams: np.ndarray) -> np.ndarray:
        a, b, c = trigrams // LETTERS**2, trigrams // LETTERS % LETTERS, trigrams % LETTERS
        return np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]

    def keep(self, trigrams: np.ndarray) -> None:
        """Keeps the vectors of different trigrams, while there is room."""
        new = trigrams[self.row[trigrams] < 0][: KEPT - self.size]
        if len(new):
            if self.size + len(new) > len(self.vectors):
                grown = np.empty((min(KEPT, max(4096, 2 * len(self.vectors), self.size + len(new))), self.dim), np.int8)
                grown[: self.size] = self.vectors[: self.size]
                self.vectors = grown
            self.vectors[self.size : self.size + len(new)] = self.bound(new)
            self.row[new] = np.arange(self.size, self.size + len(new))
            self.size += len(new)

    def blocks(self, trigrams: np.ndarray):
        """(slice, vectors) over blocks of different trigrams."""
        self.keep(trigrams)
        for at in range(0, len(trigrams), BLOCK):
            part = trigrams[at : at + BLOCK]
            rows = self.row[part]
            yield slice(at, at + BLOCK), self.vectors[rows] if (rows >= 0).all() else self.bound(part)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The different trigrams of a whole text and their counts: runs of other characters count as one, so do the text's ends.

        Long texts are read in slices that hand their last two letters on.
        """
        codes, carry, total, found = letter_codes(), np.zeros(1, np.uint8), None, []
        text = text or ""
        for at in range(0, len(text), CHUNK):
            part = codes[np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            last = [np.zeros(1, np.uint8)] if at + CHUNK >= len(text) else []
            c = np.concatenate((carry, part, *last))
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
            c = c[keep]
            carry, c = c[-2:], c.astype(np.int32)
            if len(c) >= 3:
                found = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
                if len(text) > CHUNK:
                    total = np.bincount(found, minlength=LETTERS**3) + (0 if total is None else total)
        if total is None:
            return np.unique(np.asarray(found, np.int64), return_counts=True)
        seen = np.flatnonzero(total)
        return seen, total[seen]

    def document(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a whole text; None if it has no letter."""
        trigrams, counts = self.counts(text)
        if not len(trigrams):
            return None
        total = np.zeros(self.dim, np.float32)
        for part, vectors in self.blocks(trigrams):
            total += counts[part].astype(np.float32) @ vectors.astype(np.float32)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total


def fit_prototypes(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    docs_per_language: int = 1500, dim: int = 1024,
) -> dict[str, np.ndarray]:
    """Language prototypes from about ``docs_per_language`` labelled documents of each language.

    The driver receives one vector per language and task of a sample of bounded size.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = bounded_sample(rows, "id", "lang", docs_per_language).select("lang", "text")

    def bundle(batches):
        space, sums = TrigramSpace(dim), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (v := space.document(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.astype("<f4").tobytes() for v in sums.values()])], ["lang", "v"]
            )

    out: dict[str, np.ndarray] = {}
    # Every task of the scan takes its part of the sample; only the sample is dealt to a few tasks.
    for lang, v in sample.repartition(8).mapInArrow(bundle, "lang string, v binary").collect():
        out[lang] = out.get(lang, 0) + np.frombuffer(v, "<f4").astype(np.float64)
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}


class Identifier:
    """Predicts (language, cosine clipped to 0..1) of one text."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = sorted(prototypes)
        self.matrix = np.stack([prototypes[k] for k in self.names]).astype(np.float32) if self.names else None
        self.space = TrigramSpace(self.matrix.shape[1]) if self.names else None
        self.dots = np.zeros((0, len(self.names)), np.float32)

    def language(self, text: str | None) -> str:
        """The prediction alone: trigrams are compared with the prototypes once while they are kept, not each text."""
        trigrams, counts = self.space.counts(text) if self.space else ((), ())
        if not len(trigrams):
            return UNKNOWN
        space = self.space
        space.keep(trigrams)
        if len(self.dots) < space.size:
            self.dots = np.concatenate((self.dots, *[space.vectors[at : min(at + BLOCK, space.size)] @ self.matrix.T for at in range(len(self.dots), space.size, BLOCK)]))
        rows = space.row[trigrams]
        own = counts[rows >= 0].astype(np.float32) @ self.dots[rows[rows >= 0]]
        rest, times = trigrams[rows < 0], counts[rows < 0].astype(np.float32)
        for at in range(0, len(rest), BLOCK):
            own += times[at : at + BLOCK] @ (space.bound(rest[at : at + BLOCK]) @ self.matrix.T)
        return self.names[int(own.argmax())]

    def __call__(self, text: str | None) -> tuple[str, float]:
        v = self.space.document(text) if self.space else None
        if v is None:
            return UNKNOWN, 0.0
        cos = self.matrix @ v
        best = int(cos.argmax())
        return self.names[best], float(min(1.0, max(0.0, cos[best])))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, lang_pred, score for each row; ``more`` columns are carried along."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    schema = slim.select("doc_id", *slim.columns[2:]).schema.add("lang_pred", "string").add("score", "double")
    model = slim.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches):
        guess = Identifier(model.value)
        for b in batches:
            said = [guess(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), *b.columns[2:], pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return slim.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = LEAST, few: int = FEW) -> DataFrame:
    """Documents whose language is told; those without letters or unlike every prototype go. All columns stay.

    ``least`` is the cosine that a text needs if it has ``few`` trigrams or more; shorter ones show too little to be refused.
    """
    at = docs.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches):
        guess = Identifier(model.value)

        def stays(text: str | None) -> bool:
            lang, score = guess(text)
            return lang != UNKNOWN and (score >= least or guess.space.counts(text)[1].sum() < few)

        for b in batches:
            yield b.filter(pa.array([stays(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
