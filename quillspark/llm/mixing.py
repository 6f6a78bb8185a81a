"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled documents gives every document a posterior over
domains (the classes of the label table). Nonnegative document rates are then
sought whose expected domain token totals, sum of rate x tokens x posterior,
match the targets: least squares by projected gradient. A step needs only the
domain totals of the present rates, so each iteration is one aggregation over
(tokens, posteriors) and the rates themselves are an expression over the steps
so far; nothing of a document's size leaves its row.

What is made small is the plain sum of squared misses. Rates are weighted by their tokens, so a
gradient step over the largest eigenvalue of the domains' token Gram matrix is safe; steps scaled by
the Gram matrix of the documents still above zero are tried beside it and make the descent fast.

Features are made once: documents with tokens and posteriors are written to the shared
folder, and both the fit and the result read them there.

Defined cases: null and empty texts have no tokens, no part in the totals and keep
rate 1; without labels of two classes there is one domain and all rates are 1;
targets of domains that the classes lack are left out, the rest is scaled to sum
to one; targets out of reach are approached as far as nonnegative rates can, and the
report tells by how much; labels of one document that disagree count each, repeated
ones once; repeated rows each get their rate; an empty table gives no rows; very long
texts are read whole; other columns pass through, and one named like an added column
(n_tokens, posteriors, rate, copies, in any letter case) is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, free_names, materialize
from .fm_index import WORD_BYTES
from .words import Words, chunks

HASHED = 2048
ADDED = ("n_tokens", "posteriors", "rate", "copies")
#: Texts of more characters are not learned from.
LONGEST = 5_000_000
FEATURES = HASHED + 128 + 1


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token counts, feature rows): hashed word shares, shares of ASCII characters, a constant."""
    sizes, rows = [], []
    for _, part in chunks(texts):
        words = Words(part, WORD_BYTES)
        ids = (words.hashes % np.uint64(HASHED)).astype(np.int64)
        for text, a, b in zip(part, words.cuts[:-1], words.cuts[1:]):
            x = np.zeros(FEATURES, np.float32)
            x[:HASHED] = np.sqrt(np.bincount(ids[a:b], minlength=HASHED) / max(1, b - a))
            raw = np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)[:128]
            x[HASHED:-1] = np.sqrt(raw / max(1, len(text or b"")))
            x[-1] = 1
            sizes.append(b - a)
            rows.append(x)
    return np.array(sizes, np.int64), np.stack(rows) if rows else np.empty((0, FEATURES), np.float32)


@dataclass
class Domains:
    """Softmax regression over feature rows; ``offset`` sets the sample's class shares back to those of all labels."""

    names: list[str]
    weights: np.ndarray | None
    offset: np.ndarray | float = 0.0

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones((len(rows), len(self.names)))
        z = rows @ self.weights + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None,
                per_class: int = 1000, epochs: int = 150) -> Domains:
    """The classifier of about ``per_class`` labelled documents of each domain, of ``LONGEST`` characters at most; default domains are quality x toxic."""
    if domain is None:
        domain = F.concat(F.lit("quality"), F.col("quality"), F.lit("_toxic"), F.col("toxic"))
    known = labels.select(F.col(id_col).alias("id"), domain.cast("string").alias("domain")).filter("id IS NOT NULL AND domain IS NOT NULL").distinct()
    sample = bounded_sample(known, "id", "domain", per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= LONGEST)
    rows = rows.join(F.broadcast(sample), "id").dropDuplicates(["id", "domain"])

    def prepare(batches):
        for b in batches:
            _, x = features(b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["id", "domain", "x"])

    got = sorted(rows.select("id", "domain", "text").mapInArrow(prepare, "id long, domain string, x binary").collect(), key=lambda r: (r[0], r[1]))
    names = sorted({r[1] for r in got})
    if len(names) < 2:
        return Domains(names or ["all"], None)
    x = np.stack([np.frombuffer(r[2], "<f2") for r in got]).astype(np.float32)
    y = np.eye(len(names), dtype=np.float32)[[names.index(r[1]) for r in got]]
    counts = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    offset = np.log([counts[n] for n in names]) - np.log(y.sum(axis=0))
    w, m, v = (np.zeros((FEATURES, len(names)), np.float32) for _ in range(3))
    for step in range(1, epochs + 1):
        p = Domains(names, w).posteriors(x)
        g = x.T @ (p - y) / len(x) + 1e-4 * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Domains(names, w.astype(np.float32), (offset - offset.max()).astype(np.float32))


def membership(docs: DataFrame, model: Domains, text_col: str = "text", tokens: str = "__tokens", shares: str = "__p") -> DataFrame:
    """The documents with columns for the number of tokens and the posteriors appended."""
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField(tokens, T.LongType()), T.StructField(shares, T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        for b in batches:
            sizes, x = features(b.column(at).cast(pa.binary()).to_pylist())
            p = held.value.posteriors(x).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(list(p), pa.list_(pa.float64()))], schema.names)

    return docs.mapInArrow(run, schema)


def _move(w: np.ndarray, shares: str = "__p") -> Column:
    return sum((F.col(shares)[k] * F.lit(float(x)) for k, x in enumerate(w)), F.lit(0.0))


def _rate(steps: list[np.ndarray], shares: str = "__p") -> Column:
    """The rate after the steps so far: each is a posterior-weighted move, cut off at zero."""
    rate = F.lit(1.0)
    for w in steps:
        rate = F.greatest(F.lit(0.0), rate + _move(w, shares))
    return rate


def fit_rates(soft: DataFrame, names: list[str], targets: dict[str, float], iterations: int = 15, tolerance: float = 1e-6):
    """(steps, report): the steps that make up the rates, and target and reached totals of each domain.

    Every iteration tries, in one aggregation, the plain scaled gradient and shorter and shorter steps
    scaled by the Gram matrix of the rates above zero; the one that misses least is taken, so the miss never grows.
    """
    k = len(names)
    wanted = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(steps: list[np.ndarray], tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Domain totals, and the Gram matrix of positive rates, after each of the moves tried."""
        rated = soft.select("__tokens", "__p", _rate(steps).alias("__r"))
        moves = [F.greatest(F.lit(0.0), F.col("__r") + _move(w)).alias(f"r{c}") for c, w in enumerate(tried)]
        weigh = rated.select("__tokens", "__p", *moves)
        sums, p = [], F.col("__p")
        for c in range(len(tried)):
            r = F.col(f"r{c}")
            sums += [F.sum(r * F.col("__tokens") * p[i]).alias(f"s{c}_{i}") for i in range(k)]
            sums += [F.sum(F.when(r > 0, F.col("__tokens") * p[i] * p[j]).otherwise(0.0)).alias(f"g{c}_{i}_{j}") for i, j in upper]
        row = weigh.agg(*sums).first()
        out = []
        for c in range(len(tried)):
            gram = np.zeros((k, k))
            for i, j in upper:
                gram[i, j] = gram[j, i] = row[f"g{c}_{i}_{j}"] or 0.0
            out.append((np.array([row[f"s{c}_{i}"] or 0.0 for i in range(k)]), gram))
        return out

    reached, gram = totals([], [np.zeros(k)])[0]
    total = reached.sum()
    if not total or not wanted.sum() or k < 2:
        return [], {n: (float(x), float(x)) for n, x in zip(names, reached)}
    goal = wanted / wanted.sum() * total
    safe = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-9)
    cost = lambda x: float((x - goal) @ (x - goal))
    steps: list[np.ndarray] = []
    for _ in range(iterations):
        if np.abs(reached - goal).sum() < tolerance * total:
            break
        sharp = -np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (reached - goal)
        tried = [sharp, sharp / 2, sharp / 4, -safe * (reached - goal)]
        found = totals(steps, tried)
        best = min(range(len(tried)), key=lambda c: cost(found[c][0]))
        if cost(found[best][0]) >= cost(reached) * (1 - 1e-9):
            break
        steps.append(tried[best])
        reached, gram = found[best]
    return steps, {n: (float(g), float(r)) for n, g, r in zip(names, goal, reached)}


def mix_with_report(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, keep_text: bool = True
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """All documents with n_tokens, posteriors (domain -> share), rate and copies; and the target and reached tokens of each domain.

    ``copies`` is the rate rounded up or down by a hash of the id, so that its expectation is the rate.
    """
    if clash := [c for c in docs.columns if c.lower() in ADDED]:
        raise ValueError(f"columns {clash} have the names of columns that this operator adds")
    model = fit_domains(docs, labels, id_col, text_col, domain)
    tokens, shares = free_names(docs, "tokens", "shares")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    soft = materialize(membership(docs, model, text_col, tokens, shares).select(*[F.col(f"`{c}`") for c in [*kept, tokens, shares]]))
    steps, report = fit_rates(soft.select(F.col(tokens).alias("__tokens"), F.col(shares).alias("__p")).filter("__tokens > 0"), model.names, targets)
    draw = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.when(F.col(tokens) == 0, 1.0).otherwise(_rate(steps, shares))
    names = F.array(*[F.lit(n) for n in model.names])
    out = soft.select(
        *[F.col(f"`{c}`") for c in kept], F.col(tokens).alias("n_tokens"), F.map_from_arrays(names, F.col(shares)).alias("posteriors"), rate.alias("rate"), draw.alias("copies")
    )
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("copies")).cast("long")), report


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *more, **options) -> DataFrame:
    """The documents of ``mix_with_report``."""
    return mix_with_report(docs, labels, targets, *more, **options)[0]
