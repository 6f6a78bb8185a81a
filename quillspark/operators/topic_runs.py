"""Terms of topics over runs of texts: terms move as 64-bit keys, once a run and topic, to the bucket of the key, where all counts of a term are together.

Counts, products of topics and weights of terms are told bucket by bucket; texts get counts of their terms back in the order in which their run sent them. Names are
looked up for the terms that a result shows. Two terms of equal keys would be counted together, as in ``pairs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.files import materialize
from . import pairs as pr

#: Words of a run: a text's words and pairs take twice the memory of its steps.
RUN_WORDS = 500_000
#: Buckets for one of ``pairs``: all that is known of a bucket's terms is made at once.
SHARE = 4
_SENT = "bucket int, run bigint, keys binary, topics binary, n binary"


class _Terms:
    """Of one run: its different terms (words, then pairs of neighbouring words), and, once counted, for each topic's terms, by key and topic, their numbers."""

    def __init__(self, run: pr._Run):
        self.run, self.topics = run, run.keys.values.field("topic").to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = pr._mixed(run.hashes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.text = np.repeat(np.arange(len(run.sizes), dtype=np.int32), run.sizes)
        same = self.text[1:] == self.text[:-1]
        known = max(1, len(self.words))
        pair, self.at = np.unique((run.codes[:-1] * known + run.codes[1:])[same], return_inverse=True)
        self.first, self.second = np.divmod(pair, known)
        pairs = pr._mixed(self.words[self.first] * np.uint64(3) + pr._mixed(self.words[self.second] ^ np.uint64(0xD6E8FEB86659FD93)))
        self.keys = np.concatenate((self.words, pairs))
        self.wide, self.same = int(self.topics.max(initial=0)) + 1, same

    def count(self) -> _Terms:
        # Terms by their keys, so that equal texts of different runs are summed in one order.
        order = np.argsort(self.keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.place = np.concatenate((place[self.run.codes], place[len(self.words) + self.at]))
        self.text = np.concatenate((self.text, self.text[1:][self.same]))
        del self.at, self.same
        self.entry, self.n = np.unique(self.place.astype(np.int64) * self.wide + self.topics[self.text], return_counts=True)
        at, self.entry_topic = np.divmod(self.entry, self.wide)
        self.entry_key = self.keys[order][at]
        return self

    def names(self, keys: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Those of the keys, ascending, that the run has, and their terms."""
        found = np.flatnonzero(np.isin(self.keys, keys))
        name = lambda k: self.run.names[int(k)].as_py()
        n = len(self.words)
        return self.keys[found], [name(k) if k < n else f"{name(self.first[k - n])} {name(self.second[k - n])}" for k in found]


class _Bucket:
    """One row of ``term_buckets``: counts of each term and topic, topics renamed by ``into``."""

    def __init__(self, row: pa.RecordBatch, into: dict | None = None):
        self.number, self.runs = row.column("bucket")[0].as_py(), row.column("runs")[0].as_py()
        keys, topics, n = [[f(x) for x in row.column(c)[0].as_py()] for c, f in (("keys", pr._unpacked), ("topics", pr._unplaned), ("n", pr._unplaned))]
        self.ends = np.cumsum([len(k) for k in keys])
        topic = np.concatenate(topics).astype(np.int64)
        if into:
            renamed = np.zeros(max(into) + 1, np.int64)
            renamed[list(into)] = list(into.values())
            topic = renamed[topic]
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        wide = int(topic.max(initial=0)) + 1
        entry, self.at = np.unique(place * wide + topic, return_inverse=True)
        self.c = np.bincount(self.at, np.concatenate(n).astype(float)).astype(np.int64)
        self.term, self.topic = np.divmod(entry, wide)
        self.f, self.df = np.bincount(self.term, self.c).astype(np.int64)[self.term], np.bincount(self.term)[self.term]

    def weights(self, sizes: dict, mean: float, min_df: int) -> np.ndarray:
        size = np.array([sizes.get(t, 1) for t in range(int(self.topic.max(initial=0)) + 1)], float)
        return np.where(self.df >= min_df, self.c / size[self.topic] * np.log(1 + mean / self.f), 0.0)


def topic_runs(df: DataFrame, words: Column, key: str, topic: str) -> DataFrame:
    """Runs of texts, as ``pairs`` has them, each text's key with its topic."""
    own = F.struct(F.col(key).alias("key"), F.col(topic).cast("int").alias("topic"))
    return pr._in_runs(df.select(own.alias("own"), words.alias("words")), F.col("words"), "own", True, min(RUN_WORDS, pr.RUN_WORDS))


def term_buckets(runs: DataFrame) -> DataFrame:
    """(bucket, c, runs, keys, topics, n), written, a row for each bucket: what every run sent of its terms; ``c`` is the sum of the numbers."""
    bits = pr._buckets(2 * SHARE * runs.select("sizes").mapInArrow(pr._total, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def send(run: pr._Run) -> pa.RecordBatch:
        t = _Terms(run).count()
        rows = [(k, run.name, pr._packed(t.entry_key[a:b]), pr._planed(t.entry_topic[a:b]), pr._planed(t.n[a:b])) for k, a, b in pr._parts(t.entry_key, bits)]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["bucket", "run", "keys", "topics", "n"])

    def gather(bucket: pa.Table) -> pa.Table:
        n = bucket.column("n").to_pylist()
        told = {"bucket": bucket.column("bucket")[:1], "c": [sum(int(pr._unplaned(x).sum()) for x in n)], "runs": [bucket.column("run").to_pylist()]}
        return pa.table(told | {c: pa.array([bucket.column(c).to_pylist()], pa.list_(pa.binary())) for c in ("keys", "topics", "n")})

    sent = runs.mapInArrow(pr._each_run(send), _SENT)
    return materialize(sent.groupBy("bucket").applyInArrow(gather, "bucket int, c bigint, runs array<bigint>, keys array<binary>, topics array<binary>, n array<binary>"))


def _each_bucket(buckets: DataFrame, make: Callable[[_Bucket], dict], schema: str, into: dict | None = None) -> DataFrame:
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                told = make(_Bucket(b.slice(i, 1), into))
                yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) for f in kinds], schema=kinds)

    return buckets.mapInArrow(run, schema)


def shared_mass(buckets: DataFrame) -> DataFrame:
    """``topics.shared_mass`` of the buckets' terms, written."""

    def mass(b: _Bucket) -> dict:
        most, (f, at) = int(b.topic.max(initial=0)) + 1, np.unique(b.f, return_inverse=True)
        found = []
        for d in range(most):
            i = np.flatnonzero(b.term[d:] == b.term[: len(b.term) - d])
            if not len(i):
                break
            found.append(((b.topic[i] * most + b.topic[i + d]) * len(f) + at[i], b.c[i].astype(float) * b.c[i + d]))
        key, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        pair, at = np.divmod(key, len(f))
        return {"x": pair // most, "y": pair % most, "f": f[at], "mass": np.bincount(place, np.concatenate([m for _, m in found]))}

    return materialize(_each_bucket(buckets, mass, "x int, y int, f bigint, mass double").groupBy("x", "y", "f").agg(F.sum("mass").alias("mass")))


def topic_sizes(buckets: DataFrame, into: dict, min_df: int) -> dict:
    """How many terms each united topic has of those that ``min_df`` topics have."""

    def size(b: _Bucket) -> dict:
        n = np.bincount(b.topic, b.c * (b.df >= min_df)).astype(np.int64)
        return {"topic": np.flatnonzero(n), "n": n[n > 0]}

    return {r[0]: r[1] for r in _each_bucket(buckets, size, "topic int, n bigint", into).groupBy("topic").agg(F.sum("n")).collect()}


def leading_weights(runs: DataFrame, buckets: DataFrame, into: dict, sizes: dict, min_df: int, top: int) -> tuple[DataFrame, dict]:
    """(topic, term, weight) of the terms that are among the ``top`` of a topic, or as heavy as the last of them, in all topics; and the norm of each topic's weights."""
    mean = sum(sizes.values()) / max(1, len(sizes))

    def lead(b: _Bucket) -> dict:
        w, rows = b.weights(sizes, mean, min_df), []
        for t in np.unique(b.topic[w > 0]):
            own = np.flatnonzero((b.topic == t) & (w > 0))
            least = np.partition(w[own], -top)[-top] if len(own) > top else 0
            rows += [(t, b.keys[b.term[i]].astype(np.int64), w[i], None) for i in own[w[own] >= least]] + [(t, None, None, float((w[own] ** 2).sum()))]
        columns = list(zip(*rows)) or [()] * 4
        return dict(zip(("topic", "key", "weight", "square"), columns))

    told = materialize(_each_bucket(buckets, lead, "topic int, key bigint, weight double, square double", into))
    norms = {r[0]: r[1] ** 0.5 for r in told.groupBy("topic").agg(F.sum("square")).collect()}
    ranked = told.filter("key IS NOT NULL").withColumn("rank", F.rank().over(Window.partitionBy("topic").orderBy(F.col("weight").desc()))).filter(F.col("rank") <= top)
    keys = np.unique(np.array([r[0] for r in ranked.select("key").distinct().collect()], np.int64).view(np.uint64))

    def across(b: _Bucket) -> dict:
        w = b.weights(sizes, mean, min_df)
        i = np.flatnonzero((w > 0) & np.isin(b.keys, keys)[b.term])
        return {"topic": b.topic[i], "key": b.keys[b.term[i]].view(np.int64), "weight": w[i]}

    def name(run: pr._Run) -> pa.RecordBatch:
        found, terms = _Terms(run).names(keys)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(terms, pa.string())], ["key", "term"])

    names = runs.mapInArrow(pr._each_run(name), "key bigint, term string").groupBy("key").agg(F.first("term").alias("term"))
    weights = _each_bucket(buckets, across, "topic int, key bigint, weight double", into)
    return materialize(weights.join(names, "key").select("topic", "term", "weight")), norms


def scored_texts(runs: DataFrame, buckets: DataFrame, into: dict, sizes: dict, norms: dict, min_df: int, key: str) -> DataFrame:
    """(topic, key, similarity), written: of every text with words how near its terms, weighted as its topic's, are to the topic; null if none has a weight."""
    mean = sum(sizes.values()) / max(1, len(sizes))

    def reply(b: _Bucket) -> dict:
        kept = b.df >= min_df
        c, f = (np.where(kept, x, 0)[b.at] for x in (b.c, b.f))
        parts = list(zip(np.concatenate(([0], b.ends[:-1])), b.ends))
        return {"run": b.runs, "bucket": [b.number] * len(parts), "c": [pr._planed(c[a:e]) for a, e in parts], "f": [pr._planed(f[a:e]) for a, e in parts]}

    def score(run: pa.Table, told: pa.Table) -> pa.Table:
        t, told = _Terms(pr._Run(run)).count(), told.sort_by("bucket")
        c, f = (np.concatenate([np.zeros(0), *[pr._unplaned(x) for x in told.column(x).to_pylist()]]) for x in "cf")
        topic = np.array([into.get(k, 0) for k in range(t.wide)], np.int64)
        size = np.array([sizes.get(k, 1) for k in range(int(topic.max(initial=0)) + 1)], float)
        weight = np.where(c > 0, c / size[topic[t.entry_topic]] * np.log(1 + mean / np.maximum(f, 1)), 0.0)
        own, n = np.unique(t.text.astype(np.int64) * max(1, len(t.keys)) + t.place, return_counts=True)
        text, place = np.divmod(own, max(1, len(t.keys)))
        w = weight[np.searchsorted(t.entry, place * t.wide + t.topics[text])]
        each = len(t.topics)
        dot, square = np.bincount(text, n * w * w, each), np.bincount(text, (n * w) ** 2, each)
        here = np.flatnonzero(t.run.sizes > 0)
        norm = np.array([norms.get(k, 0.0) for k in range(len(size))])
        long = np.sqrt(square) * norm[topic[t.topics]]
        similarity = np.divide(dot, long, out=np.full(each, np.nan), where=long > 0)[here]
        keys = t.run.keys.values.field("key").take(pa.array(here))
        return pa.table({"topic": pa.array(topic[t.topics][here], pa.int32()), "key": keys, "similarity": pa.array(similarity, from_pandas=True)})

    told = _each_bucket(buckets, reply, "run bigint, bucket int, c binary, f binary", into)
    kind = runs.schema["keys"].dataType.elementType["key"].dataType.simpleString()
    return materialize(runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(score, f"topic int, key {kind}, similarity double").withColumnRenamed("key", key))
