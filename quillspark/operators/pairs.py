"""Counts of pairs of neighbouring words, made in runs of texts, so that what many texts of a run share moves once.

``pair_counts`` returns the words. ``own_delta_pmi`` and ``own_surprisal`` meet every pair of every text with its count in all texts: a run sends each of
its different pairs once, as a 64-bit key, to the bucket of the key, and gets the counts back in the same order. Two pairs of equal keys would be
counted together; among a thousand million different pairs there is one such in forty cases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize

#: Words of a run, keys of a bucket, rows that leave a task at once.
RUN_WORDS, BUCKET_KEYS, ROWS = 1_000_000, 4_000_000, 200_000


def _neighbours(code: np.ndarray, text: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (lower code x size + higher code) of words at most ``width`` places apart in one text, and their numbers."""
    found = []
    for d in range(1, width + 1):
        a, b = code[:-d], code[d:]
        same = text[:-d] == text[d:]
        found.append((np.minimum(a, b) * size + np.maximum(a, b))[same])
    return np.unique(np.concatenate(found), return_counts=True)


def pair_counts(df: DataFrame, tokens: Column, width: int = 5) -> DataFrame:
    """(w1, w2, n): ordered pairs of words at most ``width`` places apart, without a place with itself."""

    def count(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for run in chunks(batches, RUN_WORDS):
            run = [x.column(0) for x in run]
            words = pa.concat_arrays([x.flatten() for x in run]).dictionary_encode()
            if not len(words):
                continue
            names = words.dictionary
            order = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in run])
            key, n = _neighbours(rank[words.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes), len(names), width)
            names = names.take(pa.array(order))
            for at in range(0, len(key), ROWS):
                a, b = np.divmod(key[at : at + ROWS], len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n[at : at + ROWS])], ["a", "b", "n"])

    each = df.select(tokens.alias("t")).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # A pair of different words stands in both orders; a word beside itself counts from either place.
    pair = lambda x, y, n: F.struct(F.col(x).alias("w1"), F.col(y).alias("w2"), n.alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(pair("a", "b", F.col("n") * 2))).otherwise(F.array(pair("a", "b", F.col("n")), pair("b", "a", F.col("n"))))
    return each.select(F.explode(both).alias("p")).select("p.w1", "p.w2", "p.n")


def chunks(batches: Iterator, most: int) -> Iterator[list]:
    """Lists of slices of the batches whose first columns hold about ``most`` words together."""
    held, n = [], 0
    for b in batches:
        column = b.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        start, before = 0, 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(ends, before + most - n, side="right")))
            held.append(b.slice(start, stop - start))
            n, start, before = n + int(ends[stop - 1]) - before, stop, int(ends[stop - 1])
            if n >= most or start < len(column):
                yield held
                held, n = [], 0
    if held:
        yield held


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well spread number for each number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Text:
    """Of one text, given by its words' hashes: the different words and pairs, their keys and numbers."""

    def __init__(self, w: np.ndarray, width: int):
        self.size = len(w)
        known, code, self.own = np.unique(w, return_inverse=True, return_counts=True)
        pair, self.n = _neighbours(code.reshape(-1), np.zeros(len(w), np.int8), len(known), width)
        self.low, self.high = np.divmod(pair, len(known))
        words = _mixed(known.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        pairs = _mixed(words[self.low] * np.uint64(3) + _mixed(words[self.high] ^ np.uint64(0xD6E8FEB86659FD93)))
        self.keys, self.counts = np.concatenate((words, pairs)), np.concatenate((self.own, self.n))

    def score(self, among: np.ndarray, total: float, alpha: float) -> float | None:
        """Mean over the ordered pairs; ``among`` has the counts of the keys in all texts."""
        if not len(self.n):
            return None
        b, own, size = among[: len(self.own)], self.own, float(self.size)
        self_pair = self.low == self.high
        twice = np.where(self_pair, 2.0, 1.0)
        here = np.log2(self.n * twice / size / (own[self.low] / size * (own[self.high] / size)))
        there = np.log2((among[len(self.own) :] * twice + alpha) / (total + alpha) / (b[self.low] / total * (b[self.high] / total)))
        weight = 3 - twice
        return float(((here - there) * weight).sum() / weight.sum())


class _Steps:
    """Of one text, given by its words' hashes: the different steps from a word to the next and the words that they leave, their keys and numbers."""

    def __init__(self, w: np.ndarray):
        known, code = np.unique(w, return_inverse=True)
        code = code.reshape(-1)
        left, self.at_left, n_left = np.unique(code[:-1], return_inverse=True, return_counts=True)
        step, self.at_step, n_step = np.unique(code[:-1] * max(1, len(known)) + code[1:], return_inverse=True, return_counts=True)
        a, b = np.divmod(step, max(1, len(known)))
        words = _mixed(known.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        steps = _mixed(words[a] * np.uint64(3) + _mixed(words[b] ^ np.uint64(0xD6E8FEB86659FD93)))
        self.n_left = len(left)
        self.keys, self.counts = np.concatenate((words[left], steps)), np.concatenate((n_left, n_step))

    def score(self, among: np.ndarray, distinct: int, alpha: float) -> np.ndarray:
        """Nats of each step."""
        c1, c = among[: self.n_left].astype(float)[self.at_left], among[self.n_left :][self.at_step]
        return -np.log((c + alpha) / (c1 + alpha * distinct))


class _Run:
    """One row of ``_in_runs``: the keys of its texts, the words' names or hashes, and each text's hashes."""

    def __init__(self, row: pa.Table | pa.RecordBatch):
        self.keys, self.name = row.column("keys")[0], row.column("run")[0].as_py()
        self.sizes = np.frombuffer(row.column("sizes")[0].as_py(), "<u4").astype(np.int64)
        self.codes = _unplaned(pa.decompress(row.column("codes")[0].as_py(), row.column("size")[0].as_py(), "zstd", asbytes=True)).astype(np.int64)
        names = row.column("names")[0]
        self.names = names.values if names.is_valid else None
        self.hashes = np.frombuffer(row.column("hashes")[0].as_py(), "<i8") if self.names is None else _hashes(self.names)

    def texts(self, make: Callable) -> list:
        flat, ends = self.hashes[self.codes], np.cumsum(self.sizes)
        return [make(flat[e - n : e]) for n, e in zip(self.sizes, ends)]

    def words(self) -> pa.ListArray:
        """The words of each text."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.sizes))), pa.int32()), self.names.take(pa.array(self.codes)))


def _hashes(names: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in names.to_pylist()], np.int64)


def _run_keys(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The run's different keys, ascending, and of every key of every text its place among them."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[t.keys for t in texts]]), return_inverse=True)


def _planed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, all first bytes, then all second ones and so on, so that rarely used bytes compress away; the first byte tells how many."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, -1, 1) if len(data) > 1 else np.zeros(0, np.uint8)
    planes = planes.reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, and the steps to the others."""
    return keys[:1].astype("<u8").tobytes() + _planed(np.diff(keys))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1), _unplaned(data[8:]))), dtype=np.uint64)


def _in_runs(df: DataFrame, tokens: Column, key: str, named: bool, most: int | None = None) -> DataFrame:
    """Runs of texts of about ``most`` (``RUN_WORDS``) words, a row each, written: the texts' keys and sizes, and their words as numbers into the run's different words,
    of which the names are kept if ``named``, else their hashes."""
    slim, most = df.select(F.coalesce(tokens, F.array().cast("array<string>")).alias("t"), F.col(key).alias("key")), most or RUN_WORDS

    def pack(batches: Iterator) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 24
        for n, run in enumerate(chunks(batches, most)):
            words = pa.concat_arrays([x.column(0).flatten() for x in run]).dictionary_encode()
            at = words.indices.to_numpy()
            order = np.argsort(-np.bincount(at, minlength=len(words.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes, names = _planed(rank[at]), words.dictionary.take(pa.array(order))
            sizes = np.concatenate([pc.list_value_length(x.column(0)).to_numpy(zero_copy_only=False) for x in run]).astype("<u4")
            keys = pa.concat_arrays([x.column(1) for x in run])
            told = {
                "run": pa.array([name + n], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                "codes": pa.array([pa.compress(codes, "zstd", asbytes=True)], pa.binary()), "size": pa.array([len(codes)], pa.int64()),
                "names": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names) if named else pa.nulls(1, pa.list_(pa.string())),
                "hashes": pa.nulls(1, pa.binary()) if named else pa.array([_hashes(names).astype("<i8").tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(told)

    # Written once: a second evaluation could put texts into other runs.
    return materialize(slim.mapInArrow(pack, f"run bigint, keys array<{slim.schema['key'].dataType.simpleString()}>, sizes binary, codes binary, size bigint, names array<string>, hashes binary"))


def _each_run(make: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives each run to ``make``."""

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield make(_Run(b.slice(i, 1)))

    return run


def _parts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of ascending keys by their leading bits."""
    at = np.concatenate(([0], np.flatnonzero(np.diff(keys >> np.uint64(64 - bits))) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    return [(int(keys[a] >> np.uint64(64 - bits)), a, b) for a, b in zip(at, at[1:])]


def _buckets(n_keys: float) -> int:
    """Leading bits that tell buckets of about ``BUCKET_KEYS`` keys apart."""
    return max(3, int(n_keys / BUCKET_KEYS).bit_length())


def _sizes(runs: DataFrame) -> tuple[int, int]:
    """How many words the runs have, and how many different ones."""

    def send(run: _Run) -> pa.RecordBatch:
        parts = [(bucket, _packed(keys[a:b])) for keys in [np.sort(run.hashes.view(np.uint64))] for bucket, a, b in _parts(keys, bits)]
        columns = list(zip(*parts)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["bucket", "keys"])

    def count(bucket: pa.Table) -> pa.Table:
        return pa.table({"n": [len(np.unique(np.concatenate([_unpacked(x) for x in bucket.column("keys").to_pylist()])))]})

    total = runs.select("sizes").mapInArrow(_total, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = _buckets(total)
    return total, runs.mapInArrow(_each_run(send), "bucket int, keys binary").groupBy("bucket").applyInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _total(batches: Iterator) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in b.column(0).to_pylist()], pa.int64())})


def _met(runs: DataFrame, n_keys: float, make: Callable, score: Callable, kind: str, named: bool) -> DataFrame:
    """(key, t, value): of every text ``score(text, counts in all texts of the text's keys)``, where ``make(hashes)`` tells a text's keys and their counts; ``t`` are its words, if ``named``."""
    bits = _buckets(n_keys)

    def send(run: _Run) -> pa.RecordBatch:
        own = run.texts(make)
        keys, place = _run_keys(own)
        n = np.bincount(place, np.concatenate([np.zeros(0), *[t.counts for t in own]]), len(keys)).astype("<u8")
        parts = [(bucket, run.name, _packed(keys[a:b]), _planed(n[a:b])) for bucket, a, b in _parts(keys, bits)]
        columns = list(zip(*parts)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "run", "keys", "n"])

    def add(bucket: pa.Table) -> pa.Table:
        keys = [_unpacked(x) for x in bucket.column("keys").to_pylist()]
        n = np.concatenate([_unplaned(x) for x in bucket.column("n").to_pylist()])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        told = np.bincount(place, n)[place].astype("<u8")
        ends = np.cumsum([len(k) for k in keys])
        return pa.table([bucket.column("run"), bucket.column("bucket"), pa.array([_planed(told[e - len(k) : e]) for k, e in zip(keys, ends)], pa.binary())], ["run", "bucket", "n"])

    def meet(run: pa.Table, counts: pa.Table) -> pa.Table:
        told = _Run(run)
        own = told.texts(make)
        _, place = _run_keys(own)
        among = np.concatenate([np.zeros(0), *[_unplaned(x) for x in counts.sort_by("bucket").column("n").to_pylist()]])[place]
        ends = np.cumsum([len(t.keys) for t in own])
        value = pa.array([score(t, among[e - len(t.keys) : e]) for t, e in zip(own, ends)], pa.float64() if kind == "double" else pa.list_(pa.float64()))
        return pa.table({"key": told.keys.values, **({"t": told.words()} if named else {}), "value": value})

    sent = runs.mapInArrow(_each_run(send), "bucket int, run bigint, keys binary, n binary")
    told = sent.groupBy("bucket").applyInArrow(add, "run bigint, bucket int, n binary")
    of_key = runs.schema["keys"].dataType.elementType.simpleString()
    return runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(meet, f"key {of_key}, {'t array<string>, ' * named}value {kind}")


def own_delta_pmi(df: DataFrame, tokens: Column, key: str, width: int = 5, alpha: float = 0.5) -> DataFrame:
    """(key, delta_pmi): ``journeys.delta_pmi`` of texts against the counts of these texts themselves."""
    runs = _in_runs(df, tokens, key, False)
    total = float(_sizes(runs)[0])
    told = _met(runs, total * (width + 1), lambda w: _Text(w, width), lambda t, among: t.score(among, total, alpha), "double", False)
    return told.select(F.col("key").alias(key), F.col("value").alias("delta_pmi"))


def own_surprisal(df: DataFrame, tokens: Column, key: str, alpha: float = 0.1, named: bool = True) -> DataFrame:
    """(key, tokens, surprisal): nats of every word after the first under an add-alpha model of the steps from word to word in these texts. Tokens only if ``named``."""
    runs = _in_runs(df, tokens, key, named)
    total, distinct = _sizes(runs)
    told = _met(runs, total * 2.0, _Steps, lambda t, among: t.score(among, distinct, alpha), "array<double>", named)
    return told.select(F.col("key").alias(key), *[F.col("t").alias("tokens")] * named, F.col("value").alias("surprisal"))
