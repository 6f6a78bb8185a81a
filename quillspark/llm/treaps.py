"""Ranked lexical search: an inverted index in shards, each term's postings a treap, traversed together.

``build`` writes the index: documents are taken in shards of about ``SHARD_BYTES`` of text, and for every term of a shard its
documents and occurrences. ``search`` takes the postings of the terms that queries name, shard by shard, and makes a treap of each
term: document order for search, impact as heap order, so that the root of a subtree bounds every posting in it. All
terms of a query go through a shard at once: an interval of documents starts with each term's root; where the summed, weighted
impacts of the roots cannot enter the top k the interval is dropped, else it is split at the strongest root's document,
which is scored, and every treap is split with it. Short intervals are scored whole. The scores are exact.

Shards are searched in rounds, a few first: their k-th scores let most of the others' subtrees go at once.

Null texts have no terms; texts without terms and queries without known terms give no rows. Equal scores stand by ascending
document id, a null id last; rows of equal id are documents each. Query rows of one item id are one query. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import materialize
from .words import Words, chunks

SHARD_BYTES = 24 << 20
#: Pairs of a query and a term that driver and workers hold at a time.
BLOCK_PAIRS = 200_000
#: Queries that are traversed together.
BATCH = 64
#: Intervals of so many documents are scored whole.
LEAF = 16
#: Of so many shards one is searched first; then one of FURTHER.
FIRST, FURTHER = 64, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def strings(words: Words, which: np.ndarray) -> pa.Array:
    """The chosen words as an Arrow column, without a Python object for each."""
    ends = np.empty(2 * len(which) + 1, np.int64)
    order = np.argsort(words.begin[which], kind="stable")
    ends[0:-1:2], ends[1::2], ends[-1] = words.begin[which][order], words.end[which][order], len(words.data)
    alternating = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(which), [None, pa.py_buffer(ends), pa.py_buffer(words.data)])
    back = np.empty(len(which), np.int64)
    back[order] = np.arange(len(which))
    return alternating.take(pa.array(2 * back)).cast(pa.binary()).cast(pa.string())


class _Shard:
    """Postings of several runs of texts, gathered."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        words = Words(texts, _TABLE)
        sizes = np.diff(words.cuts)
        kinds, first, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        pair, times = np.unique(kind * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        self.parts.append((kinds, strings(words, first), pair // len(texts), pair % len(texts) + len(self.ids), times))
        self.ids += ids
        self.sizes.append(sizes)
        self.bytes += len(words.data)

    def rows(self) -> tuple[list, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes in order of id, the terms, and for the postings by term and document: ends of terms, documents, occurrences."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        hashes = np.concatenate([p[0] for p in self.parts])
        kinds, first = np.unique(hashes, return_index=True)
        terms = pa.concat_arrays([p[1] for p in self.parts]).take(pa.array(first))
        term = np.concatenate([np.searchsorted(kinds, p[0])[p[2]] for p in self.parts])
        key = term * len(order) + place[np.concatenate([p[3] for p in self.parts])]
        by = np.argsort(key)
        ends = np.searchsorted(term[by], np.arange(len(kinds) + 1))
        times = np.concatenate([p[4] for p in self.parts])[by]
        return [self.ids[k] for k in order], np.concatenate(self.sizes)[order], terms, ends, key[by] % max(1, len(order)), times


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, written: rows (shard, term, df, at, num), and for each shard one without term that lists its documents.

    ``at`` numbers a shard's documents in order of id, ``num`` is the occurrences of the term there; in the row without term
    ``ids`` are the documents and ``num`` their sizes in terms.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def index(batches: Iterator) -> Iterator[pa.RecordBatch]:
        part, number, ids_type = TaskContext.get().partitionId(), 0, None

        def out(shard: _Shard) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, sizes, terms, ends, at, num = shard.rows()
            n = len(terms)
            name = pa.array(np.full(n + 1, (part << 24) + number, np.int64))
            shift = np.concatenate((ends, [ends[-1]])).astype(np.int32)
            listed = np.concatenate((ends, [ends[-1] + len(ids)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [name, pa.concat_arrays([terms, pa.nulls(1, pa.string())]), pa.array(np.append(np.diff(ends), len(ids)).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(shift), pa.array(at.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(listed), pa.array(np.concatenate((num, sizes)).astype(np.int32))),
                 pa.array([None] * n + [ids], pa.list_(ids_type))],
                ["shard", "term", "df", "at", "num", "ids"],
            )
            number += 1

        shard = _Shard()
        for b in batches:
            ids_type = b.schema.field(0).type
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for start, run in chunks(texts):
                shard.add(ids[start : start + len(run)], run)
                if shard.bytes >= shard_bytes:
                    yield from out(shard)
                    shard = _Shard()
        if shard.ids:
            yield from out(shard)

    return materialize(slim.mapInArrow(index, f"shard bigint, term string, df int, at array<int>, num array<int>, ids array<{kind}>"))


def treaps(at: np.ndarray, impact: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots by term, and left and right child of every posting; -1 for none. Of equal impacts the first document is above."""
    n = len(at)
    left, right, roots = [-1] * n, [-1] * n, []
    heights, bounds = impact.tolist(), ends.tolist()
    for begin, end in zip(bounds[:-1], bounds[1:]):
        spine: list[int] = []
        for k in range(begin, end):
            below, h = -1, heights[k]
            while spine and heights[spine[-1]] < h:
                below = spine.pop()
            left[k] = below
            if spine:
                right[spine[-1]] = k
            spine.append(k)
        roots.append(spine[0] if spine else -1)
    return np.array(roots, np.int64), np.array(left, np.int64), np.array(right, np.int64)


class Shard:
    """The treaps of a shard's terms; ``at`` ascends within each term, ``ends`` parts the terms."""

    def __init__(self, docs: int, at: np.ndarray, impact: np.ndarray, ends: np.ndarray):
        self.docs, self.at, self.impact = docs, at.astype(np.int64), impact.astype(np.int64)
        self.roots, self.left, self.right = treaps(at, impact, ends)
        self.term = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.key = self.term * max(1, docs) + self.at

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score): of each query (terms, weights) the k best documents, by score and document, of score ``floors`` at least and over 0."""
        floors, none = floors.astype(np.int64).copy(), np.zeros(0, np.int64)
        best = (none, none, none)
        state = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        node = self.roots[np.concatenate([t for t, _ in queries])] if len(state) else none
        weight = np.concatenate([w for _, w in queries]) if len(state) else none
        query, low, high = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.docs, np.int64)
        here = node >= 0
        state, node, weight = state[here], node[here], weight[here]
        while len(state):
            gain = weight * self.impact[node]
            begins = np.flatnonzero(np.concatenate(([True], state[1:] != state[:-1])))
            live = state[begins]
            most = np.zeros(len(query), np.int64)
            most[live] = np.add.reduceat(gain, begins)
            stays = (most > 0) & (most >= floors[query])
            short = stays & (high - low <= leaf)
            q, d, s = self._whole(short[state], state, node, weight, query, low, high)
            stays &= ~short
            keep = stays[state]
            state, node, weight, gain = state[keep], node[keep], weight[keep], gain[keep]
            if len(state):
                begins = np.flatnonzero(np.concatenate(([True], state[1:] != state[:-1])))
                owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(state))))
                top = np.flatnonzero(gain == np.maximum.reduceat(gain, begins)[owner])
                top = top[np.concatenate(([True], owner[top][1:] != owner[top][:-1]))]
                cut, name = self.at[node[top]], state[begins]
                split = cut[owner]
                score = np.add.reduceat(weight * self._impact_at(self.term[node], split), begins)
                q, d, s = np.concatenate((q, query[name])), np.concatenate((d, cut)), np.concatenate((s, score))
                before, after = self._within(node, low[name][owner], split), self._within(node, split + 1, high[name][owner])
                both, there = np.concatenate((2 * owner, 2 * owner + 1)), np.concatenate((before, after))
                weight, here = np.concatenate((weight, weight)), there >= 0
                order = np.argsort(both[here], kind="stable")
                state, node, weight = both[here][order], there[here][order], weight[here][order]
                low, high = np.stack((low[name], cut + 1), 1).ravel(), np.stack((cut, high[name]), 1).ravel()
                query = np.repeat(query[name], 2)
            else:
                state = none
            if len(q):
                best, floors = _merged(best, (q, d, s), k, floors)
        return best

    def _impact_at(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = term * max(1, self.docs) + doc
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[place] == key, self.impact[place], 0)

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node of each subtree among the documents from ``low`` to before ``high``; -1 for none."""
        node, out = node.copy(), np.arange(len(node))
        while len(out):
            at = self.at[node[out]]
            left, right = at >= high[out], at < low[out]
            node[out] = np.where(left, self.left[node[out]], np.where(right, self.right[node[out]], node[out]))
            out = out[(left | right) & (node[out] >= 0)]
        return node

    def _whole(self, chosen: np.ndarray, state: np.ndarray, node: np.ndarray, weight: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Scores of all documents with a posting in the chosen intervals."""
        state, term, weight = state[chosen], self.term[node[chosen]], weight[chosen]
        base = term * max(1, self.docs)
        first, last = np.searchsorted(self.key, base + low[state]), np.searchsorted(self.key, base + high[state])
        count = last - first
        posting = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        key = np.repeat(query[state] * max(1, self.docs), count) + self.at[posting]
        pairs, inverse = np.unique(key, return_inverse=True)
        score = np.zeros(len(pairs), np.int64)
        np.add.at(score, inverse, np.repeat(weight, count) * self.impact[posting])
        return pairs // max(1, self.docs), pairs % max(1, self.docs), score


def _merged(best: tuple, new: tuple, k: int, floors: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The k best of each query so far, and the scores that a further document must reach."""
    q, d, s = (np.concatenate(x) for x in zip(best, new))
    fit = (s > 0) & (s >= floors[q])
    q, d, s = q[fit], d[fit], s[fit]
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    floors = floors.copy()
    last = rank == k - 1
    floors[q[last]] = np.maximum(floors[q[last]], s[last])
    keep = rank < k
    return (q[keep], d[keep], s[keep]), floors


def impacts(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence list adds to a score for each unit of its term's weight, in whole numbers."""
    times, m = times.astype(np.int64), 50 + (50 * sizes.astype(np.int64) * n_docs) // max(1, n_terms)
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def search(index: DataFrame, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query row, written.

    Queries are taken in blocks of about ``block_pairs`` pairs of query and term, which bounds what is broadcast; the terms of one
    query are held together.
    """
    spark = index.sparkSession
    round_ = F.when(F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0, 0).when(F.pmod(F.xxhash64("shard"), F.lit(FURTHER)) == 0, 1).otherwise(2)
    index = index.withColumn("round", round_)
    lists = index.filter("term IS NULL")
    told = lists.groupBy("round").agg(F.sum(F.size(F.filter("num", lambda x: x > 0))), F.sum(F.aggregate("num", F.lit(0).cast("bigint"), lambda a, x: a + x))).collect()
    n_docs, n_terms, rounds = sum(r[1] for r in told), sum(r[2] for r in told), sorted(r[0] for r in told)
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    pairs = materialize(queries.select(F.col(item_col).alias("item_id"), F.explode(words).alias("term")).distinct())
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = []
    for b in range(blocks):
        block = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        out.append(_search_block(spark, index, block, k, n_docs, n_terms, rounds))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, block: DataFrame, k: int, n_docs: int, n_terms: int, rounds: list[int]) -> DataFrame:
    terms = block.select("term").distinct()
    wanted = materialize(index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.filter("term IS NULL")))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.sum("df") + 1)))
    weights = {r[0]: r[1] for r in wanted.filter("term IS NOT NULL").groupBy("term").agg(weight.cast("bigint")).collect()}
    queries: dict = {}
    for item, term in block.collect():
        if weights.get(term, 0) > 0:
            queries.setdefault(item, []).append((term, weights[term]))
    items = sorted(queries, key=lambda x: (x is None, x))
    held = spark.sparkContext.broadcast([queries[x] for x in items])
    kind = index.schema["ids"].dataType.elementType.simpleString()
    found, floors = None, np.zeros(len(items), np.int64)
    for r in rounds:
        part = wanted.filter(F.col("round") == r).select("shard", "term", "df", "at", "num", "ids")
        own = materialize(part.groupBy("shard").applyInArrow(_searcher(held, floors, k, n_docs, n_terms), f"item int, doc_id {kind}, score bigint"))
        found = own if found is None else found.unionByName(own)
        if r != rounds[-1]:
            place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
            for item, least in found.withColumn("place", place).filter(F.col("place") == k).select("item", "score").collect():
                floors[item] = least
    named = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    empty = spark.createDataFrame([], f"item int, doc_id {kind}, score bigint")
    return (found if found is not None else empty).join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


def _searcher(held, floors: np.ndarray, k: int, n_docs: int, n_terms: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        terms, lists, nums = rows.column("term").to_pylist(), rows.column("at"), rows.column("num")
        own = terms.index(None)
        ids, sizes = rows.column("ids")[own].values, nums[own].values.to_numpy()
        chosen = [n for n, t in enumerate(terms) if t is not None]
        number = {terms[n]: j for j, n in enumerate(chosen)}
        at = [lists[n].values.to_numpy() for n in chosen]
        num = [nums[n].values.to_numpy() for n in chosen]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int64)
        at = np.concatenate(at) if at else np.zeros(0, np.int32)
        num = np.concatenate(num) if num else np.zeros(0, np.int32)
        shard = Shard(len(ids), at, impacts(num, sizes[at], n_docs, n_terms), ends)
        found = []
        for start in range(0, len(held.value), BATCH):
            batch = []
            for query in held.value[start : start + BATCH]:
                there = [(number[t], w) for t, w in query if t in number]
                batch.append((np.array([t for t, _ in there], np.int64), np.array([w for _, w in there], np.int64)))
            q, d, s = shard.best(batch, k, floors[start : start + BATCH])
            found.append((q + start, d, s))
        q, d, s = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"item": pa.array(q.astype(np.int32)), "doc_id": ids.take(pa.array(d)), "score": pa.array(s)})

    return run
