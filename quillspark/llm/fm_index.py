"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards of about ``SHARD_BYTES`` bytes, sorts the
suffixes of each shard (prefix doubling on the suffixes that still tie), keeps
the Burrows-Wheeler transform as a wavelet matrix with rank counts, and searches
all benchmark phrases backwards at once. Occurrences are located by walking to
sampled suffix positions; the hit words of a document are merged to spans.

The benchmark is read in blocks of bounded size, one at a time on the driver; a task
has one block in memory at a time and searches each of them in one pass over its rows.

Defined cases: null and empty texts have no words and no hits; a benchmark item
with fewer words than a window is one window; items without words never match;
equal windows of several items count for each; an item without id hits words but
is not named; with an empty benchmark nothing is hit, and an empty table gives no
rows; repeated rows are answered each by itself; other columns are left out by
``contamination`` and carried untouched by the others; texts longer than a shard
are cut to pieces that overlap by a window less one word, so no occurrence is lost.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks

WINDOW = 10
SHARD_WORDS = 500_000
SHARD_BYTES = 3_000_000
SAMPLE_EVERY = 32
BLOCK_BYTES = 8 << 20

#: Bytes of words stay (A-Z in lower case), all others become a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols in which every suffix is unlike any other (unique separators)."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, min(62 // bits, 8))
    key = symbols.astype(np.int64)
    for j in range(1, width):
        key <<= bits
        if j < n:
            key[: n - j] |= symbols[j:]
    order = np.argsort(key)
    key = key[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    single = fresh & np.append(fresh[1:], True)
    slots = np.flatnonzero(~single)
    step = width
    while len(slots):
        own = order[slots]
        key = rank[own] * (n + 2) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slots] = own
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over integer symbols, vectorised over many queries."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        self.ones, self.zeros, seq = [], [], symbols.astype(np.int32)
        for bit in self.bits:
            is_one = (seq & (1 << bit)) != 0
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(is_one, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[~is_one], seq[is_one]))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of row ``at`` after the last level, were it to hold ``symbol``."""
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros):
            up = ones[at]
            at = np.where((symbol >> bit) & 1, zeros + up, at - up)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros):
            up = ones[at]
            b = ones[at + 1] - up
            out |= b.astype(out.dtype) << bit
            at = np.where(b, zeros + up, at - up)
        return out


class FMIndex:
    """Over pieces of word numbers; ``chosen`` are the numbers (from 1) that searches ask for, 0 the others.

    Suffixes are ordered by all words. The wavelet matrix keeps the chosen words only, so a
    walk cannot pass another word: places behind one, and beginnings, are sampled besides
    every ``SAMPLE_EVERY``-th place.
    """

    def __init__(self, pieces: list[np.ndarray], chosen: np.ndarray, top: int):
        self.starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])))
        n, ends = int(self.starts[-1]), self.starts[1:] - 1
        words = np.zeros(n, np.int64)
        for at, p in zip(self.starts, pieces):
            words[at : at + len(p)] = p
        small = chosen[words].astype(np.int32)
        sortable = np.where(small > 0, small, words + top) + (len(pieces) - 1)
        small[ends] = 0
        sortable[ends] = np.arange(len(pieces))
        order = suffix_order(sortable)
        self.first = len(pieces) + np.concatenate(([0, 0], np.cumsum(np.bincount(small, minlength=top + 1)[1:])))
        before = small[order - 1]
        held = before > 0
        self.held = np.zeros(n + 1, np.int32)
        np.cumsum(held, dtype=np.int32, out=self.held[1:])
        self.bwt = WaveletMatrix(before[held], top)
        every = np.arange(top + 1)
        self.shift = self.first[:-1] - self.bwt.step(every, np.zeros_like(every))
        self.sampled = ~held | (order % SAMPLE_EVERY == 0)
        self.sample_rank = np.cumsum(self.sampled, dtype=np.int32) - 1
        self.samples = order[self.sampled]

    def back(self, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows one word to the left: where ``symbol`` begins, plus its rank before the row."""
        return self.shift[symbol] + self.bwt.step(symbol, self.held[rows])

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, whose words stand at the right end of the matrix; -1 is a word unknown here."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.starts[-1], np.int64)
        width = patterns.shape[1]
        known = ((patterns >= 0) | (np.arange(width) < width - lengths[:, None])).all(axis=1)
        hi[~known] = 0
        for k in range(1, width + 1):
            live = np.flatnonzero((hi > lo) & (lengths >= k))
            if not len(live):
                break
            c = patterns[live, width - k].astype(np.int64)
            lo[live] = self.back(c, lo[live])
            hi[live] = self.back(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.empty(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            there = self.sampled[rows]
            out[todo[there]] = self.samples[self.sample_rank[rows[there]]] + walked
            todo, rows = todo[~there], rows[~there]
            if len(rows):
                rows = self.back(self.bwt.access(self.held[rows]), rows)
                walked += 1
        return out


class Phrases:
    """Windows of benchmark items: word numbers, lengths and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        seen: dict[tuple, int] = {}
        owners: list[set[int]] = []
        self.items = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = tuple(vocabulary[w] for w in words_of(text.encode("utf-8", "surrogatepass") if text else None))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                key = ids[at : at + window]
                k = seen.setdefault(key, len(seen))
                if k == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[k].add(number[item])
        self.words = list(vocabulary)
        self.hashes = Words(self.words, WORD_BYTES).hashes
        self.window = window
        self.matrix = np.zeros((len(seen), window), np.int32)
        self.lengths = np.array([len(k) for k in seen], np.int64)
        for row, key in enumerate(seen):
            self.matrix[row, window - len(key) :] = key
        self.owner_at = np.concatenate(([0], np.cumsum([len(o) for o in owners]))).astype(np.int64)
        self.owners = np.array([x for o in owners for x in sorted(o)], np.int64)

    def is_at(self, words: Words, row: int, at: int) -> bool:
        """Whether the window stands at a word of the texts, compared by its bytes."""
        size = self.lengths[row]
        own = self.matrix[row, self.window - size :].tolist()
        return all(self.words[w] == words.word(at + k) for k, w in enumerate(own))


def scan_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its words, the merged spans of hit words (k x 2) and the numbers of the items that occur."""
    words = Words(texts, WORD_BYTES)
    sizes = np.diff(words.cuts)
    spans, items = [np.empty((0, 2), np.int64)] * len(texts), [np.empty(0, np.int64)] * len(texts)
    out = lambda: list(zip(sizes.tolist(), spans, items))
    if not len(words.hashes) or not len(phrases.lengths):
        return out()
    coded = pa.array(words.hashes).dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False) + 1, coded.dictionary.to_numpy()
    by = np.argsort(distinct)
    near = by[np.minimum(np.searchsorted(distinct, phrases.hashes, sorter=by), len(by) - 1)]
    here = distinct[near] == phrases.hashes
    chosen = np.zeros(len(distinct) + 1, np.int32)
    chosen[near[here] + 1] = np.flatnonzero(here) + 1
    local = np.where(here, chosen[near + 1], -1)
    pieces, base = [], []
    for a, b in zip(words.cuts[:-1], words.cuts[1:]):
        for at in range(a, b, SHARD_WORDS):
            pieces.append(ids[at : min(b, at + SHARD_WORDS + phrases.window - 1)])
            base.append(at)
    index = FMIndex(pieces, chosen, len(phrases.words))
    lo, hi = index.search(local[phrases.matrix], phrases.lengths)
    found = np.flatnonzero(hi > lo)
    times = (hi - lo)[found]
    window = np.repeat(found, times)
    rows = np.repeat(lo[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = index.locate(rows)
    piece = np.searchsorted(index.starts, at, side="right") - 1
    begin = at - index.starts[piece] + np.array(base)[piece]
    same = np.array([phrases.is_at(words, w, p) for w, p in zip(window.tolist(), begin.tolist())], bool)
    window, begin = window[same], begin[same]
    if not len(window):
        return out()
    end = begin + phrases.lengths[window]
    by = np.lexsort((end, begin))
    begin, end, window = begin[by], end[by], window[by]
    doc = np.searchsorted(words.cuts, begin, side="right") - 1
    cuts = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        k, seen = doc[a], np.unique(window[a:b])
        items[k] = np.unique(np.concatenate([phrases.owners[phrases.owner_at[w] : phrases.owner_at[w + 1]] for w in seen]))
        spans[k] = merge_spans(begin[a:b], end[a:b]) - words.cuts[k]
    return out()


def merge_spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unite spans, sorted by begin, that overlap or touch."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begin) - 1]))
    return np.stack((begin[new], reach[last]), axis=1)


def cut_spans(text: str, spans) -> str:
    """The text without the words of the spans and what stands between them."""
    places, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark as broadcast Phrases of bounded size; the driver holds one of them at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = []
    for k in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        out.append(benchmark.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()])))
    return out


def scan(texts: list[bytes | None], blocks: list[Broadcast]) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each text its words, the merged spans of words that any block hits and the names of the items that occur."""
    sizes, spans, names = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for block in blocks:
        phrases, at = block.value, 0
        for _, shard in chunks(texts, SHARD_BYTES):
            for n, own, items in scan_shard(shard, phrases):
                sizes[at] = n
                if len(own):
                    spans[at].append(own)
                    names[at].update(phrases.items[x] for x in items)
                at += 1
        if len(blocks) > 1:
            forget(block)
    none = np.empty((0, 2), np.int64)
    return [(n, _united(own) if own else none, seen) for n, own, seen in zip(sizes, spans, names)]


def forget(block: Broadcast) -> None:
    """Frees the worker's copy of a block that can be read again from the worker's disk."""
    if getattr(block, "_path", None):
        block.__dict__.pop("_value", None)


def _united(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return merge_spans(both[:, 0], both[:, 1])


def _mapped(docs: DataFrame, blocks: list[Broadcast], text_at: int, finish, schema) -> DataFrame:
    """``finish(batch, results)`` of every batch."""

    def run(batches):
        for b in batches:
            yield finish(b, scan(b.column(text_at).cast(pa.binary()).to_pylist(), blocks))

    return docs.mapInArrow(run, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, spans (word numbers, end exclusive) and items (ids as strings, sorted) of each document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(b, results):
        sizes = pa.array([n for n, _, _ in results], pa.int64())
        spans = pa.array([[{"start": int(x), "end": int(y)} for x, y in own] for _, own, _ in results], places)
        items = pa.array([sorted(names) for _, _, names in results], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([b.column(0), sizes, spans, items], ["doc_id", "n_words", "spans", "items"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    return _mapped(slim, benchmark_blocks(benchmark, item_col, item_text), 1, finish, schema)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents in which no benchmark window occurs, with all their columns."""
    finish = lambda b, results: b.filter(pa.array([not len(s) for _, s, _ in results], pa.bool_()))
    return _mapped(docs, benchmark_blocks(benchmark, item_col, item_text), docs.columns.index(text_col), finish, docs.schema)


def excise(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All documents, the merged spans cut out of their texts; other columns stay as they are."""
    at = docs.columns.index(text_col)

    def finish(b, results):
        cut = [cut_spans(t, s) if len(s) else t for t, (_, s, _) in zip(b.column(at).to_pylist(), results)]
        return b.set_column(at, b.schema.field(at).name, pa.array(cut, pa.string()))

    return _mapped(docs, benchmark_blocks(benchmark, item_col, item_text), at, finish, docs.schema)
