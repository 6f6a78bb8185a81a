"""Exact deduplication by Grace hashing.

Rows are first collapsed inside each input partition, so a text that a third of
all rows share reaches the shuffle once per partition. The survivors are dealt
by a content hash; each task fills an open-addressing table that compares whole
contents, and when the table would outgrow its memory budget the records are
split to spill files by another hash digit, recursively.

Defined cases: null text counts as empty; an empty table gives no rows; rows
repeated with the same id count one by one in ``group_size`` and share ``kept``
(``keep_one`` returns exactly one of them); a null id is smaller than any other id; other columns are ignored
by ``exact_dedup`` and carried through untouched by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 16
MAX_DEPTH = 12
LOWEST = -(2**63)


class ContentTable:
    """Open addressing with linear probing; keys are whole contents, values mutable payloads."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.payloads: list[list] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, h: int, content: bytes) -> int:
        """Slot of the content, or of the free place for it."""
        mask = len(self.slots) - 1
        i = h & mask
        while (at := self.slots[i]) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                return i
            i = (i + 1) & mask
        return i

    def get(self, h: int, content: bytes):
        at = self.slots[self.find(h, content)]
        return self.payloads[at] if at >= 0 else None

    def put(self, h: int, content: bytes, payload: list) -> None:
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        self.slots[self.find(h, content)] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.payloads.append(payload)
        self.bytes += len(content) + 200

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for at, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = at

    def items(self):
        return zip(self.hashes, self.contents, self.payloads)


def _spill_write(f, h: int, content: bytes, payload: list) -> None:
    best, n, gids = payload
    f.write(struct.pack("<QIqqI", h, len(content), best, n, len(gids)))
    f.write(struct.pack(f"<{len(gids)}q", *gids))
    f.write(content)


def _spill_read(path: str) -> Iterator[tuple[int, bytes, list]]:
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(32):
            h, size, best, n, k = struct.unpack("<QIqqI", head)
            gids = list(struct.unpack(f"<{k}q", f.read(8 * k)))
            yield h, f.read(size), [best, n, gids]


def grace_groups(
    records: Iterator[tuple[int, bytes, list]], budget: int, folder: str, depth: int = 0
) -> Iterator[tuple[bytes, list]]:
    """Merge payloads [best, n, gids] of equal contents; yields each distinct content once.

    ``budget`` bounds the table in bytes; beyond it everything goes to ``FANOUT``
    spill files in ``folder`` and each file is processed in turn.
    """
    table = ContentTable()
    files = None
    try:
        for h, content, payload in records:
            if files is None:
                if (have := table.get(h, content)) is not None:
                    have[0] = max(have[0], payload[0])
                    have[1] += payload[1]
                    have[2] += payload[2]
                    continue
                if not len(table) or depth >= MAX_DEPTH or table.bytes + len(content) <= budget:
                    table.put(h, content, payload)
                    continue
                paths = [os.path.join(folder, f"{depth}-{k}-{os.urandom(4).hex()}") for k in range(FANOUT)]
                files = [open(p, "wb", buffering=1 << 16) for p in paths]
                for old in table.items():
                    _spill_write(files[_digit(old[1], depth)], *old)
                table = ContentTable()
            _spill_write(files[_digit(content, depth)], h, content, payload)
    finally:
        for f in files or ():
            f.close()
    if files is None:
        for _, content, payload in table.items():
            yield content, payload
        return
    for p in paths:
        yield from grace_groups(_spill_read(p), budget, folder, depth + 1)
        os.remove(p)


def _digit(content: bytes, depth: int) -> int:
    return xxhash.xxh3_64_intdigest(content, seed=depth + 1) % FANOUT


LOCAL = "gid long, doc_id long, h long, text binary, n long, best long"


def _local(budget: int):
    """Collapse equal texts within a partition: a light row per document, a full row per distinct text."""

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        made, table = 0, ContentTable()

        def emit(rows):
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gid", "doc_id", "h", "text", "n", "best"])

        def flush():
            for h, content, (best, n, gid) in table.items():
                yield gid, None, h - (1 << 64) if h >> 63 else h, content, n, best

        for batch in batches:
            light = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = xxhash.xxh3_64_intdigest(text)
                if (have := table.get(h, text)) is None:
                    if len(table) and table.bytes + len(text) > budget:
                        full = list(flush())
                        for k in range(0, len(full), 2000):
                            yield emit(full[k : k + 2000])
                        table = ContentTable()
                    have = [LOWEST, 0, base + made]
                    made += 1
                    table.put(h, text, have)
                have[0] = max(have[0], LOWEST if doc_id is None else doc_id)
                have[1] += 1
                light.append((have[2], doc_id, None, None, None, None))
            if light:
                yield emit(light)
        full = list(flush())
        for k in range(0, len(full), 2000):
            yield emit(full[k : k + 2000])

    return run


def _merge(budget: int):
    def run(batches):
        def records():
            for b in batches:
                for gid, h, text, n, best in zip(*(c.to_pylist() for c in b.columns)):
                    yield h & (2**64 - 1), text, [best, n, [gid]]

        with tempfile.TemporaryDirectory() as folder:
            rows = []
            for content, (best, n, gids) in grace_groups(records(), budget, folder):
                digest = hashlib.sha256(content).hexdigest()
                rows += [(g, None if best == LOWEST else best, n, digest) for g in gids]
                if len(rows) >= 5000:
                    yield _groups(rows)
                    rows = []
            if rows:
                yield _groups(rows)

    return run


def _groups(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gid", "keep_id", "group_size", "text_sha256"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_mb: int = 96) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    budget = memory_mb << 20
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    local = materialize(slim.mapInArrow(_local(budget), LOCAL))
    full = local.filter(F.col("h").isNotNull()).select("gid", "h", "text", "n", "best").repartition(F.col("h"))
    groups = full.mapInArrow(_merge(budget), "gid long, keep_id long, group_size long, text_sha256 string")
    out = local.filter(F.col("h").isNull()).select("gid", "doc_id").join(groups, "gid")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_mb: int = 96) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest id."""
    budget = memory_mb << 20
    schema = docs.schema
    id_at, text_at = schema.names.index(id_col), schema.names.index(text_col)

    def winners(batches):
        """Rows of the partition, one of each text; emptying a full table only collapses less."""
        held = Winners(id_at, text_at)
        for batch in batches:
            held.add(batch)
            if held.bytes > budget:
                yield from held.rows()
                held = Winners(id_at, text_at)
        yield from held.rows()

    def final(batches):
        with tempfile.TemporaryDirectory() as folder:
            yield from grace_rows(batches, id_at, text_at, budget, folder, 0)

    local = docs.mapInArrow(winners, schema)
    dealt = local.repartition(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return dealt.mapInArrow(final, schema)


class Winners:
    """Batches, and of each distinct text the row with the largest id."""

    def __init__(self, id_at: int, text_at: int):
        self.id_at, self.text_at = id_at, text_at
        self.table, self.parts, self.bytes = ContentTable(), [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        texts = batch.column(self.text_at).cast(pa.binary()).to_pylist()
        for i, (doc_id, text) in enumerate(zip(batch.column(self.id_at).to_pylist(), texts)):
            text, key = text or b"", LOWEST if doc_id is None else doc_id
            h = xxhash.xxh3_64_intdigest(text)
            have = self.table.get(h, text)
            if have is None:
                self.table.put(h, text, [key, len(self.parts), i])
            elif key > have[0]:
                have[:] = [key, len(self.parts), i]
        self.parts.append(batch)
        self.bytes += batch.nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids = [[] for _ in self.parts]
        for _, _, (_, p, i) in self.table.items():
            ids[p].append(i)
        for p, own in zip(self.parts, ids):
            if own:
                yield p.take(pa.array(sorted(own)))


def grace_rows(batches, id_at: int, text_at: int, budget: int, folder: str, depth: int) -> Iterator[pa.RecordBatch]:
    """Winning rows of equal texts, split to Arrow spill files when the held batches pass ``budget``."""
    held, batches = Winners(id_at, text_at), iter(batches)
    for batch in batches:
        if held.bytes + batch.nbytes > budget and depth < MAX_DEPTH and len(held.table) > 1:
            paths = _split([*held.rows(), batch], batches, text_at, folder, depth)
            held = None
            for p in paths:
                if os.path.getsize(p):
                    with pa.OSFile(p, "rb") as f, pa.ipc.open_stream(f) as reader:
                        yield from grace_rows(reader, id_at, text_at, budget, folder, depth + 1)
                os.remove(p)
            return
        held.add(batch)
    yield from held.rows()


def _split(first, rest, text_at: int, folder: str, depth: int) -> list[str]:
    paths = [os.path.join(folder, f"{depth}-{k}-{os.urandom(4).hex()}") for k in range(FANOUT)]
    sinks, writers = [pa.OSFile(p, "wb") for p in paths], None
    for source in (first, rest):
        for batch in source:
            writers = writers or [pa.ipc.new_stream(s, batch.schema) for s in sinks]
            rows = [[] for _ in paths]
            for i, text in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
                rows[_digit(text or b"", depth)].append(i)
            for w, ids in zip(writers, rows):
                if ids:
                    w.write_batch(batch.take(pa.array(ids)))
    for w in writers or ():
        w.close()
    for s in sinks:
        s.close()
    return paths
