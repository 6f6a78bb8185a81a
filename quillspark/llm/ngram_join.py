"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's tokens are the hashes of its word shingles. Under any order of all
tokens, two sets of Jaccard similarity t must share a token within the first
n - ceil(t n) + 1 of each, and at least l tokens within the first n - ceil(t n) + l.

1. Documents with equal sets form a class; from there on classes take part.
2. Order one is by hash. Classes keep l = ``EXTENT`` n further tokens in their
   prefix, an inverted index tells which of them two or more classes share, and
   a class with too few shared tokens has no partner and leaves.
3. Order two puts tokens of few classes first, so that a passage which many
   documents share stands at the end; its prefixes give the candidates.
   Orders three and four hash differently within, and across, those counts: a candidate must
   share prefix tokens under them too before its sets are compared.
4. In a posting, all members are first compared with one pivot, later with several,
   and linked members united; a pivot that met everyone leaves. When few pairs of
   different components remain, they are all compared. So no link between components is
   lost, and a group of copies costs its size, not its square.

Defined cases: null, empty and blank texts have the empty set and stand alone;
texts with fewer words than a shingle are one shingle; repeated rows share a
class; a null id is answered but names a component only if all its ids are null;
an empty table gives no rows; very long texts are hashed whole; other columns are
left out by ``jaccard_components`` and carried untouched by ``keep_first``, which
tells rows apart by their places in files, not by ids.
Shingles are told apart by 64-bit hashes, classes by 128-bit hashes of their sets
(their prefix tokens are counted under the first 64 bits of these).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, with_places
from .components import connected_components
from .words import Words, chunks, mix

#: A-Z in lower case; tab to carriage return and space part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
EXTENT = 12
#: Prefix tokens that one group holds at a time.
BUCKET = 500_000


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, out = Words(texts, WORD_BYTES), []
    h = words.hashes
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            rolled = mix(rolled + h[k : k + len(rolled)] + np.uint64(k + 1))
    for a, b in zip(words.cuts[:-1], words.cuts[1:]):
        if b - a >= size:
            out.append(_distinct(rolled[a : b - size + 1]))
        elif b > a:
            out.append(np.frombuffer(xxhash.xxh3_64_digest(b"short" + h[a:b].tobytes()), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def signature(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n tokens with any partner."""
    return -(-percent * n // 100)


def extended(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + max(1, EXTENT * n // 100))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _sets(batches, size: int):
    """(batch, sets) of Arrow batches whose last column is the text."""
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
        yield b, [s for _, part in chunks(texts) for s in shingle_sets(part, size)]


def _describe(size: int, names: list[str]):
    """The columns before the text, set size, signature and its first 64 bits."""

    def run(batches):
        for b, sets in _sets(batches, size):
            sigs = [signature(s) for s in sets]
            halves = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in sigs]
            cols = [*b.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(halves, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _grouped(keys: np.ndarray, n_keys: int):
    """(key, places) of each key that occurs."""
    order = np.argsort(keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(n_keys + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def _prefix_postings(size: int, percent: int, buckets: int):
    """Blocks of (token, class) of the extended prefixes under the hash order."""

    def run(batches):
        tokens, owners, held, seen = [], [], 0, set()

        def flush():
            t, o = np.concatenate(tokens), np.concatenate(owners)
            rows = [(k, t[at].tobytes(), o[at].tobytes()) for k, at in _grouped((t % np.uint64(buckets)).astype(np.int32), buckets)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("bucket", pa.int32()), ("t", pa.binary()), ("o", pa.binary())]))

        for _, sets in _sets(batches, size):
            for s in sets:
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    p = s[: extended(len(s), percent)]
                    tokens.append(p)
                    owners.append(np.full(len(p), np.frombuffer(sig[:8], np.uint64)[0]))
                    held += len(p)
            if held > 3_000_000:
                yield flush()
                tokens, owners, held, seen = [], [], 0, set()
        if held:
            yield flush()

    return run


def _shared_counts(buckets: int):
    """How many tokens of this bucket each class shares with another, dealt by class."""

    def run(table: pa.Table) -> pa.Table:
        t, o = _joined(table, "t", np.uint64), _joined(table, "o", np.uint64)
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        same = np.zeros(len(t), bool)
        same[1:] = t[1:] == t[:-1]
        same[:-1] |= same[1:]
        classes, counts = np.unique(o[same], return_counts=True)
        counts = counts.astype(np.int64)
        rows = [(k, classes[at].tobytes(), counts[at].tobytes()) for k, at in _grouped((mix(classes) % np.uint64(buckets)).astype(np.int32), buckets)]
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table({k: pa.array(v, p) for k, v, p in zip(("bucket", "o", "k"), cols, (pa.int32(), pa.binary(), pa.binary()))})

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    o, k = _joined(table, "o", np.uint64), _joined(table, "k", np.int64)
    classes, at = np.unique(o, return_inverse=True)
    return pa.table({"half": pa.array(_signed(classes)), "shared": pa.array(np.bincount(at, weights=k).astype(np.int64))})


def _full_sets(size: int):
    def run(batches):
        for b, sets in _sets(batches, size):
            keep, want = [], b.column(0).to_pylist()
            for k, s in enumerate(sets):
                if len(s) and signature(s) == want[k]:
                    keep.append((want[k], len(s), s.tobytes()))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keep)], ["sig", "n", "tokens"])

    return run


def _all_postings(buckets: int):
    def run(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            sizes = [len(s) for s in sets]
            if not sum(sizes):
                continue
            t = np.concatenate(sets)
            c = np.repeat(b.column(0).to_numpy(), sizes)
            n = np.repeat(b.column(1).to_numpy().astype(np.int32), sizes)
            rows = [(k, t[at].tobytes(), c[at].tobytes(), n[at].tobytes()) for k, at in _grouped((t % np.uint64(buckets)).astype(np.int32), buckets)]
            kinds = [("bucket", pa.int32()), ("t", pa.binary()), ("c", pa.binary()), ("n", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], schema=pa.schema(kinds))

    return run


POSTED = "bucket int, t binary, c binary, n binary"


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])


def _with_counts(buckets: int):
    """The tokens that two or more classes have, with their class counts, dealt by class."""

    def run(table: pa.Table) -> pa.Table:
        t, c, n = _joined(table, "t", np.uint64), _joined(table, "c", np.int64), _joined(table, "n", np.int32)
        order = np.argsort(t)
        t, c, n = t[order], c[order], n[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        group = np.cumsum(new) - 1
        df = np.bincount(group)[group].astype(np.int32)
        own = df > 1
        t, c, n, df = t[own], c[own], n[own], df[own]
        rows = [(k, t[at].tobytes(), c[at].tobytes(), n[at].tobytes(), df[at].tobytes()) for k, at in _grouped((mix(c.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), buckets)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table({k: pa.array(v, p) for k, v, p in zip(("bucket", "t", "c", "n", "df"), cols, (pa.int32(), *[pa.binary()] * 4))})

    return run


def _prefixes(percent: int):
    """Prefixes under orders two to four of the classes that still can have a partner.

    Tokens of one class only come first in every order; they need not be written.
    """

    def run(table: pa.Table) -> pa.Table:
        t, c, n = _joined(table, "t", np.uint64), _joined(table, "c", np.int64), _joined(table, "n", np.int32)
        df = _joined(table, "df", np.int32).astype(np.uint64)
        rows = []
        if len(t):
            level = np.floor(np.log2(df)).astype(np.uint64)
            second = np.lexsort((t, df, c))
            third = np.lexsort((mix(t + np.uint64(3)), level, c))
            fourth = np.lexsort((mix(t + np.uint64(4)), c))
            cs = c[second]
            cuts = np.concatenate(([0], np.flatnonzero(cs[1:] != cs[:-1]) + 1, [len(cs)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                size = int(n[second[a]])
                left = size - needed(size, percent) + 1 - (size - (b - a))
                if left > 0:
                    hub = int(1000 * np.log2(df[second[a:b]].astype(np.float64)).sum() / size)
                    rows.append((int(cs[a]), size, hub, size - (b - a), *(t[o[a : a + left]].tobytes() for o in (second, third, fourth))))
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = (*[pa.int64()] * 4, *[pa.binary()] * 3)
        return pa.table({k: pa.array(v, p) for k, v, p in zip(("cid", "n", "hub", "single", "p2", "p3", "p4"), cols, kinds)})

    return run


PREFIXES = "cid long, n long, hub long, single long, p2 binary, p3 binary, p4 binary"


POSTINGS = ["token", "cid", "hub", "n", "after"]


def _postings(batches):
    """A row for each prefix token of a class; ``after``: the class's tokens from it on, in order two."""
    for b in batches:
        cid, hub, n, single = (c.to_numpy() for c in b.columns[:4])
        sets = [np.frombuffer(x, np.int64) for x in b.column(4).to_pylist()]
        sizes = [len(s) for s in sets]
        if not sum(sizes):
            continue
        place = np.concatenate([np.arange(k) for k in sizes])
        cols = [np.concatenate(sets), *(np.repeat(x, sizes) for x in (cid, hub, n)), np.repeat(n - single, sizes) - place]
        for at in range(0, len(place), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in cols], POSTINGS)


def _meet(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _filters_pass(batches):
    """Pairs that share prefix tokens under orders three and four too."""
    for b in batches:
        a, c, *p = (x.to_pylist() for x in b.columns)
        rows = [(u, v) for u, v, p3, q3, p4, q4 in zip(a, c, *p) if _meet(p3, q3) and _meet(p4, q4)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["u", "v"])


def _verify(percent: int):
    def run(batches):
        for b in batches:
            rows = []
            for u, v, x, y in zip(*(c.to_pylist() for c in b.columns)):
                both = _meet(x, y)
                if 100 * both >= percent * ((len(x) + len(y)) // 8 - both):
                    rows.append((u, v))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["u", "v"])

    return run


def _power_of_two(x: float) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(1.0, x)))))


def _two_sided(pairs: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (u, v) with the named columns of either class."""
    left = right.select(F.col("cid").alias("u"), *[F.col(c).alias(f"{c}_u") for c in columns])
    other = right.select(F.col("cid").alias("v"), *[F.col(c).alias(f"{c}_v") for c in columns])
    out = pairs.join(left, "u").join(other, "v")
    return out.select("u", "v", *[f"{c}_{s}" for c in columns for s in "uv"])


def _links(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    small = F.least("n_u", "n_v")
    near = _two_sided(pairs, prefixes, ["n", "p3", "p4"]).filter(100 * small >= percent * F.greatest("n_u", "n_v"))
    passed = near.select("u", "v", "p3_u", "p3_v", "p4_u", "p4_v").mapInArrow(_filters_pass, "u long, v long")
    return _two_sided(passed, sets, ["tokens"]).mapInArrow(_verify(percent), "u long, v long")


def class_components(prefixes: DataFrame, sets: DataFrame, percent: int, pairs_per_class: int = 2000) -> DataFrame | None:
    """(node, root) over classes that have links; None if no class has one."""
    postings = materialize(prefixes.select("cid", "hub", "n", "single", "p2").mapInArrow(_postings, ", ".join(f"{c} long" for c in POSTINGS)))
    n_classes = prefixes.count()
    # From their first common token on, two sets must still hold the overlap that their sizes demand.
    reach = f"100 * least(after, p_after) + {percent} * least(after, p_after) >= {percent} * (n + p_n)"
    labels, links, tested, pivots, done = None, None, None, 1, False
    while n_classes:
        own = postings.withColumn("comp", F.col("cid"))
        if labels is not None:
            own = postings.join(labels, postings.cid == labels.node, "left").select(*POSTINGS, F.coalesce("root", "cid").alias("comp"))
        parts = own.groupBy("token", "comp").agg(F.count("*").alias("k"))
        open_ = parts.groupBy("token").agg(F.count("*").alias("comps"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq"))
        open_ = materialize(open_.filter("comps > 1").select("token", ((F.col("m") * F.col("m") - F.col("sq")) / 2).alias("open")))
        left = open_.agg(F.sum("open")).first()[0]
        if not left:
            break
        work = materialize(own.join(open_.select("token"), "token"))
        last = done and left <= pairs_per_class * n_classes
        if last:
            pivot = work.select("token", *[F.col(c).alias(f"p_{c}") for c in ("cid", "n", "after", "comp")])
            pairs = work.join(pivot, "token").filter("cid > p_cid AND comp <> p_comp").filter(reach)
        else:
            # The class of each slot whose tokens are most shared, the likely original of a group of copies: a grouped maximum, so a posting of any length is never sorted in one task.
            slot = F.pmod(F.xxhash64("cid"), F.lit(pivots))
            pivot = work.groupBy("token", slot.alias("slot")).agg(F.max(F.struct("hub", "cid", "n", "after", "comp")).alias("p"))
            pivot = materialize(pivot.select("token", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("cid", "n", "after", "comp")]))
            pairs = work.join(pivot, "token").filter("comp <> p_comp").filter(reach)
        pairs = pairs.select(F.least("p_cid", "cid").alias("u"), F.greatest("p_cid", "cid").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = materialize(pairs)
        found = materialize(_links(pairs, prefixes, sets, percent))
        links = found if links is None else links.union(found)
        if found.head(1):
            labels = connected_components(links)
        if last:
            break
        tested = pairs if tested is None else tested.union(pairs)
        postings = materialize(work.join(pivot.select("token", F.col("p_cid").alias("cid")), ["token", "cid"], "left_anti").select(*POSTINGS))
        pivots, done = pivots * 32, True
    return labels


def _first_of_each(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, place, n_shingles, sig, first; loners: the same without first). ``first`` is the component's smallest (missing, doc_id, place)."""
    id_and_text = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    slim = docs.select(*id_and_text)
    kinds = "".join(f", p{k} long" for k in range(len(place)))
    keys = [f"p{k}" for k in range(len(place))]
    placed = docs.select(id_and_text[0], *[F.col(c).alias(k) for c, k in zip(place, keys)], F.xxhash64(id_and_text[1]).alias("th"), id_and_text[1])
    described = materialize(placed.mapInArrow(_describe(shingle, ["doc_id", *keys, "th", "n_shingles", "sig", "half"]), f"doc_id long{kinds}, th long, n_shingles long, sig binary, half long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *keys, "th")).alias("least")
    classes = described.filter("sig IS NOT NULL").groupBy("sig").agg(least, F.first("n_shingles").alias("n"), F.first("half").alias("half"), F.count("*").alias("size"))
    whole = described.agg(F.sum("n_shingles"), F.count("*")).first()
    total, n_docs = whole[0] or 0, whole[1]
    buckets = _power_of_two(total * (100 - percent + EXTENT) / 100 / BUCKET)
    posted = slim.mapInArrow(_prefix_postings(shingle, percent, buckets), "bucket int, t binary, o binary")
    counts = posted.groupBy("bucket").applyInArrow(_shared_counts(_power_of_two(n_docs / BUCKET)), "bucket int, o binary, k binary")
    shared = counts.groupBy("bucket").applyInArrow(_sum_counts, "half long, shared long")
    floor = F.expr(f"greatest(1L, ({EXTENT}L * (({percent}L * n + 99) div 100)) div 100)")
    alive = classes.join(shared, "half").filter(F.col("shared") >= floor).select("sig", "least")
    # By id and text: rows whose id is null or repeats meet only the class of their own text.
    wanted = alive.select("sig", F.coalesce("least.doc_id", F.lit(-(2**63))).alias("key"), "least.th")
    keyed = slim.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("th"), "text")
    texts = keyed.join(wanted.hint("shuffle_hash"), ["key", "th"]).select("sig", "text")
    sets = texts.mapInArrow(_full_sets(shingle), "sig binary, n long, tokens binary").dropDuplicates(["sig"])
    sets = materialize(sets.withColumn("cid", F.monotonically_increasing_id()))
    held = sets.agg(F.sum("n")).first()[0] or 0
    buckets = _power_of_two(held / BUCKET)
    counted = sets.select("cid", "n", "tokens").mapInArrow(_all_postings(buckets), POSTED).groupBy("bucket").applyInArrow(_with_counts(buckets), f"{POSTED}, df binary")
    prefixes = materialize(counted.groupBy("bucket").applyInArrow(_prefixes(percent), PREFIXES))
    roots = class_components(prefixes, sets, percent)
    named = classes.select("sig", "size", F.col("least").alias("first"))
    if roots is not None:
        member = materialize(roots.join(sets.select(F.col("cid").alias("node"), "sig"), "node").join(classes.select("sig", "least"), "sig"))
        lowest = materialize(member.groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("size")))
        united = hot_join(member.select("sig", "root"), lowest, "root", member.count()).select("sig", "low")
        named = named.join(united, "sig", "left").select("sig", "size", F.coalesce("low", "first").alias("first"))
    rows = hot_join(described.filter("sig IS NOT NULL"), materialize(named), "sig", n_docs)
    return rows, described.filter("sig IS NULL")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document."""
    rows, loners = _first_of_each(docs, id_col, text_col, shingle, percent, [])
    return rows.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id")).union(loners.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each component: that of the smallest doc_id (of several, any one)."""
    placed, place = with_places(docs)
    rows, _ = _first_of_each(placed, id_col, text_col, shingle, percent, place)
    later = rows.filter("first.p0 <> p0 OR first.p1 <> p1").select(*[F.col(f"p{k}").alias(c) for k, c in enumerate(place)])
    return placed.join(later.hint("shuffle_hash"), place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
