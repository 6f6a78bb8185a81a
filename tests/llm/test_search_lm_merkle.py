"""Ranked search, language-model scores and the Merkle manifest against brute force, and their defined edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle, recurrent, treaps
from quillspark.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, term string, score double, leaf string, g int, run int, item int"


def frame(spark, rows):
    """(id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", 3, 1, "t", 0.5, "l", 2, 4, 5) for i, t, g in rows], DOCS)


LOWER = str.maketrans(q._UPPER, q._LOWER)

# --- 11 ranked search ---


def ranked(docs, items, k):
    terms = lambda t: [w for w in re.findall(treaps.TERM, (t or "").translate(LOWER))]
    docs = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item in {i for i, _ in items}:
        words = {w for i, t in items if i == item for w in terms(t)} & set(df)
        scored = []
        for i, w in docs:
            tf, m = collections.Counter(w), 50 + (50 * len(w) * n_docs) // max(1, n_terms)
            s = sum(weight[t] * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in words if tf[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_bytes,block_pairs", [(1 << 20, 1000), (200, 3)])
def test_ranking_is_exact(spark, shard_bytes, block_pairs):
    """Many shards and blocks of queries give the same ranks; nulls, repeats, ties and a text of one giant word included."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{n}" for n in range(30)] + ["Größe", "ÉTÉ", "x9"]
    docs = [(int(n), " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for n in range(200)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (None, "W1, w2!"), (300, None), (301, ""), (302, "-- ..."), (303, "z" * 100_000 + " w3")]
    items = [(n, " ".join(rng.choice(vocabulary, 6))) for n in range(8)] + [(8, None), (9, "never said"), (10, "w1"), (10, "w2"), (11, "")]
    df, queries = frame(spark, [(i, t, "en") for i, t in docs]).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = treaps.search(treaps.build(df, shard_bytes=shard_bytes), queries, k=5, block_pairs=block_pairs)
    assert rows_of(got) == ranked(docs, items, 5)


def test_ranking_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b", "en")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treaps.search(treaps.build(docs.limit(0)), items).count() == 0
    assert treaps.search(treaps.build(docs), items.limit(0)).count() == 0


def test_traversal_finds_the_best_and_skips():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n_docs, n_terms, k = int(rng.integers(1, 400)), int(rng.integers(1, 9)), int(rng.integers(1, 20))
        at = [np.sort(rng.choice(n_docs, int(rng.integers(0, n_docs + 1)), replace=False)) for _ in range(n_terms)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in at])))
        at, impact = np.concatenate(at), rng.integers(1, 20, ends[-1])
        queries = [(t := rng.choice(n_terms, int(rng.integers(0, n_terms + 1)), replace=False), rng.integers(1, 9, len(t))) for _ in range(4)]
        floors = rng.integers(0, 60, 4)
        name, doc, score = treaps.Shard(n_docs, at, impact, ends).best(queries, k, floors, leaf=4)
        for i, (terms, weights) in enumerate(queries):
            want = np.zeros(n_docs, np.int64)
            for t, w in zip(terms, weights):
                want[at[ends[t] : ends[t + 1]]] += w * impact[ends[t] : ends[t + 1]]
            order = np.lexsort((np.arange(n_docs), -want))
            order = order[(want[order] > 0) & (want[order] >= floors[i])][:k]
            assert (doc[name == i] == order).all() and (score[name == i] == want[order]).all()


def test_treaps_are_treaps():
    at, impact, ends = np.array([0, 3, 5, 8, 1, 2]), np.array([4, 9, 9, 1, 2, 7]), np.array([0, 4, 4, 6])
    roots, left, right = treaps.treaps(at, impact, ends)
    assert roots.tolist() == [1, -1, 5] and left.tolist() == [-1, 0, -1, -1, -1, 4] and right.tolist() == [-1, 2, 3, -1, -1, -1]


# --- 12 language model ---


def test_base_score_counts_everything(spark):
    texts = [None, "", "a b A", "a " * 3000, "b c", "x" * 50_000, "c\td\x0be", "zzz only here", "b c"]
    docs = [(n, t) for n, t in enumerate(texts)] + [(None, "a q"), (4, "b c")]
    got = recurrent.score(frame(spark, [(i, t, "en") for i, t in docs]).repartition(3), F.col("doc_id") != 7, run_bytes=10_000).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]
    c = collections.Counter(w for i, t in docs if i != 7 for w in words(t))
    total, distinct = sum(c.values()), len(c)
    want = collections.Counter(
        (i, i != 7, len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t)), 6)) for i, t in docs
    )
    assert collections.Counter((r.doc_id, r.learned, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)


def test_model_beats_counts_on_held_out(spark, sf_dir):
    got = q.op12_lm_score(spark, sf_dir).toPandas()
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 10 == 0 for i in got.doc_id]).all()
    assert (held.score > held.base_score).mean() > 0.9
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.2


def test_nothing_learned(spark):
    df = frame(spark, [(1, "a b", "en"), (2, None, "en")])
    got = recurrent.score(df, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, abs(round(r.base_score, 9))) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert recurrent.score(df.limit(0), F.lit(True)).count() == 0


def small_network(rng):
    counts = rng.integers(1, 50, recurrent.HEAD).astype(float)
    v = recurrent.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), counts, 3, 1000, 100, rng.integers(1, 9, recurrent.TAIL).astype(float), np.ones(recurrent.TAIL))
    net = recurrent.Network.fresh(v, hidden=5, dtype=np.float64)
    for w in net.weights:
        w += rng.normal(0, 0.1, w.shape)
    return net


def test_gradients_agree_with_differences():
    rng, n = np.random.default_rng(1), recurrent.HEAD + recurrent.TAIL
    net, shape = small_network(rng), (6, 4)
    x, y, keep, real, h = rng.integers(0, n, shape), rng.integers(0, n, shape), (rng.random(shape) > 0.2).astype(float), rng.random(shape) > 0.1, rng.normal(0, 1, (4, 5))
    y[0, 0] = recurrent.HEAD + 3
    _, grads, _ = net.gradients(x, y, keep, real, h)
    for w, g in zip(net.weights, grads):
        places = np.argwhere(np.abs(g) > 1e-6)
        for p in map(tuple, places[rng.choice(len(places), 5)]):
            w[p] += 1e-6
            above = net.gradients(x, y, keep, real, h)[0]
            w[p] -= 2e-6
            below = net.gradients(x, y, keep, real, h)[0]
            w[p] += 1e-6
            assert abs((above - below) / 2e-6 - g[p]) < 1e-5


def test_state_is_carried_and_probabilities_sum_to_one():
    """Slots and windows of any size give each token the same probability: whole texts, each from a fresh state."""
    rng, n = np.random.default_rng(2), recurrent.HEAD + recurrent.TAIL
    net, cuts = small_network(rng), np.array([0, 1, 50, 53, 90])
    ids = rng.integers(0, n, 90)
    one = net.score(ids, cuts, 3, most=1, window=7)
    assert np.allclose(one, net.score(ids, cuts, 3, most=4, window=32)) and np.allclose(one[1:50], net.score(ids[1:50], np.array([0, 49]), 3))
    state = np.repeat(rng.normal(0, 1, (1, 5)), n, 0)
    assert abs(np.exp(net.log_probabilities(state, np.arange(n))).sum() - 1) < 1e-9


# --- 13 Merkle manifest ---


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def tree(nodes):
    """The root, and for each leaf the siblings of every level before and after."""
    paths, held = [[] for _ in nodes], [[n] for n in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), 8)
        for a in runs:
            for k in range(a, min(a + 8, len(nodes))):
                for n in held[k]:
                    paths[n].append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + 8])))
        held = [sum(held[a : a + 8], []) for a in runs]
        nodes = [digest("".join(nodes[a : a + 8])) for a in runs]
    return nodes[0], paths


def manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    return sorted(((r.doc_id, g, leaf(r), trees[g][0], root, tuple(p + top)) for g, top in zip(names, tops) for r, p in zip(groups[g], trees[g][1])), key=repr)


def made(df, **more):
    return sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in merkle.manifest(df, **more).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 700])
def test_manifest_is_the_tree(spark, n):
    """Ragged trees over many partitions, a group with most rows, null groups, ids and texts, repeated rows."""
    rows = [(k if k % 50 else None, f"Text {k % 7}" if k % 11 else None, "en" if k % 5 else [None, "", "dé", "fr"][k // 5 % 4]) for k in range(n)]
    rows += rows[: n // 4]
    df = frame(spark, rows)
    assert made(df) == manifest(df.collect())


def test_manifest_of_many_groups_and_of_nothing(spark):
    df = frame(spark, [(k, "x" * (k % 3) * 100_000, f"g{k % 90}") for k in range(200)])
    assert made(df) == manifest(df.collect())
    assert merkle.manifest(df.limit(0)).count() == 0


def test_tampering_shows(spark):
    df = frame(spark, [(k, "Upper" if k % 2 else "lower", "en") for k in range(40)])
    forged = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text"))
    got = merkle.manifest(df, carry={"forged": forged}).withColumn("same", merkle.folded(F.col("forged"), F.col("proof")) == F.col("root"))
    assert {r.doc_id for r in got.filter("same").collect()} == {k for k in range(40) if k % 2 == 0}
    assert got.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
