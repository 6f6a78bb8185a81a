"""The fourth review: texts without words or sentences, odd letters and spaces, what moves between steps."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import journeys as jo
from quillspark.operators import pairs
from quillspark.operators import topic_runs as tr
from quillspark.operators import topics as to
from quillspark.plans.catalog import all_plans
from tests.oracle import assert_same

TEXTS = [None, "", " ", "\n\t", "!!! ...", "— …", "one", "One two. Three four.", "a a a", "İstanbul ΣΑΣ is. ß ẞ", "Hi! ... ok? \"Yes.\" no.", "?. !. ."]


def _documents(spark, folder, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id here. yes it is")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/all")
    next(folder.joinpath("all").glob("*.parquet")).rename(folder / "documents.parquet")


def _agrees(spark, folder, monkeypatch, name):
    monkeypatch.setattr("tests.oracle.TABLES", ["documents"])
    plan = all_plans()[name]
    assert_same(spark, str(folder), plan.build, plan.sql)


def test_neighbouring_words_of_odd_texts(spark, tmp_path, monkeypatch):
    """A text without words has no row; letters become small one by one."""
    _documents(spark, tmp_path, TEXTS)
    _agrees(spark, tmp_path, monkeypatch, "adjacent_flow_documents")


def test_sentences_of_odd_texts(spark, tmp_path, monkeypatch):
    """A text without sentences has no row, one of one sentence has null; wide spaces are no sentence."""
    _documents(spark, tmp_path, [*TEXTS, "\u00a0", "Hi.\u2003\u00a0There.  \u00a0\u3000", "A b. \u2009 . C d.\u205f", "x\u200b. \u0085 y."])
    _agrees(spark, tmp_path, monkeypatch, "stepwise_distance_documents")
    _agrees(spark, tmp_path, monkeypatch, "sentence_split")


def test_texts_move_as_numbers_of_words(spark, monkeypatch):
    """What is written of a text for its second reading is its words' numbers, a few bytes a word, not words and hashes; runs unfold to the texts they were made of."""
    rng = np.random.default_rng(4)
    texts = [(k, [f"word{x}" for x in rng.zipf(1.3, n) % 5000]) for k, n in enumerate([40_000, 0, 1, 9_000, 30_000, 20_000])] + [(None, None)]
    df = spark.createDataFrame(texts, "k long, t array<string>").coalesce(1)
    monkeypatch.setattr(pairs, "RUN_WORDS", 35_000)
    for named in (True, False):
        runs = pairs._in_runs(df, F.col("t"), "k", named)
        assert sum(Path(f.removeprefix("file:")).stat().st_size for f in runs.inputFiles()) < 4 * 99_001  # before: more than 8 bytes a word
        assert pairs._sizes(runs) == (99_001, len({w for _, t in texts for w in t or []}))
    told = pairs.own_surprisal(df, F.col("t"), "k").collect()
    assert {r.k: (r.tokens, len(r.surprisal)) for r in told} == {k: (t or [], max(0, len(t or []) - 1)) for k, t in texts}


def test_numbers_in_planes():
    for x in ([], [0], [5, 255], [2**64 - 1, 0, 256], list(range(70_000))):
        x = np.array(x, np.uint64)
        assert (pairs._unplaned(pairs._planed(x)) == x).all() and len(pairs._unplaned(pairs._planed(x))) == len(x)
        if len(x):
            assert (pairs._unpacked(pairs._packed(np.sort(x))) == np.sort(x)).all()


def test_flow_of_long_texts(monkeypatch):
    """Mean distances to all words before, over many blocks, against their definition; near and equal vectors keep their digits."""
    rng = np.random.default_rng(3)
    near = np.concatenate((rng.random((40, 3)) * 100, 50 + rng.random((20, 3)) * 1e-7, np.zeros((1, 3))))
    for known, n in ((rng.random((90, 4)) - 0.5, 700), (near, 300), (np.ones((1, 2)), 40), (rng.random((2, 1)), 2)):
        word = rng.integers(0, len(known), n)
        v = known[word]
        want = [np.sqrt(((v[:i] - v[i]) ** 2).sum(axis=1)).mean() for i in range(1, n)]
        for sizes in ((512, 1 << 21, 1 << 17), (20, 200, 64)):
            for name, x in zip(("FLOW_BLOCK", "FLOW_HELD", "FLOW_STEP"), sizes):
                monkeypatch.setattr(jo, name, x)
            assert np.allclose(jo._flow(known, word), want, rtol=1e-10, atol=1e-13)


def test_flow_makes_a_vector_once_for_many_texts(spark, monkeypatch):
    """Vectors are made of the different words of a run of texts, and are those of the expression."""
    asked, own = [], jo._hash_vectors
    monkeypatch.setattr(jo, "_hash_vectors", lambda names, dim=4: asked.extend(names) or own(names, dim))
    words = [f"w{k % 7}" for k in range(500)] + ["été", "한"]
    batch = pa.record_batch({"t": pa.array([words, None, ["w1"], words], pa.list_(pa.string())), "key": [1, 2, 3, 4]})
    got = pa.Table.from_batches(jo._word_journeys(iter([batch]))).to_pylist()
    assert len(asked) == 9 and [r["key"] for r in got] == [1, 2, 3, 4] and [len(r["journey"] or []) for r in got] == [501, 0, 0, 501]
    df = spark.createDataFrame([(w,) for w in asked], "w string")
    assert np.allclose([r.v for r in df.select(jo.hash_vector(F.col("w")).alias("v")).collect()], own(asked), rtol=0, atol=0)


def test_topics_over_runs_are_those_over_rows(spark, monkeypatch):
    """Products of topics, weights, leading terms and typical texts by keys in buckets, against the same over rows of names; few bytes a word wait or move."""
    rng = np.random.default_rng(8)
    texts = [(k, [f"w{x}" for x in rng.zipf(1.4, n) % (300 + 50 * (k % 5))], int(k % 5) if k % 7 else 3) for k, n in enumerate([*rng.integers(0, 400, 60), 30_000, 0])]
    texts += [(100 + k, *texts[5][1:]) for k in range(3)]
    df = spark.createDataFrame(texts, "doc long, words array<string>, topic int").repartition(3)
    monkeypatch.setattr(pairs, "RUN_WORDS", 4_000)
    monkeypatch.setattr(pairs, "BUCKET_KEYS", 2_000)
    runs = tr.topic_runs(df, F.col("words"), "doc", "topic")
    buckets = tr.term_buckets(runs)
    held = df.select("doc", "topic", F.explode(to.terms(F.col("words"))).alias("term")).groupBy("doc", "topic", "term").agg(F.count("*").alias("c")).cache()
    counts = held.groupBy("topic", "term").agg(F.sum("c").alias("c")).cache()
    rows = lambda d, *c: sorted(tuple(r[x] if not isinstance(r[x], float) else round(r[x], 9) for x in c) for r in d.collect())
    assert rows(tr.shared_mass(buckets), "x", "y", "f", "mass") == rows(to.shared_mass(counts), "x", "y", "f", "mass")
    total = buckets.agg(F.sum("c")).first()[0]
    assert buckets.count() > 4 and total == counts.agg(F.sum("c")).first()[0]
    into = {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    assert to.united(dict.fromkeys(into) | {k: k for k in into}, 0.99, (tr.shared_mass(buckets), total)) == {r.topic: r["into"] for r in to.merged_topics(counts, 0.99).collect()}
    named = lambda d: d.withColumn("topic", F.when(F.col("topic") == 2, 1).otherwise(F.col("topic")))
    want = to.topic_terms(named(counts).groupBy("topic", "term").agg(F.sum("c").alias("c")), 2).cache()
    sizes = tr.topic_sizes(buckets, into, 2)
    got, norms = tr.leading_weights(runs, buckets, into, sizes, 2, 30)
    assert rows(to.diverse_terms(got), "topic", "place", "term", "weight") == rows(to.diverse_terms(want), "topic", "place", "term", "weight")
    scored = tr.scored_texts(runs, buckets, into, sizes, norms, 2, "doc")
    assert rows(scored.filter("similarity IS NOT NULL"), "topic", "doc", "similarity") == rows(to.typical_texts(named(held), want, "doc", 10_000), "topic", "doc", "similarity")
    assert scored.count() == held.select("doc").distinct().count()
    copies = {r.similarity for r in scored.filter("doc IN (5, 100, 101, 102)").collect()}
    assert len(copies) == 1
    waits = sum(Path(f.removeprefix("file:")).stat().st_size for d in (runs, buckets) for f in d.inputFiles())
    assert waits < 10 * sum(len(t) for _, t, _ in texts)
