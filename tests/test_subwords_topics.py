"""Sub-word surprisal and topics against plain computations on small texts."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import subwords as sw
from quillspark.operators import topics as to

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = [
    "It was the best of times, it was the worst of times.", "", None, "   \n ", "one", "Größe  und\tMaß — 1,234 don't we'll\n\n  end ", "x" * 1500,
    " ".join(f"word{n % 37} it's   so" for n in range(300)), "the times, the times of it was the best of times", "a \x1f b  c", "日本語のテキスト これは " * 90,
]
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder(spark):
    return sw.Encoder(sw.read_ranks(spark, f"file://{PATH}"))


@needs_vocabulary
def test_pieces_give_the_tokens_of_the_whole_text(encoder):
    for t in TEXTS:
        whole = encoder.tokens.encode_ordinary(t or "")
        assert encoder.text(t or "")[0].tolist() == whole and encoder.tokens.decode(whole) == (t or "")


@needs_vocabulary
def test_windows_are_encoded_as_their_own_texts(encoder):
    for t in filter(None, TEXTS):
        for stride, window in ((256, 1024), (7, 20), (5, 5)):
            want = [(encoder.tokens.encode_ordinary(t[max(i + stride - window, 0) : i + stride]), min(i + stride, len(t)) - i) for i in range(0, len(t), stride)]
            assert [(ids.tolist(), n) for ids, n in sw.windows(encoder, t, stride, window)] == want


@needs_vocabulary
def test_surprisal_leaves_the_own_text_out(spark, encoder):
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(TEXTS)], "id long, text string, n int, weight double").repartition(3)
    got = {r.id: r for r in sw.surprisal(df, "id", "text", f"file://{PATH}", stride=30, window=90).collect()}
    ids = [encoder.tokens.encode_ordinary(t) if t and t.strip() else [] for t in TEXTS]
    pairs = [collections.Counter(zip(x, x[1:])) for x in ids]
    size = len(encoder.tokens._mergeable_ranks) + 1
    for i, t in enumerate(TEXTS):
        others = sum((p for j, p in enumerate(pairs) if j != i), collections.Counter())
        first, second = collections.Counter(), collections.Counter()
        for (a, b), n in others.items():
            first[a] += n
            second[b] += n
        total = sum(others.values())

        def nats(a, b):
            return -math.log((others[a, b] + sw.MASS * (second[b] + 1) / (total + size)) / (first[a] + sw.MASS))

        if len(ids[i]) >= 10:
            assert abs(got[i].bits - np.mean([nats(a, b) for a, b in zip(ids[i], ids[i][1:])]) / math.log(2)) < 1e-9
        else:
            assert got[i].bits is None
        if not (t and t.strip()):
            assert got[i].strided is None
            continue
        want = 0.0
        for own, counted in sw.windows(encoder, t, 30, 90):
            targets = range(max(1, len(own) - counted), len(own))
            want += counted * np.mean([nats(own[k - 1], own[k]) for k in targets]) if targets else 0
        assert abs(got[i].strided - want / len(t)) < 1e-9


def test_terms_of_one_and_two_words(spark):
    df = spark.createDataFrame([(["a", "the", "b", "c"],), ([],), (["x"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(to.terms(F.col("w"), ["the"])).collect()] == [["a", "b", "c", "a b", "b c"], [], ["x"], None]


COUNTS = [(0, "red", 8), (0, "wine", 4), (0, "cup", 1), (1, "red", 16), (1, "wine", 8), (1, "cup", 2), (2, "sea", 9), (2, "salt", 5), (2, "cup", 1), (2, "deep sea", 4)]


def test_weights_and_merging(spark):
    counts = spark.createDataFrame(COUNTS, "topic int, term string, c long")
    f, size = collections.Counter(), collections.Counter()
    for t, w, c in COUNTS:
        f[w] += c
        size[t] += c
    mean = sum(size.values()) / 3
    got = {(r.topic, r.term): r.weight for r in to.topic_terms(counts).collect()}
    assert all(abs(got[t, w] - c / size[t] * math.log(1 + mean / f[w])) < 1e-12 for t, w, c in COUNTS)
    assert {r.term for r in to.topic_terms(counts, min_df=3).collect()} == {"cup"}
    assert {(r.topic, r.into) for r in to.merged_topics(counts, 0.95).collect()} == {(0, 0), (1, 0), (2, 2)}
    assert to.merged_topics(counts.limit(0), 0.9).count() == 0


def test_diverse_terms_repeat_little(spark):
    """The second choice is the term of another direction, though two that echo the first weigh more."""
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "a b", 0.9), (0, "b a", 0.8), (0, "z", 0.3), (1, "a", 0.1), (1, "a b", 0.09), (1, "b a", 0.08), (1, "z", 0.25)], "topic int, term string, weight double")
    got = [(r.term, r.place) for r in sorted(to.diverse_terms(weights, top=2, diversity=0.7).filter("topic = 0").collect(), key=lambda r: r.place)]
    assert got[0][0] in ("a", "a b", "b a") and got[1][0] == "z"


def test_typical_texts(spark):
    held = spark.createDataFrame([(1, 0, "red", 2), (1, 0, "wine", 1), (2, 0, "cup", 5), (3, 0, "red", 1), (4, 2, "sea", 1)], "doc long, topic int, term string, c long")
    weights = to.topic_terms(spark.createDataFrame(COUNTS, "topic int, term string, c long"))
    got = {(r.topic, r.doc, r.place) for r in to.typical_texts(held, weights, "doc", 2).collect()}
    assert got == {(0, 1, 1), (0, 3, 2), (2, 4, 1)}


def test_coherence_of_empty_and_short_texts(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["c"] * 300 + ["a"],)], "w array<string>")
    topics = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "never")], "topic string, word string")
    (row,) = to.window_coherence(df, F.col("w"), topics, "topic", "word").collect()
    assert row.words == 3 and -1 <= row.coherence <= 1
