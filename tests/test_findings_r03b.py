"""The third review, last part: work that is spread, whole training, memory that does not grow."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.llm import recurrent
from quillspark.operators import joins
from quillspark.operators import journeys as jo


def test_pairs_of_many_copies_are_made_by_several_tasks(spark, monkeypatch):
    """Copies in several slices, null and repeated keys: every pair once, and not all of them in one task."""
    monkeypatch.setattr(joins, "SLICE", 16)
    texts = ["red ring"] * 90 + ["red bolt"] * 40 + ["old plate", None]
    rows = [(k, "b" if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, "b", "red bolt"), (None, "b", "red ring"), (5, "b", "red ring")]
    df = spark.createDataFrame(rows, "k int, g string, t string").coalesce(1)
    got = joins.self_match(df, "k", ["g"], "t", lambda a, b: sim.token_jaccard(F.split(a, " "), F.split(b, " ")), 0.3, digits=2)
    told = got.withColumn("task", F.spark_partition_id()).collect()
    known = [(k, t) for k, g, t in rows if g and t and k is not None]
    jaccard = lambda a, b: round(len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()}), 2)
    want = Counter((min(x, y), max(x, y), jaccard(a, b)) for i, (x, a) in enumerate(known) for y, b in known[:i] if x != y and jaccard(a, b) >= 0.3)
    assert Counter((r.k, r.other, r.score) for r in told) == want
    assert len({r.task for r in told}) > 1


def test_network_learns_from_every_learned_text(spark):
    """The rounds together read each token once, not a share of them; a small corpus is read by every round."""
    docs = spark.createDataFrame([(f"{'word ' * (k % 9)}w{k} the end",) for k in range(300)] + [(None,), ("",)], "text string")
    v = recurrent.Vocabulary.of(recurrent.count_words(docs, "text"), docs.count())
    assert recurrent.fit(docs, v, "text", least_tokens=1).taught == v.total
    assert recurrent.fit(docs, v, "text").taught == recurrent.ROUNDS * v.total


def test_distances_of_a_long_text_are_told_once(monkeypatch):
    """Blocks of words and of columns against all pairs; the distances computed do not grow with the words of a text."""
    rng = np.random.default_rng(4)
    v, word = rng.random((60, 3)), rng.integers(0, 60, 900)
    told = []
    monkeypatch.setattr(np, "sqrt", lambda x, *a, _own=np.sqrt, **k: told.append(np.size(x)) or _own(x, *a, **k))
    monkeypatch.setattr(jo, "FLOW_BLOCK", 16)
    monkeypatch.setattr(jo, "FLOW_HELD", 600)
    got = jo._mean_distances.func(pd.Series([v[word].ravel(), None, v[0]]), pd.Series([900, -1, 1]))
    far = np.linalg.norm(v[word][:, None] - v[word][None], axis=2)
    assert np.allclose(got[0], [far[i, :i].mean() for i in range(1, 900)]) and got[1] is None and got[2] is None
    assert sum(x for x in told if x > 1) <= 60 * 60 + 900 * 16 + 900
