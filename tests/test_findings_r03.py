"""Long texts and larger tables: what the third review found."""

import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import tokens as tk
from quillspark.operators import journeys as jo
from quillspark.operators import lexicons as lx
from quillspark.operators import pairs


def test_polarity_of_a_long_text_reads_it_once(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    lexicon = spark.createDataFrame([("w1", 1, 5), ("w2", -1, 5), ("w3", 1, 5)], "word string, polarity int, size long")
    began = time.monotonic()
    got = {r.doc_id: r for r in lx.polarity_by_lexicon(df, tk.alnum(F.col("text")), "doc_id", lexicon).collect()}
    assert time.monotonic() - began < 40  # minutes where every word reads the text again
    assert (got[1].pos, got[1].neg, got[1].label) == (2 / 20_000, 1 / 20_000, "positive") and got[2].label is None


def test_topic_terms_of_a_long_text_read_it_once(spark, tmp_path):
    """Pairs of words come from a column of words; the regular expression stands below it, once."""
    from quillspark.plans import spaces

    (spark.createDataFrame([(k, " ".join(f"w{i % (97 + k)}" for i in range(8_000))) for k in range(24)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    held, counts = spaces._topic_counts(spark, str(tmp_path))
    assert counts.agg(F.sum("c")).first()[0] == 24 * (8_000 + 7_999)
    assert time.monotonic() - began < 60  # minutes where every pair reads the text again


def test_partial_ratio_steps_over_windows_and_loses_none():
    """Against every window; and a long text whose quote differs by a line break is told at once."""
    rng = random.Random(3)

    def plain(a, b):
        if len(a) > len(b):
            a, b = b, a
        return max(sim.ratio(a, b[max(0, at) : at + len(a)]) for at in range(1 - len(a), len(b)))

    for _ in range(400):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(1, 14))) for _ in range(2))
        want = 100.0 if a in b or b in a else plain(a, b)
        assert sim.partial_ratio(a, b) == want
        for least in (30.0, 64.5, 80.0):
            assert (sim.partial_ratio(a, b, least) >= least) == (want >= least)
        x, y = " ".join(rng.choices(["ab", "abc", "cd", "e"], k=3)), " ".join(rng.choices(["ab", "bc", "cd", "ee"], k=2))
        assert (sim.token_set_ratio(x, y, 69.5) >= 69.5) == (sim.token_set_ratio(x, y) >= 69.5)
    text = " ".join(rng.choices(["wine", "sea", "old", "red", "stone"], k=12_000))
    began = time.monotonic()
    assert sim.partial_ratio(text, text[:3_000].replace(" ", "\n", 1), 64.5) >= 64.5
    assert time.monotonic() - began < 5


def test_own_pairs_are_those_of_the_joins(spark, monkeypatch):
    """Runs and buckets of a few words give what the joins of all pairs give: repeated words, short texts, none, null, runs that one text fills."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["a", "bb", "c", "dé", "e1"], k=k % 23))) for k in range(60)] + [(60, None), (61, "a a a a"), (62, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, held = tk.alnum(F.col("text")), df.select("doc_id", tk.alnum(F.col("text")).alias("t"))
    plain = held.select(F.explode(jo.word_pairs(F.col("t"))).alias("p")).groupBy("p.w1", "p.w2").agg(F.count("*").alias("n"))
    uni = held.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    want = dict(map(tuple, jo.delta_pmi(df, words, "doc_id", uni, plain).collect()))
    for most in (7, 1_000_000):
        monkeypatch.setattr(pairs, "RUN_WORDS", most)
        assert sorted(map(tuple, pairs.pair_counts(df, words).collect())) == sorted(map(tuple, plain.collect()))
        got = dict(map(tuple, pairs.own_delta_pmi(df, words, "doc_id").collect()))
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)


def test_surprisal_of_steps_met_in_runs(spark, monkeypatch):
    """Counted by hand, over runs of a few words: texts of none and one word have no step, but their words count."""
    rng = random.Random(6)
    texts = {k: rng.choices(["a", "bb", "c", "dé", "e1"], k=k % 9) for k in range(40)} | {40: ["solo"], 41: None}
    df = spark.createDataFrame([(k, None if t is None else " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(3)
    steps = Counter((a, b) for t in texts.values() for a, b in zip(t or [], (t or [])[1:]))
    left, distinct = Counter(), len({w for t in texts.values() for w in t or []})
    for (a, _), n in steps.items():
        left[a] += n
    want = {(k, i, b): -math.log((steps[a, b] + 0.1) / (left[a] + 0.1 * distinct)) for k, t in texts.items() for i, (a, b) in enumerate(zip(t or [], (t or [])[1:]), 1)}
    for most in (7, 1_000_000):
        monkeypatch.setattr(pairs, "RUN_WORDS", most)
        got = {(r.doc_id, r.pos, r.token): r.surprisal for r in jo.bigram_surprisal(df, tk.alnum(F.col("text")), "doc_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_positions_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    words = tk.alnum(F.col("text"))
    got = jo.text_positions(df, words, "doc_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jo.normalized_positions(jo.positions(df, words, "doc_id"), "doc_id").select("doc_id", "pos", "percent").collect()))


def test_vector_products_hold_few_cosines(spark, monkeypatch):
    """However large two blocks are, a task multiplies few rows at a time; near ties below single precision are told apart, equal ones go to the smallest key."""
    from quillspark.operators import vectors as ve

    rng = np.random.default_rng(3)
    first = rng.normal(size=(60, 8))
    v = np.concatenate((first, first[:20] * 3, first[:20] + rng.normal(size=(20, 8)) * 1e-9, np.zeros((2, 8))))
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(c.size <= max(ve.HELD, len(u)) for _, c, _ in ve._rough(np.ones((5000, 4)), np.ones((3000, 4))))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    monkeypatch.setattr(ve, "HELD", 50)
    exact = [[math.fsum(a * b for a, b in zip(x, y)) for y in u] for x in u[:-2]]
    for block in (7, 16_000):
        got = {r.id: (r.other, r.similarity) for r in ve.nearest(df, df, "id", "v", same=True, block_rows=block).collect()}
        assert got.keys() == set(range(100))
        for i, (other, s) in got.items():
            best = max(x for j, x in enumerate(exact[i][:-2]) if j != i)
            assert other != i and abs(s - best) < 1e-15 * 8 and abs(exact[i][other] - best) < 1e-15 * 8
        pairs_ = {(r.id, r.other) for r in ve.near_pairs(df, "id", "v", 0.5, block).select("id", "other").collect()}
        assert pairs_ == {(i, j) for i in range(100) for j in range(i + 1, 100) if exact[i][j] >= 0.5}


def test_neighbour_lists_hold_few_distances(spark, monkeypatch):
    """However large two blocks are, a task holds few distances, and few lists are weighed at a time."""
    from quillspark.operators import density, layout

    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 5))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    whole = sorted(map(tuple, layout.memberships(density.nearest_points(df, df, 4).select("u", "v", "w"), 4).collect()))
    monkeypatch.setattr(density, "HELD", 100)
    monkeypatch.setattr(layout, "LISTS", 3)
    near = density.nearest_points(df, df, 4, 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(70, np.inf))
    got = {(r.u, r.place): (r.v, r.w) for r in near.collect()}
    assert got.keys() == {(i, p) for i in range(70) for p in range(1, 5)}
    assert all(np.argsort(d[i])[p - 1] == v and abs(d[i, v] - w) < 1e-12 for (i, p), (v, w) in got.items())
    assert [r[:2] for r in whole] == [r[:2] for r in sorted(map(tuple, layout.memberships(near.select("u", "v", "w"), 4).collect()))]


def test_texts_reach_python_in_slices(spark):
    """Slices of a batch hold few bytes, or one row; nulls, empty texts, null keys and rows of several results stay."""
    from quillspark.operators.slices import map_slices

    rows = [(None if i == 3 else i, None if i == 5 else "é" * (i % 7) + ("x" * 500 if i == 8 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)

    def prepare():
        def each(b):
            size = sum(len((t or "").encode()) + 1 for t in b["t"])
            assert size <= 30 or len(b) == 1
            return b.assign(n=len(b), words=[np.arange(len(t or "")) for t in b["t"]])

        return each

    got = map_slices(df, "t", prepare, "k long, t string, n long, words array<int>", most=30).collect()
    assert [(r.k, r.t, len(r.words)) for r in got] == [(k, t, len(t or "")) for k, t in rows] and max(r.n for r in got) > 1
    lists = df.selectExpr("k", "split(t, '') AS t").coalesce(1)
    assert map_slices(lists, "t", lambda: lambda b: b[["k"]].iloc[:1], "k long", most=10).count() > 1


def test_credit_lines_compare_short_lines_alone(spark, monkeypatch):
    """As line by line in Python; long lines never reach Python."""
    import difflib

    from quillspark.functions import clean as cl

    def plain(t, *given):
        names = [n.lower() for n in given if n]
        near = lambda x: any(len(x) < 1.5 * len(n) and difflib.SequenceMatcher(None, x, n).ratio() > 0.8 for n in names)
        return None if t is None else "\n".join(x for x in t.split("\n") if not near(x.strip().lower()))

    rows = [
        ("Jane Doe\n   JANE DOE　\nshe wrote\n\nJane Do\n" + "word " * 90, "A Long Title", "Jane Doe"), ("İİİİ\ni̇i̇i̇i̇\nx", "İİİİ", None), ("", "t", "a"), ("\n\n", None, ""),
        (None, "t", "a"), ("t\na\nb\nt", "t", "a"), ("a long titl\nA  Long  Title of it\n\x1f a long title \x85", "A Long Title", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, title string, author string")
    got = {r.id: r.t for r in df.select("id", cl.without_credit_lines("text", "title", "author").alias("t")).collect()}
    assert got == {i: plain(*r) for i, r in enumerate(rows)}
    monkeypatch.setattr(cl, "_credits", lambda lines, *names: F.filter(lines, lambda x: F.length(x) > 100))
    assert df.select("id", cl.without_credit_lines("text", "title", "author").alias("t")).filter("id = 0").first().t == rows[0][0]
