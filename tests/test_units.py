"""Hand-worked cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import clean, metrics, similarity, tokens
from quillspark.operators import journeys, matching, stats, vectors, windows
from quillspark.operators.joins import merge_subtitles
from quillspark.sources import files, report


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_entropy(spark):
    assert one(spark, metrics.entropy(F.col("t"), 1), t="a a b b") == pytest.approx(1.0)
    assert one(spark, metrics.entropy(F.col("t")), t="a b c d e f g h i") is None


def test_average_ranks(spark):
    rows = windows.average_ranks(spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "id int, v int"), "v").orderBy("id").collect()
    assert [r["rank"] for r in rows] == [1, 2.5, 2.5, 4]


def test_delta_and_u(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, 2.0), (1, 2, 3.0), (1, 2, 4.0)], "f int, side int, v double")
    r = stats.mann_whitney(df, "v", "side", ["f"]).first()
    assert (r.u, r.delta) == (2.0, pytest.approx(-5 / 9))


def test_exact_tail():
    # Of the 20 ways to deal ranks 1-6 to three and three, one has U = 9.
    assert stats.exact_tail(9, 3, 3) == pytest.approx(1 / 20)
    assert stats.exact_tail(0, 3, 3) == 1


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "id int, p double")
    rows = windows.benjamini_hochberg(df, "p", "id").orderBy("id").collect()
    assert [r.p_adjusted for r in rows] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_vector_functions(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, 1 - metrics.cosine(a, b)) == 1.0
    assert one(spark, metrics.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_stepwise_distance(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"])], "id int, s array<string>")
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in {"a": (0.0, 0.0), "b": (3.0, 4.0), "c": (3.0, 4.0)}.items() for x in kv])
    assert journeys.stepwise_distance(df, F.col("s"), "id", lambda x: known[x]).first().swd == 12.5


def test_forward_flow(spark):
    df = spark.createDataFrame([(1, ["0", "1", "3"]), (2, ["0"])], "id int, t array<string>")
    rows = {r.id: r.flow for r in journeys.forward_flow(df, F.col("t"), "id", lambda w: F.array(w.cast("double"))).collect()}
    assert rows == {1: 1.75, 2: None}


def test_word_pairs(spark):
    pairs = one(spark, journeys.word_pairs(F.array(*map(F.lit, "abc")), 1))
    assert [(p.w1, p.w2) for p in pairs] == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


@pytest.mark.parametrize("lengths,target,expected", [([4, 6, 5], 10, (0, 1, 10)), ([4], 10, None), ([17], 10, None)])
def test_best_snippet(spark, lengths, target, expected):
    df = spark.createDataFrame([(1, [" ".join(["w"] * n) for n in lengths], target)], "id int, s array<string>, t int")
    r = matching.best_snippets(df, F.col("s"), "id", "t").first()
    assert (r and (r["first"], r["last"], r.n)) == expected


def test_subtitles(spark):
    df = spark.createDataFrame([("Dune: Part One",), ("Dune",), ("Emma: A Life",)], "t string")
    assert sorted(r.merged for r in merge_subtitles(df, "t").collect()) == ["Dune", "Dune", "Emma: A Life"]


@pytest.mark.parametrize("tags,expected", [(None, []), ("a; b", ["a", "b"]), ("a, b", ["a", "b"]), ("x", ["x"]), ("['a', 'b']", ["a", "b"])])
def test_tags(spark, tags, expected):
    df = spark.createDataFrame([(tags,)], "t string")
    assert df.select(clean.standardize_tags(F.col("t")).alias("x")).first().x == expected


def test_clean_quote(spark):
    assert one(spark, clean.clean_quote(F.col("t")), t="“ hello ” ―") == "hello"


def test_word_count_of_nothing(spark):
    assert one(spark, tokens.n_words(F.lit(""))) == 0
    assert one(spark, tokens.n_words(F.lit(" "))) == 0


def test_similarity():
    assert similarity.ratio("abcd", "abed") == 75.0
    assert similarity.ratio("", "") == 100.0
    assert similarity.token_set_ratio("a b", "a b c d") == 100.0
    assert similarity.token_sort_ratio("b a", "a b") == 100.0
    assert similarity.partial_ratio("bcd", "abcde") == 100.0
    assert similarity.lcs("kitten", "sitting") == 4


def test_fuzzy_cut():
    assert clean.fuzzy_cut("Before it. The long quote here. After", "The long quote here.") == "Before it. After"
    assert clean.fuzzy_cut("nothing in common", "zzzz yyyy") == "nothing in common"


def test_mtld_is_length_without_repeats():
    assert metrics.mtld_value([str(i) for i in range(30)]) == 30.0


def test_greedy_matches():
    words = "Aa b c d. Ee f g h i. No".split()
    assert matching.greedy_matches(words, [4, 0, 5], 0.1) == [(0, 0, 4), (2, 4, 9)]


def test_quartiles_and_deviations(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    r = df.agg(F.stddev_samp("v").alias("s"), F.stddev_pop("v").alias("p"), F.expr("percentile(v, 0.25)").alias("q")).first()
    assert (r.s, r.p, r.q) == (pytest.approx(1.290994, abs=1e-6), pytest.approx(1.118034, abs=1e-6), 1.75)


def test_silhouette_signs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 0.9], 1)], "id int, v array<double>, c int")
    assert all(r.silhouette > 0.8 for r in vectors.silhouettes(df, "id", "v", "c").collect())


def test_nearest_in_blocks(spark):
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, v array<double>")
    small = vectors.nearest(df, df, "id", "v", same=True, block_rows=7)
    whole = vectors.nearest(df, df, "id", "v", same=True)
    key = lambda d: sorted((r.id, r.other) for r in d.collect())
    assert key(small) == key(whole)


def test_append_new(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "sink")
    assert files.append_new(df.filter("id < 4"), path, ["id"]) == 4
    assert files.append_new(df, path, ["id"]) == 10
    assert spark.read.parquet(path).count() == 10


def test_npz_and_sqlite(spark, tmp_path):
    import sqlite3

    import numpy as np

    (tmp_path / "n").mkdir()
    (tmp_path / "s").mkdir()
    np.savez(tmp_path / "n" / "a.npz", ids=np.arange(3), vectors=np.ones((3, 2), "float32"))
    assert files.read_npz(spark, str(tmp_path / "n")).count() == 3
    con = sqlite3.connect(tmp_path / "s" / "q.db")
    con.execute("CREATE TABLE quotes (id INTEGER, quote TEXT)")
    con.executemany("INSERT INTO quotes VALUES (?, ?)", [(i, f"q{i}") for i in range(5)])
    con.commit()
    con.close()
    rows = files.read_sqlite(spark, str(tmp_path / "s"), "SELECT * FROM quotes ORDER BY id LIMIT 3", "id long, quote string")
    assert rows.count() == 3


def test_latex():
    assert report.escape_latex("50% of {x_y}") == r"50\% of \{x\_y\}"


def test_stream_dedupe(spark, tmp_path):
    from quillspark.streaming import incremental as inc

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.sql("SELECT id % 3 AS k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(9)").write.parquet(src)
    schema = spark.read.parquet(src).schema
    inc.run_available(inc.dedupe_stream(inc.stream_files(spark, src, schema), ["k"], "ts", "1 hour"), out, mark)
    assert spark.read.parquet(out).count() == 3


def test_self_match_is_brute_force(spark, sf_dir):
    from quillspark.plans.catalog import all_plans

    parts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()]
    want = {}
    for x, brand, a in parts:
        for y, other, b in parts:
            if x < y and brand == other and (s := int(similarity.token_set_ratio(a, b) + 0.5)) >= 90:
                want[x, y] = s
    got = all_plans()["blocked_fuzzy_match"].build(spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.p_partkey, r.other): r.score for r in got} == want


def test_texts_of_documents_are_brute_force(spark, sf_dir):
    """Background pairs, delta PMI and forward flow over every document, whole."""
    from collections import Counter

    from quillspark.plans.catalog import all_plans

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens.alnum(F.col("text")).alias("w"))
    words = {r.doc_id: r.w for r in docs.collect()}
    near = {k: Counter((w[i], w[j]) for i in range(len(w)) for j in range(max(0, i - 5), min(len(w), i + 6)) if i != j) for k, w in words.items()}
    bi, uni = sum(near.values(), Counter()), Counter(x for w in words.values() for x in w)
    run = lambda name: all_plans()[f"{name}_documents"].build(spark, sf_dir).collect()
    assert {(r.w1, r.w2): r.n for r in run("background_pairs")} == bi

    total, pmi = sum(uni.values()), {}
    for k, w in words.items():
        own, n = Counter(w), len(w)
        here = [math.log2((c / n) / (own[x] / n * own[y] / n)) - math.log2(((bi[x, y] + 0.5) / (total + 0.5)) / (uni[x] / total * uni[y] / total)) for (x, y), c in near[k].items()]
        pmi[k] = sum(here) / len(here) if here else None
    got = {r.doc_id: r.delta_pmi for r in run("delta_pmi")}
    assert got.keys() == pmi.keys() and all(got[k] == (x if x is None else pytest.approx(x, abs=1e-6)) for k, x in pmi.items())

    vector = {r.word: r.v for r in docs.select(F.explode("w").alias("word")).distinct().select("word", journeys.hash_vector(F.col("word")).alias("v")).collect()}
    got = {r.doc_id: r.flow for r in run("forward_flow")}
    assert got.keys() == words.keys()
    longest = max(words, key=lambda k: len(words[k]))
    for k in [longest, *sorted(words)[:40]]:
        v = [vector[x] for x in words[k]]
        flow = [sum(math.dist(v[i], v[j]) for j in range(i)) / i for i in range(1, len(v))]
        assert got[k] == (pytest.approx(sum(flow) / len(flow), abs=1e-6) if flow else None)

    got = {r.doc_id: (r.x, r.y) for r in run("static_vectors")}
    assert got.keys() == words.keys()
    for k, w in words.items():
        known = [vector[x] for x in w if x < "n"] or [(0.0, 0.0)]
        assert got[k] == pytest.approx([sum(v[d] for v in known) / len(known) for d in range(2)], abs=1e-6)

    from quillspark.plans.analytics import NEGATIVE, POSITIVE

    got = {r.doc_id: (r.max_affective_shift, r.sentiment_volatility, r.final_sentiment, r.word_count) for r in run("sentiment_journey")}
    assert got.keys() == {k for k, w in words.items() if w}
    for k in got:
        p, total = [], 0
        for i, x in enumerate(words[k], 1):
            total += (x in POSITIVE) - (x in NEGATIVE)
            p.append(total / i)
        mean = sum(p) / len(p)
        want = (max(abs(a - b) for a, b in zip(p, p[1:])), (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5, p[-1]) if len(p) > 1 else (0, 0, 0)
        assert got[k] == pytest.approx((*want, len(p)), abs=1e-6)


def test_benchmark_sentences_are_brute_force(spark, sf_dir):
    from quillspark.plans.catalog import all_plans

    cut = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text", tokens.sentences(F.col("text")).alias("s"))
    words = lambda t: frozenset(re.findall(r"[^\W_]+", t.lower()))
    quotes = {words(x) for r in cut("benchmark", "item_id").collect() for x in [r.text, *r.s]} - {frozenset()}
    near = lambda x: any(2 * len(x & q) >= len(x | q) for q in quotes)
    docs = cut("documents", "doc_id").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    want = {r.doc_id: (len(r.s), sum(near(words(x)) for x in r.s)) for r in docs}
    assert len({r.source for r in docs if want[r.doc_id][1]}) > 1
    assert {r.doc_id: (r.n, r.dropped) for r in all_plans()["benchmark_sentence_removal"].build(spark, sf_dir).collect()} == want


def test_prefixes_and_alignment_reach_the_last_word(spark, sf_dir):
    from quillspark.plans.catalog import all_plans

    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", tokens.alnum(F.col("text")).alias("w"))
    words = {r.item_id: r.w for r in b.collect()}
    got = {(r.item_id, r.i): r.prefix for r in all_plans()["text_prefixes"].build(spark, sf_dir).collect()}
    assert got == {(k, i): " ".join(w[:i]) for k, w in words.items() for i in range(1, len(w) + 1)}
    got = {r.item_id: r.word_of_part for r in all_plans()["align_subwords"].build(spark, sf_dir).collect()}
    assert got == {k: ",".join(str(n) for n, x in enumerate(w) for _ in range(0, len(x), 4)) for k, w in words.items()}


def test_definition_shifts_are_brute_force(spark, sf_dir):
    from quillspark.plans.catalog import all_plans

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens.alnum(F.col("text")).alias("w"))
    vector = {r.word: r.v for r in docs.select(F.explode("w").alias("word")).union(spark.sql("SELECT explode(array('a', 'b', 'c'))")).distinct().select("word", journeys.hash_vector(F.col("word")).alias("v")).collect()}
    mean = lambda ws: [sum(vector[x][k] for x in ws) / len(ws) for k in range(4)]
    got = {r.doc_id: r.shift for r in all_plans()["definition_shifts"].build(spark, sf_dir).collect()}
    rows = docs.collect()
    assert got.keys() == {r.doc_id for r in rows}
    for r in rows:
        glosses = [g for x, g in (("the", "a"), ("and", "b"), ("er", "c")) if x in r.w]
        if glosses:
            a, b = mean(r.w), mean(glosses)
            assert got[r.doc_id] == pytest.approx(1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), abs=1e-6)
        else:
            assert got[r.doc_id] is None
    assert len({x for x in got.values() if x is not None}) > 10


def test_comparison_and_experiment_plans():
    """Seven named pairs with popular before sample, and sixteen experiments."""
    from quillspark.operators import ml, stats

    assert {(a, b) for _, a, b in stats.COMPARISONS} == {("GSQ", "GBLM"), ("T50Q", "T50LM"), ("GSQ", "NLB"), ("GPQ", "NLB"), ("T50Q", "NLB"), ("GPQ", "GSQ"), ("GSQ", "T50Q")}
    plan = ml.experiments()
    assert len(plan) == len({n for n, *_ in plan}) == 16 and all("pmi" in v for *_, v in plan)
    assert {(p, n) for _, p, n, _ in plan[:5]} == {(("GSQ",), ("GBLM",)), (("GPQ",), ("GSQ",)), (("GSQ",), ("NLB",)), (("T50Q",), ("T50LM",)), (("GSQ",), ("T50Q",))}
    assert len([1 for _ in itertools.product(*ml.BOOSTED_GRID.values())]) == 243


def test_quality_is_brute_force(spark):
    from quillspark.operators.ml import quality

    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.4), rng.choice([0.1, 0.2, 0.5, 0.7, 0.9])) for k in range(60)]
    rows = [(k, y, s, int(s >= 0.5)) for k, y, s in rows]
    got = quality(spark.createDataFrame(rows, "id int, label int, score double, predicted int")).first()
    ones, zeros = [s for _, y, s, _ in rows if y], [s for _, y, s, _ in rows if not y]
    area = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    f1 = []
    for c in (0, 1):
        hit = sum(y == c and p == c for _, y, _, p in rows)
        f1.append(2 * hit / (sum(y == c for _, y, _, _ in rows) + sum(p == c for *_, p in rows)))
    assert (got.n, got.auc, got.accuracy, got.macro_f1) == (60, pytest.approx(area), pytest.approx(sum(y == p for _, y, _, p in rows) / 60), pytest.approx(sum(f1) / 2))


def test_far_first_candidate_is_not_taken(spark):
    from quillspark.plans.catalog import all_plans

    got = {r.author: r.language_or_country for r in all_plans()["author_candidates"].build(spark, "").collect()}
    assert got == {"Ann Lee": "English", "Bo Wu": "Not Found", "Cy Fox": "Peru"}


def test_report_p_values_are_brute_force(spark, sf_dir):
    """p of every comparison by pairs and the normal tail; adjusted in one family."""
    from quillspark.operators import stats
    from quillspark.plans import analytics
    from quillspark.plans.catalog import all_plans

    long = analytics._grouped_metrics(spark, sf_dir).toPandas()
    want = {}
    for metric, part in long.groupby("metric"):
        groups = {g: x.value.to_numpy() for g, x in part.groupby("source")}
        for name, a, b in [*stats.COMPARISONS, stats.POOLED]:
            x, y = (np.concatenate([groups[g] for g in ([k] if isinstance(k, str) else k)]) for k in (a, b))
            u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
            n, counts = len(x) + len(y), np.unique(np.concatenate((x, y)), return_counts=True)[1].astype(float)
            sigma = math.sqrt(len(x) * len(y) / 12 * ((n + 1) - (counts**3 - counts).sum() / (n * (n - 1))))
            want[metric, name] = math.erfc((abs(u - len(x) * len(y) / 2) - 0.5) / sigma / math.sqrt(2))
    got = {(r.metric, r.comparison): r for r in all_plans()["group_comparison_report"].build(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    order = sorted(want, key=want.get)
    for k, key in enumerate(order):
        assert got[key].p == pytest.approx(min(1, want[key]), abs=2e-8)
        assert got[key].p_adjusted == pytest.approx(min(1, min(want[o] * len(order) / (j + 1) for j, o in enumerate(order) if j >= k)), abs=2e-7)


def test_token_set_ratio_of_the_blocked_join_is_brute_force(spark, sf_dir):
    """Scores of all pairs of a brand by longest common subsequences of the sorted word sets."""
    from quillspark.plans.catalog import all_plans

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    def token_set(a, b):
        x, y = set(a.split()), set(b.split())
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
        return max(ratio(both, first), ratio(both, second), ratio(first, second)) if both else ratio(first, second)

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()
    want = {(a.p_partkey, b.p_partkey) for a in parts for b in parts if a.p_brand == b.p_brand and a.p_partkey < b.p_partkey and token_set(a.p_name, b.p_name) >= 90}
    got = all_plans()["blocked_fuzzy_match"].build(spark, sf_dir)
    assert {(r.p_partkey, r.other) for r in got.collect()} == want


def test_places_and_running_sums_within_groups(spark):
    rng = np.random.default_rng(0)
    rows = [([None, "a", "b", "b"][rng.integers(4)], i, int(rng.integers(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, v long").repartition(5)
    got = {r.id: (r.place, r.n) for r in windows.upto(df, ["g"], ["id"], "place", total="n").collect()}
    sums = {r.id: r.run for r in windows.upto(df, ["g"], ["id"], "run", "v").collect()}
    for g, i, _ in rows:
        mine = [(j, v) for h, j, v in rows if h == g]
        assert got[i] == (sum(j <= i for j, _ in mine), len(mine))
        assert sums[i] == sum(v for j, v in mine if j <= i)
    assert windows.upto(df.limit(0), ["g"], ["id"], "place").count() == 0


def test_near_pairs_and_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2, 3, (60, 4)).astype(float)
    m = base[np.arange(150) % 60]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    n = np.linalg.norm(m, axis=1)
    with np.errstate(all="ignore"):
        sims = np.nan_to_num(m @ m.T / n[:, None] / n[None, :], nan=-2.0)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] >= 0.9001}
    for block in (7, 40, 4000):
        got = [tuple(r) for r in vectors.near_pairs(df, "id", "v", 0.9001, block).select("id", "other").collect()]
        assert len(got) == len(want) and set(got) == want
    root = list(range(150))
    for _ in root:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    sizes = {r: root.count(r) for r in root}
    got = {r.id: r.cluster for r in vectors.density_clusters(df, "id", "v", 0.9001, 4).collect()}
    assert got == {i: (r if sizes[r] >= 4 else -1) for i, r in enumerate(root)}


def test_nearest_of_equal_vectors_are_the_smallest_keys(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(30, [0.0, 0.0])], "id long, v array<double>")
    for block in (4, 4000):
        got = {}
        for r in vectors.nearest(df, df, "id", "v", k=2, same=True, block_rows=block).collect():
            got.setdefault(r.id, []).append(r.other)
        assert {k: sorted(v) for k, v in got.items()} == {i: [j for j in range(30) if j != i][:2] for i in range(30)}


def test_sentences_hold_any_sign(spark):
    df = spark.createDataFrame([("One ␞ two. Three\nfour! ",)], "t string")
    assert df.select(tokens.sentences(F.col("t"))).first()[0] == ["One ␞ two.", "Three four!"]
