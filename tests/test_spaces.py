"""Indexed neighbours and density clusters against brute force over small planted vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import density as de
from quillspark.operators import neighbours as ne

VECTORS = "id long, v array<float>, cell int, copies int, w double, comp int"


def frame(spark, x, ids=None):
    """Vectors with columns whose names the operators use themselves."""
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [float(y) for y in v], 1, 2, 0.5, 3) for i, v in zip(ids if ids is not None else range(len(x)), x)], VECTORS)


def planted(rng, n=400, d=12):
    x = rng.normal(0, 1, (n, d))
    x[50:90] = x[7] + rng.normal(0, 0.02, (40, d))  # a group of near copies
    x[100:220] = x[8]  # a third of all rows is one vector
    return x.astype(np.float32)


@pytest.mark.parametrize("block_rows", [30, 3000])
def test_near_rows_are_exact(spark, block_rows):
    x = planted(np.random.default_rng(1)).astype(float)
    got = {r.id: (r.n_links, r.kept) for r in ne.near_rows(frame(spark, [*x, None, np.zeros(12)]), "id", "v", 0.95, block_rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert got == {i: (int(near[i].sum()), not near[i, :i].any()) for i in range(len(x))}


def test_index_finds_most_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 8))[rng.integers(0, 30, 1500)] + rng.normal(0, 0.5, (1500, 8))
    got = ne.nearest_rows(frame(spark, x.astype(np.float32)), "id", "v", k=3, queries=F.col("id") % 20 == 0).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 1500, 20) for j in np.argsort(-(u @ u[i]) + 9.0 * (np.arange(1500) == i))[:3]}
    assert len(got) == 225 and len({(r.id, r.other) for r in got} & want) >= 0.9 * len(want)


def test_every_cell_gives_the_exact_neighbours(spark):
    x = np.random.default_rng(3).normal(0, 1, (200, 6)).astype(np.float32)
    rows = ne.prepared(frame(spark, x), "id", "v")
    cells = ne.fit(rows, cells=9)
    got = {(r.id, r.other) for r in ne.search(None, rows, cells, 9, k=2, same=True, block_rows=25).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(200)
    assert got == {(i, int(j)) for i in range(200) for j in np.argsort(-s[i])[:2]}


def test_neighbours_of_nothing(spark):
    none = frame(spark, [None, np.zeros(3)])
    assert ne.near_rows(none, "id", "v", 0.9).count() == 0 and ne.nearest_rows(none, "id", "v").count() == 0


def brute_clusters(x, m):
    """From the longest tree edge down: a cluster ends where both sides have m rows; then the largest stabilities."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(m, n - 1)]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    rows, columns = np.triu_indices(n, 1)
    near, up, tree = [{} for _ in range(n)], list(range(n)), []

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k in np.argsort(w[rows, columns], kind="stable"):
        u, v = int(rows[k]), int(columns[k])
        if find(u) != find(v):
            up[find(u)] = find(v)
            tree.append((u, v, w[u, v]))
            near[u][v] = near[v][u] = 1

    def side(a):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    clusters = [{"all": set(range(n)), "birth": 0, "stability": 0.0, "below": [], "root": True}]
    own = {i: clusters[0] for i in range(n)}
    for u, v, length in reversed(tree):
        c, density = own[u], 1 / max(length, de.LEAST)
        del near[u][v], near[v][u]
        if c is None:
            continue
        sides = [side(u), side(v)]
        if min(map(len, sides)) >= m:
            c["stability"] += len(sides[0] | sides[1]) * (density - c["birth"])
            for s in sides:
                c["below"].append({"all": s, "birth": density, "stability": 0.0, "below": [], "root": False})
                own.update(dict.fromkeys(s, c["below"][-1]))
        else:
            for s in sides:
                if len(s) < m:
                    c["stability"] += len(s) * (density - c["birth"])
                    own.update(dict.fromkeys(s, None))
    labels = np.full(n, -1)

    def best(c):
        below = sum(best(x) for x in c["below"])
        c["won"] = not c["root"] and c["stability"] >= below
        return max(c["stability"], below)

    def name(c):
        if c["won"]:
            labels[list(c["all"])] = min(c["all"])
        for x in c["below"] if not c["won"] else ():
            name(x)

    best(clusters[0])
    name(clusters[0])
    return labels


@pytest.mark.parametrize("blobs,spread,noise,m,range_edges,listed", [(4, 0.05, 40, 8, 10**6, None), (5, 0.2, 30, 5, 37, 5)])
def test_clusters_are_those_of_the_whole_tree(spark, blobs, spread, noise, m, range_edges, listed):
    """Few listed neighbours make components search all points; short ranges hand states on."""
    rng = np.random.default_rng(blobs)
    x = np.concatenate([rng.normal(rng.uniform(-1, 1, 3), spread, (rng.integers(15, 50), 3)) for _ in range(blobs)] + [rng.uniform(-2, 2, (noise, 3))])
    x = x.astype(np.float32).astype(float)
    got = {r.id: r.cluster for r in de.hdbscan(frame(spark, x), "id", "v", m, listed=listed, block_rows=60, range_edges=range_edges).collect()}
    want = brute_clusters(x, m)
    assert len(set(want)) > 2 and [got[i] for i in range(len(x))] == want.tolist()


def test_copies_are_a_cluster(spark):
    """Rows of one vector belong together; rows without vector are left out; a key of null too."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros((9, 2)), rng.uniform(4, 30, (12, 2)), np.ones((7, 2))]).astype(np.float32)
    df = frame(spark, [*x, None, x[0]], [*range(len(x)), 90, None])
    got = {r.id: r.cluster for r in de.hdbscan(df, "id", "v", 5).collect()}
    assert {i for i, c in got.items() if c == 0} == set(range(9)) and {i for i, c in got.items() if c == 21} == set(range(21, 28)) and len(got) == 28


def test_clusters_of_nothing(spark):
    assert de.hdbscan(frame(spark, [None]), "id", "v").count() == 0
    assert [r.cluster for r in de.hdbscan(frame(spark, [[1.0, 2.0]]), "id", "v", 3).collect()] == [-1]


# --- attributions, intervals, densities ---


def test_attributions_are_shapley_values(spark):
    """Against all orders of the features, with unknown ones following the cover; they add up to the model's value."""
    from itertools import permutations

    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from quillspark.operators import attribution as at

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 3)).round(3)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int")
    names = ["a", "b", "c"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    for learner in (GBTClassifier(seed=1, maxIter=3, maxDepth=3), RandomForestClassifier(seed=1, numTrees=3, maxDepth=4)):
        model = learner.fit(rows)
        forest = at.ensemble(model)

        def value(known, row):
            """Mean value of the leaves, a feature outside ``known`` following the cover."""
            total = 0.0
            for leaf in forest:
                share = 1.0
                for f, over, upto, z in leaf.way:
                    share *= float(over < row[f] <= upto) if f in known else z
                total += leaf.value * share
            return total

        got = {r.id: r for r in at.attributions(df, model, names, "id").collect()}
        raw = {r.id: r for r in model.transform(rows).collect()}
        for i in range(0, 300, 37):
            want = np.zeros(3)
            for order in permutations(range(3)):
                for k, f in enumerate(order):
                    want[f] += (value(order[: k + 1], x[i]) - value(order[:k], x[i])) / 6
            assert np.allclose([got[i].phi_a, got[i].phi_b, got[i].phi_c], want)
            margin = raw[i].rawPrediction[1] / 2 if isinstance(learner, GBTClassifier) else raw[i].probability[1]
            assert abs(got[i].total - (raw[i].rawPrediction[1] if isinstance(learner, GBTClassifier) else margin)) < 1e-9


def test_intervals_agree_with_resampling(spark):
    """The plain way: rows drawn again, rows left out one by one."""
    from quillspark.operators import intervals as it

    rng = np.random.default_rng(8)
    y = (rng.random(120) < 0.4).astype(int)
    s = (rng.normal(0, 1, 120) + 1.2 * y).round(1)
    df = spark.createDataFrame([(int(a), float(b), int(b > 0.5)) for a, b in zip(y, s)] + [(None, 1.0, 1), (1, None, None)], "y int, s double, p int")

    def area(rows):
        a, b = s[rows][y[rows] == 1], s[rows][y[rows] == 0]
        return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean() if len(a) and len(b) else np.nan

    right = lambda rows: (y[rows] == (s[rows] > 0.5)).mean()
    everything = np.arange(120)
    for stat, got in ((area, it.area_interval(df, "y", "s", 4000).first()), (right, it.accuracy_interval(df, "y", "p", 4000).first())):
        apart = np.array([stat(np.delete(everything, i)) for i in everything])
        d = apart.mean() - apart
        drawn = np.array([stat(rng.integers(0, 120, 120)) for _ in range(4000)])
        low, high = it.bca(drawn, stat(everything), (d**3).sum() / (6 * (d**2).sum() ** 1.5))
        assert abs(got.estimate - stat(everything)) < 1e-12 and abs(got.low - low) < 0.02 and abs(got.high - high) < 0.02 and got.n == 120
    assert it.area_interval(df.filter("y = 1"), "y", "s", 100).first().estimate is None
    assert it.area_interval(df.limit(0), "y", "s", 100).first().n == 0


def test_densities_integrate_to_one(spark):
    from quillspark.operators import intervals as it

    rng = np.random.default_rng(9)
    x = [*((g, float(v)) for g in ("a", None) for v in rng.normal(0, 2, 500)), ("one", 1.0), ("one", 1.0), ("a", None)]
    got = it.kernel_density(spark.createDataFrame(x, "g string, x double"), "x", "g").toPandas()
    assert set(got.g.fillna("-")) == {"a", "-"} and len(got) == 100
    for _, own in got.groupby(got.g.fillna("-")):
        own = own.sort_values("point")
        assert abs(np.trapezoid(own.density, own.x) - 1) < 0.01


def test_surest_rows_skip_unknown(spark):
    from quillspark.operators import attribution as at

    df = spark.createDataFrame([(1, 1, 1, 0.9), (2, 1, 1, 0.9), (3, 1, 0, 0.7), (4, None, 1, 1.0), (5, 0, None, 1.0), (6, 0, 0, None), (7, 1, 1, 0.2)], "id long, y int, p int, s double")
    got = {(r.y, r.correct, r.id, r.place) for r in at.surest_rows(df, "y", "p", "s", "id", 2).collect()}
    assert got == {(1, True, 1, 1), (1, True, 2, 2), (1, False, 3, 1)}


# --- layouts and fuzzy pairs ---


def test_memberships_and_union(spark):
    """Sums of a list are log2(k), the nearest is 1; a pair listed twice has a + b - ab, listed once a."""
    from quillspark.operators import layout as la

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lists = [(i, int(j), float(d[i, j])) for i in range(40) for j in np.argsort(d[i])[1:7]]
    own = la.memberships(spark.createDataFrame(lists, "u long, v long, w double"), 6).toPandas()
    assert np.allclose(own.groupby("u").w.sum(), np.log2(6), atol=1e-4) and np.allclose(own.groupby("u").w.max(), 1)
    a = {(r.u, r.v): r.w for r in own.itertuples()}
    got = {(r.u, r.v): r.w for r in la.fuzzy_graph(spark.createDataFrame(lists, "u long, v long, w double"), 6).collect()}
    assert set(got) == {p for u, v in a for p in ((u, v), (v, u))}
    for (u, v), w in got.items():
        p, q = a.get((u, v), 0.0), a.get((v, u), 0.0)
        assert abs(w - (p + q - p * q)) < 1e-9


def test_curve_of_known_distances():
    from quillspark.operators import layout as la

    assert np.allclose(la.curve(0.1), (1.577, 0.895), atol=2e-3) and np.allclose(la.curve(0.0), (1.933, 0.790), atol=2e-3)


def test_layout_keeps_groups_together(spark):
    from quillspark.operators import layout as la

    rng = np.random.default_rng(0)
    label = rng.integers(0, 6, 150)
    x = rng.normal(0, 1, (6, 12))[label] + rng.normal(0, 0.2, (150, 12))
    got = la.umap(frame(spark, [*x.astype(np.float32), None, np.zeros(12)]), "id", "v", 2, 8, rounds=6).toPandas().sort_values("id")
    y = got[["y0", "y1"]].to_numpy()
    d = ((y[:, None] - y[None]) ** 2).sum(-1) + 1e9 * np.eye(150)
    assert len(got) == 150 and (label[np.argsort(d, 1)[:, :5]] == label[:, None]).mean() > 0.9
    assert la.umap(frame(spark, [None]), "id", "v").count() == 0


def test_fuzzy_pairs_are_those_of_all_pairs(spark):
    """Typos, own words, subsets, repeated and empty texts; blocks apart; at scores high and low."""
    import random

    from quillspark.functions.similarity import token_set_ratio
    from quillspark.operators import fuzzy as fu

    rng = random.Random(3)
    words = ["almond", "antique", "aquamarine", "azure", "beige", "bisque", "black", "red", "green", "it", "a"]
    rows = []
    for i in range(140):
        text = list(" ".join(rng.choices(words, k=rng.randint(0, 6))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if text:
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice(["", "x", " ", "ab"])
        rows.append((i, rng.choice(["p", "q"]), "".join(text)))
    rows += [(200, "p", None), (201, None, "red"), (202, "p", "red  green"), (203, "p", "red  green"), (204, "p", "ab"), (205, "p", "ba")]
    df = spark.createDataFrame(rows, "id long, brand string, name string")
    for least in (90, 75, 40):
        want = set()
        for i, (k, b, x) in enumerate(rows):
            for l, c, y in rows[i + 1 :]:
                if b is not None and b == c and x is not None and y is not None and x.split() and y.split():
                    score = int(token_set_ratio(x, y) + 0.5)
                    if score >= least:
                        want.add((k, l, score))
        assert {tuple(r) for r in fu.similar_rows(df, "id", ["brand"], "name", least).collect()} == want


def test_quantiles_are_linear_and_exact(spark):
    from quillspark.operators.windows import exact_quantiles

    rng = np.random.default_rng(10)
    rows = [(g, float(v)) for g in ("a", None) for v in np.round(rng.normal(0, 3, 101), 1)] + [("one", 5.0), ("a", None), ("none", None)]
    got = {r.g: r.q for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], (0, 0.25, 0.5, 0.9, 1), "q").collect()}
    for g in ("a", None, "one"):
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], (0, 0.25, 0.5, 0.9, 1)))
    assert "none" not in got


def test_delta_interval_by_group(spark):
    """Each group's replicates are its own, wherever its values lie; one side alone has no interval."""
    from quillspark.operators.intervals import delta_interval

    rng = np.random.default_rng(11)
    rows = [(g, float(v) + shift * (s == 1), s) for g, shift in (("near", 0.0), ("far", 9.0)) for s in (1, 2) for v in rng.normal(0, 1, 60)] + [("alone", 1.0, 1)]
    got = {r.g: r for r in delta_interval(spark.createDataFrame(rows, "g string, x double, side int"), "x", "side", ["g"], 500).collect()}
    assert got["near"].low < 0 < got["near"].high and got["far"].low > 0.99 and got["alone"].low is None


def test_quote_sentences_go(spark):
    from quillspark.operators.matching import without_quote

    rows = [
        (1, ["It was the best of times.", "We walked on.", "the best of Times it was"], "It was the best of times."),
        (2, ["Nothing of it here.", "Other words."], "a wholly different saying about ships"), (3, ["A b c."], None), (4, None, "x"), (5, [], "x"), (6, ["", "Say it again, say it."], "Say it again, say it"),
    ]
    df = spark.createDataFrame([(i, s, " ".join(s) if s is not None else None, q) for i, s, q in rows], "id int, s array<string>, t string, q string")
    got = {r.id: r.k for r in df.select("id", without_quote(F.col("s"), F.col("t"), F.col("q")).alias("k")).collect()}
    assert got == {1: ["We walked on."], 2: rows[1][1], 3: ["A b c."], 4: None, 5: [], 6: [""]}


def test_subwords_meet_their_words(spark):
    from quillspark.operators.journeys import align_subwords

    df = spark.createDataFrame([(["ab", "c", "defg"], ["a", "b", "c", "de", " fg"]), ([], []), (None, ["a"]), (["x"] * 30_000, ["x"] * 30_000)], "w array<string>, p array<string>")
    got = [r[0] for r in df.select(align_subwords(F.col("w"), F.col("p"))).collect()]
    assert got == [[0, 0, 1, 2, 2], [], None, list(range(30_000))]
