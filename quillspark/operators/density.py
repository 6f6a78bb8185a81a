"""Hierarchical density clusters: core distances, the mutual-reachability tree, condensed clusters of largest stability, noise.

Equal vectors are one point of several rows. Every point's nearest neighbours come block by block as matrix products; Boruvka
rounds join components along their least edges. A component's least edge is certain when it is no longer than what any of its
points may miss beyond its own list; where too few are certain, the points in question are searched against all, the largest component's
never. The tree's edges then run in ranges of bounded size from short to long: one task unites a range's components, and what it
keeps of each is a handful of sums. Nothing of the size of the data is held by a task or the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import _blocks, _kept, _spread
from .windows import upto

#: Distances below count as this one, so that densities stay finite.
LEAST = 1e-9
BLOCK_ROWS = 8000
#: Distances that a task holds at a time.
HELD = 1 << 20
#: Tree edges that one task unites.
RANGE_EDGES = 200_000

_EDGE = "u long, v long, w double"


def points(df: DataFrame, key: str, vector: str | Column) -> tuple[DataFrame, DataFrame]:
    """(id, v, copies) of the different vectors, id the smallest key, and (key, id) of all rows; rows without vector are left out."""
    rows = df.select(F.col(key).alias("key"), F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double")).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    own = _kept(rows.groupBy("v").agg(F.min("key").alias("id"), F.count("*").alias("copies")))
    return own.select("id", "v", "copies"), rows.join(own.select("v", "id"), "v").select("key", "id")


def _pairs_of_blocks(left: DataFrame, right: DataFrame, block_rows: int):
    """Both sides dealt to blocks, each row once for every block of the other side, grouped by pair of blocks."""
    n, m = _blocks(left, block_rows), _blocks(right, block_rows)
    right = right.toDF(*right.columns)  # columns of its own, should both sides come from one table
    a = _spread(left.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n))), "b", 0, m - 1)
    b = _spread(right.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(m))), "a", 0, n - 1)
    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def nearest_points(left: DataFrame, right: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v, w): of each left point its k nearest others on the right by Euclidean distance, exactly; of equal ones the smallest ids."""

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        near_w, near_v = [], []
        if len(x) and len(y):
            q, others, all_ids = np.array(y["v"].tolist()), y["id"].to_numpy(), x["id"].to_numpy()
            step = max(1, HELD // len(q))
            for at in range(0, len(x), step):
                p, ids = np.array(x["v"].iloc[at : at + step].tolist()), all_ids[at : at + step]
                d = _squares(p, q)
                d[ids[:, None] == others[None, :]] = np.inf
                most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero((d <= most[:, None] * (1 + 1e-9) + 1e-12) & np.isfinite(d))
                w = _distance(p[i], q[j])
                order = np.lexsort((others[j], w, i))
                i, j, w = i[order], j[order], w[order]
                cuts = np.searchsorted(i, np.arange(len(ids) + 1))
                for s, e in zip(cuts[:-1], np.minimum(cuts[1:], cuts[:-1] + k)):
                    near_w.append(w[s:e])
                    near_v.append(others[j[s:e]])
        return pd.DataFrame({"u": x["id"] if near_w else [], "w": near_w, "v": near_v})

    # One row for each point and block of others.
    out = _pairs_of_blocks(left.select("id", "v"), right.select("id", "v"), block_rows).applyInPandas(product, "u long, w array<double>, v array<long>")
    out = out.select("u", F.arrays_zip("w", "v").alias("near"))
    best = out.groupBy("u").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("u", F.posexplode("near").alias("at", "x")).select("u", "x.v", "x.w", (F.col("at") + 1).alias("place"))


def core_distances(own: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(id, core, miss): the distance within which a point has ``least`` other rows, the farthest known if fewer; and the distance from which on its list may miss points."""
    n = own.count()
    counted = lists.join(own.select(F.col("id").alias("v"), "copies"), "v")
    upto_here = F.sum("copies").over(Window.partitionBy("u").orderBy("w", "v").rowsBetween(Window.unboundedPreceding, 0))
    held = counted.withColumn("rows", upto_here).join(own.select(F.col("id").alias("u"), F.col("copies").alias("mine")), "u")
    reached = F.min(F.when(F.col("rows") + F.col("mine") - 1 >= least, F.col("w")))
    each = held.groupBy("u").agg(F.coalesce(reached, F.max("w")).alias("near"), F.max("w").alias("far"), F.count("*").alias("listed"))
    joined = own.select("id", "copies").join(each.withColumnRenamed("u", "id"), "id", "left")
    core = F.when(F.col("copies") > least, 0.0).otherwise(F.coalesce("near", F.lit(0.0)))
    miss = F.when(F.coalesce("listed", F.lit(0)) >= n - 1, float("inf")).otherwise(F.greatest(core, "far"))
    return joined.select("id", core.alias("core"), miss.alias("miss"))


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): of every node (id) the smallest one that links (a, b) reach.

    Each node takes the smallest label of its neighbours, then the label of the node that label names,
    until none changes; every round is written, so that plans stay short.
    """
    both = _kept(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = nodes.select("id", F.col("id").alias("root"))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        near = labels.join(seen, "id", "left").select("id", F.least("root", F.coalesce("low", "root")).alias("near"), (F.col("low") < F.col("root")).alias("moved"))
        further = near.groupBy(F.col("id").alias("near")).agg(F.min("near").alias("root"))
        new = _kept(near.join(further, "near").select("id", "root", "moved"))
        labels = new.select("id", "root")
        if not new.filter("moved").head(1):
            return labels


def reachability_tree(own: DataFrame, lists: DataFrame, cores: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v, w): a spanning tree of least mutual reachability, the largest of the distance and both core distances; exact."""
    core = cores.select("id", "core")
    edges = lists.join(core.toDF("u", "cu"), "u").join(core.toDF("v", "cv"), "v").select("u", "v", F.greatest("w", "cu", "cv").alias("w"))
    labels = _kept(cores.select("id", F.col("id").alias("comp"), "core", "miss"))
    tree: list[DataFrame] = []
    while True:
        at = labels.select("id", "comp")
        edges = _kept(edges.join(at.toDF("u", "x"), "u").join(at.toDF("v", "y"), "v").filter("x <> y"))
        ends = [F.col("w"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
        both = edges.select(F.col("x").alias("comp"), F.col("y").alias("other"), *ends).union(edges.select("y", "x", *ends))
        best = both.groupBy("comp").agg(F.min(F.struct("w", "u", "v", "other")).alias("best"))
        comps = _kept(labels.groupBy("comp").agg(F.min("miss").alias("miss"), F.count("*").alias("size")).join(best, "comp", "left"))
        sure = F.coalesce(F.col("best.w") <= F.col("miss"), F.lit(False))
        n, n_sure, largest = comps.agg(F.count("*"), F.count(F.when(sure, 1)), F.max(F.struct("size", "comp"))).first()
        if n <= 1:
            break
        if 2 * n_sure < n:
            asked = labels.join(comps.filter(~sure & (F.col("comp") != largest["comp"])).select("comp", F.col("best.w").alias("most")), "comp")
            asked = asked.filter(F.col("most").isNull() | (F.col("miss") < F.col("most")))
            found = _kept(_nearest_outside(asked.join(own.select("id", "v"), "id"), labels.join(own.select("id", "v"), "id"), block_rows))
            seen = found.select(F.col("u").alias("id"), F.col("w").alias("now"))
            labels = _kept(labels.join(seen, "id", "left").select("id", "comp", "core", F.greatest("miss", F.coalesce("now", "miss")).alias("miss")))
            edges = edges.select("u", "v", "w").unionByName(found)
            continue
        picks = _kept(comps.filter(sure).select("comp", "best.*"))
        tree.append(picks.select("u", "v", "w").distinct())
        roots = connected(comps.select(F.col("comp").alias("id")), picks.select(F.col("comp").alias("a"), F.col("other").alias("b")))
        labels = _kept(labels.join(roots.toDF("comp", "root"), "comp").select("id", F.col("root").alias("comp"), "core", "miss"))
        edges = edges.select("u", "v", "w")
    out = own.sparkSession.createDataFrame([], _EDGE)
    for part in tree:
        out = out.unionByName(part)
    return out


def _nearest_outside(asked: DataFrame, all_: DataFrame, block_rows: int) -> DataFrame:
    """(u, v, w): of each asked point the point of another component nearest by mutual reachability."""

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"u": [], "v": [], "w": []})
        q, core, comp, found = np.array(y["v"].tolist()), y["core"].to_numpy(), y["comp"].to_numpy(), []
        step = max(1, HELD // len(q))
        for at in range(0, len(x), step):
            own = x.iloc[at : at + step]
            p, mine = np.array(own["v"].tolist()), own["core"].to_numpy()
            w = np.maximum(np.maximum(np.sqrt(_squares(p, q)), mine[:, None]), core[None, :])
            w[own["comp"].to_numpy()[:, None] == comp[None, :]] = np.inf
            j = w.argmin(1)
            i = np.flatnonzero(np.isfinite(w[np.arange(len(j)), j]))
            j = j[i]
            exact = np.maximum(np.maximum(_distance(p[i], q[j]), mine[i]), core[j])
            found.append(pd.DataFrame({"u": own["id"].to_numpy()[i], "v": y["id"].to_numpy()[j], "w": exact}))
        return pd.concat(found)

    columns = ["id", "v", "core", "comp"]
    out = _pairs_of_blocks(asked.select(*columns), all_.select(*columns), block_rows).applyInPandas(product, _EDGE)
    return out.groupBy("u").agg(F.min(F.struct("w", "v")).alias("m")).select("u", "m.v", "m.w")


class _Piece:
    """A component while a range is united: its rows, its cluster if it has one, and what that cluster has gathered."""

    def __init__(self, name: int, size: int, cluster: str | None, mass: float, below: float):
        self.size, self.cluster, self.mass, self.below = size, cluster, mass, below
        self.small = [name] if cluster is None else []  # components of the range's start that no cluster holds yet


_STATE = "comp long, size long, cluster string, mass double, below double"
_STEP = "kind string, comp long, root long, cluster string, parent string, size long, mass double, below double, density double, chosen boolean"


def unite(edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """Unites the components of a range, in order of its edges.

    Rows of three kinds: ``moved`` names the new root of each old component, and the cluster it falls into, if
    it had none, at which density; ``state`` is what remains of each root; ``closed`` is a cluster that another met, its parent, its
    stability and whether it beats the best of what lies below it.
    """
    pieces: dict[int, _Piece] = {}
    up: dict[int, int] = {}
    out: list[tuple] = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for side in ("x", "y"):
        names = [f"{c}_{side}" for c in ("comp", "size", "cluster", "mass", "below")]
        for comp, size, cluster, mass, below in edges[names].drop_duplicates(names[0]).itertuples(index=False, name=None):
            pieces[comp], up[comp] = _Piece(comp, size, cluster if isinstance(cluster, str) else None, mass, below), comp
    held: dict[int, tuple[str, float]] = {}
    for rank, w, x, y in edges.sort_values("rank")[["rank", "w", "comp_x", "comp_y"]].itertuples(index=False, name=None):
        x, y = find(x), find(y)
        if x == y:
            continue
        density, a, b = 1 / max(w, LEAST), pieces[x], pieces[y]
        if a.cluster is None or (b.cluster is not None and y < x):
            x, y, a, b = y, x, b, a
        size, name = a.size + b.size, f"e{rank}"
        if a.cluster and b.cluster:
            below = 0.0
            for c in (a, b):
                stability = c.mass - c.size * density
                out.append(("closed", None, None, c.cluster, name, c.size, stability, c.below, density, stability >= c.below))
                below += max(stability, c.below)
            a.cluster, a.mass, a.below = name, size * density, below
        elif a.cluster:
            a.mass += b.size * density
            held.update((n, (a.cluster, density)) for n in b.small)
        elif size >= min_size:
            a.cluster, a.mass, a.below = name, size * density, 0.0
            held.update((n, (name, density)) for n in a.small + b.small)
            a.small = []
        else:
            a.small = a.small + b.small
        a.size, up[y] = size, x
    for n in up:
        cluster, density = held.get(n, (None, None))
        out.append(("moved", n, find(n), cluster, None, None, None, None, density, None))
    for n, p in pieces.items():
        if up[n] == n:
            out.append(("state", n, n, p.cluster, None, p.size, p.mass, p.below, None, None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")])


def condensed(own: DataFrame, cores: DataFrame, tree: DataFrame, min_size: int, range_edges: int = RANGE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, density): the cluster into which each point falls first, and the clusters (cluster, parent, size, stability, chosen, density).

    A cluster begins where a component reaches ``min_size`` rows or where two clusters meet, and ends where it meets
    another; the one that holds all rows never ends and is not among the clusters.
    """
    ranked = upto(tree, [], ["w", "u", "v"], "rank")
    ranked = _kept(ranked.withColumn("range", F.expr(f"(rank - 1) div {range_edges}")))
    ranges = -(-ranked.count() // range_edges)
    rows = own.select("id", "copies").join(cores.select("id", "core"), "id")
    full, density = F.col("copies") >= min_size, 1 / F.greatest("core", F.lit(LEAST))
    first = F.when(full, F.concat(F.lit("p"), F.col("id").cast("string")))
    state = _kept(rows.select(F.col("id").alias("comp"), F.col("copies").alias("size"), first.alias("cluster"), F.when(full, F.col("copies") * density).otherwise(0.0).alias("mass"), F.lit(0.0).alias("below")))
    members = _kept(rows.select("id", F.col("id").alias("comp"), first.alias("cluster"), F.when(full, density).alias("density")))
    closed = own.sparkSession.createDataFrame([], _STEP)
    for r in range(ranges):
        part = ranked.filter(F.col("range") == r).select("rank", "u", "v", "w")
        # What is broadcast here has at most two rows for each edge of a range.
        touched = F.broadcast(part.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        at = _kept(members.select("id", "comp").join(touched, "id"))
        told = at.join(state, "comp") if r else at.join(state.withColumnRenamed("comp", "id"), "id")
        told = _kept(told.select("id", *[c.split()[0] for c in _STATE.split(", ")]))
        sides = [told.toDF(side, *[f"{c}_{n}" for c in told.columns[1:]]) for side, n in (("u", "x"), ("v", "y"))]
        joined = part.join(sides[0], "u").join(sides[1], "v").withColumn("one", F.lit(1))
        step = _kept(joined.groupBy("one").applyInPandas(lambda e: unite(e, min_size), _STEP))
        moved = F.broadcast(step.filter("kind = 'moved'").select("comp", "root", F.col("cluster").alias("into"), F.col("density").alias("when")))
        new = members.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"), F.coalesce("cluster", "into").alias("cluster"), F.coalesce("density", "when").alias("density"))
        left = state.join(moved.select("comp"), "comp", "left_anti")
        members, state = _kept(new), _kept(left.unionByName(step.filter("kind = 'state'").select(*state.columns)))
        closed = closed.unionByName(step.filter("kind = 'closed'"))
    return members.select("id", "cluster", "density"), closed.select("cluster", "parent", "size", F.col("mass").alias("stability"), "chosen", "density")


def outermost(clusters: DataFrame) -> DataFrame:
    """(cluster, top): of every cluster the outermost chosen one that holds it, null if none; in rounds of doubled steps."""
    now = _kept(clusters.select("cluster", F.col("parent").alias("jump"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    while now.filter("jump IS NOT NULL").head(1):
        over = now.select(F.col("cluster").alias("jump"), F.col("jump").alias("next"), F.col("top").alias("above"))
        now = _kept(now.join(over, "jump", "left").select("cluster", F.col("next").alias("jump"), F.coalesce("above", "top").alias("top")))
    return now.select("cluster", "top")


def hdbscan(df: DataFrame, key: str, vector: str | Column, min_cluster_size: int = 15, min_samples: int | None = None, listed: int | None = None,
            block_rows: int = BLOCK_ROWS, range_edges: int = RANGE_EDGES) -> DataFrame:
    """key, cluster, density of every row with a vector: the chosen clusters by their smallest key, -1 for noise; Euclidean distances.

    ``density`` is one over the distance at which the row joins a cluster of ``min_cluster_size`` rows; null where none ever forms. ``listed``
    neighbours of each point are kept, twice ``min_samples`` unless said otherwise; more make searches rarer.
    The cluster of all rows is never chosen.
    """
    least = min_samples or min_cluster_size
    own, rows = points(df, key, vector)
    lists = _kept(nearest_points(own, own, max(listed or 2 * least, least), block_rows).select("u", "v", "w"))
    cores = _kept(core_distances(own, lists, least))
    tree = _kept(reachability_tree(own, lists, cores, block_rows))
    members, clusters = condensed(own, cores, tree, min_cluster_size, range_edges)
    placed = members.join(outermost(clusters), "cluster", "left").select("id", "top", "density")
    each = _kept(rows.join(placed, "id").select("key", "top", "density"))
    names = each.filter("top IS NOT NULL").groupBy("top").agg(F.min("key").alias("name"))
    return each.join(names, "top", "left").select(F.col("key").alias(key), F.coalesce("name", F.lit(-1)).alias("cluster"), "density")
