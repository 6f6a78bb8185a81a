"""Additive attributions of tree ensembles, and the surest right and wrong rows of a classifier.

A row's attribution to a feature is its Shapley value where unknown features follow the training rows down a tree in
proportion to their cover. A leaf's value is shared among the features on its way: with z the share of rows that
a feature's splits let through and o one or zero as the row itself passes, the sums over all orders are the coefficients of the
product of (z + o t), so a leaf of d features costs about d cubed and no subsets are listed. Trees are small and sent to the tasks;
rows stay where they are and are added up many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import top_per_group


@dataclass(frozen=True)
class Leaf:
    """Value, share of the training rows, and for each feature on the way (feature, over, up to, share let through)."""

    value: float
    cover: float
    way: tuple[tuple[int, float, float, float], ...]


def leaves(root, weight: float, positive: int | None = None) -> list[Leaf]:
    """The leaves of a fitted tree; ``positive`` names the class whose share is the value, where a leaf holds classes."""
    out: list[Leaf] = []

    def value(node) -> float:
        if positive is None:
            return float(node.prediction())
        stats = list(node.impurityStats().stats())
        return float(stats[positive] / sum(stats))

    def walk(node, cover: float, way: dict) -> None:
        if node.subtreeDepth() == 0:
            out.append(Leaf(weight * value(node), cover, tuple((f, *x) for f, x in sorted(way.items()))))
            return
        split, total = node.split(), float(node.impurityStats().count())
        f, cut = int(split.featureIndex()), float(split.threshold())
        over, upto, share = way.get(f, (-math.inf, math.inf, 1.0))
        for child, edge in ((node.leftChild(), (over, min(upto, cut))), (node.rightChild(), (max(over, cut), upto))):
            part = float(child.impurityStats().count()) / total
            walk(child, cover * part, way | {f: (*edge, share * part)})

    walk(root, 1.0, {})
    return out


def ensemble(model) -> list[Leaf]:
    """All leaves of a fitted tree, boosted or bagged model; their values add up to its margin, prediction or probability of class 1."""
    if not hasattr(model, "trees"):
        return leaves(model._java_obj.rootNode(), 1.0, 1 if hasattr(model, "numClasses") else None)
    bagged = "RandomForest" in type(model).__name__
    weights = [1 / len(model.trees)] * len(model.trees) if bagged else list(model.treeWeights)
    positive = 1 if bagged and hasattr(model, "numClasses") else None
    return [leaf for tree, w in zip(model.trees, weights) for leaf in leaves(tree._java_obj.rootNode(), float(w), positive)]


def shapley(x: np.ndarray, forest: Sequence[Leaf]) -> np.ndarray:
    """Attributions (rows x features) of the ensemble's value beyond its mean over the training rows."""
    out = np.zeros(x.shape)
    for leaf in forest:
        d = len(leaf.way)
        passes = [((x[:, f] > over) & (x[:, f] <= upto)).astype(float) for f, over, upto, _ in leaf.way]
        weights = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i, (f, _, _, share) in enumerate(leaf.way):
            terms = np.zeros((d, len(x)))
            terms[0] = 1.0
            for j, (_, _, _, z) in enumerate(leaf.way):
                if j != i:
                    terms[1:] = terms[1:] * z + terms[:-1] * passes[j]
                    terms[0] *= z
            out[:, f] += leaf.value * (passes[i] - share) * np.tensordot(weights, terms, 1)
    return out


def base_value(forest: Sequence[Leaf]) -> float:
    return sum(leaf.value * leaf.cover for leaf in forest)


def attributions(df: DataFrame, model, features: Sequence[str], key: str) -> DataFrame:
    """key, base, total and a column phi_<feature> for every row; base and the phis add up to total, the model's value. Rows lacking a feature are left out."""
    forest = df.sparkSession.sparkContext.broadcast(ensemble(model))
    known = df.select(F.col(key), *[F.col(f).cast("double").alias(f"phi_{f}") for f in features]).na.drop(subset=[f"phi_{f}" for f in features])
    names, kind = known.columns[1:], known.schema[0].dataType.simpleString()

    def run(batches):
        base = base_value(forest.value)
        for b in batches:
            phi = shapley(b[names].to_numpy(float), forest.value)
            yield pd.concat([b[[key]], pd.DataFrame({"base": base, "total": base + phi.sum(1)}, index=b.index), pd.DataFrame(phi, columns=names, index=b.index)], axis=1)

    return known.mapInPandas(run, f"`{key}` {kind}, base double, total double, " + ", ".join(f"`{n}` double" for n in names))


def mean_attributions(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, mean): how much each feature moves the value, and which way, largest first."""
    sums = df.agg(*[x for f in features for x in (F.avg(F.abs(f"phi_{f}")).alias(f"a_{f}"), F.avg(f"phi_{f}").alias(f"m_{f}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("mean_abs"), F.col(f"m_{f}").alias("mean")) for f in features]))
    return sums.select(rows.alias("r")).select("r.*").orderBy(F.col("mean_abs").desc(), "feature")


def surest_rows(scored: DataFrame, label: str, predicted: str, sure: str, key: str, k: int = 3) -> DataFrame:
    """Of every class the k rows that were told right, and the k told wrong, with the largest certainty; rows of unknown class, prediction or certainty are left out."""
    known = scored.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull() & F.col(sure).isNotNull())
    return top_per_group(known.withColumn("correct", F.col(label) == F.col(predicted)), [label, "correct"], [F.col(sure).desc(), key], k, "place")
