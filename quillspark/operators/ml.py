"""Class frames, cross-validated classifiers, importances and leaderboards over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import shared_hash, stratified_folds, stratified_split, upto


def class_frame(metrics: DataFrame, key: str, positive: Sequence[str], negative: Sequence[str], excluded: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Long metrics (key, source, metric, value) as one row per text with a label; features sorted by name, rows complete."""
    long = metrics.filter(F.col("source").isin(*positive, *negative) & ~F.col("metric").isin(*excluded, "sentiment_label"))
    names = sorted(r[0] for r in long.select("metric").distinct().collect())
    wide = long.groupBy(key, "source").pivot("metric", names).agg(F.first("value"))
    return wide.na.drop(subset=names).withColumn("label", F.col("source").isin(*positive).cast("int")), names


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes x class size) of each row."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def learner(kind: str, seed: int = 42):
    if kind == "gbt":
        return GBTClassifier(seed=seed, maxIter=15, maxDepth=3)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, numTrees=20, maxDepth=5)
    return LogisticRegression(weightCol="weight", maxIter=100, regParam=0.01)


def cross_validated(df: DataFrame, features: Sequence[str], key: str, kind: str = "logistic", folds: int = 5, grid: dict[str, Sequence] | None = None):
    """The best model of a grid by mean ROC area over folds dealt by the shared hash; (model, mean area)."""
    rows = stratified_folds(balanced_weights(df), "label", key, folds).withColumn("fold", F.col("fold").cast("int"))
    est = learner(kind)
    maps = ParamGridBuilder()
    for name, values in (grid or {}).items():
        maps = maps.addGrid(est.getParam(name), list(values))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), est])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps.build(), evaluator=BinaryClassificationEvaluator(), foldCol="fold", numFolds=folds)
    fitted = cv.fit(rows)
    return fitted.bestModel, max(fitted.avgMetrics)


def train_and_score(df: DataFrame, features: Sequence[str], key: str, kind: str = "logistic", test_share: float = 0.2) -> DataFrame:
    """Held-out rows with score (probability of class 1) and predicted."""
    rows = stratified_split(balanced_weights(df), "label", key, test_share)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learner(kind)])
    out = pipe.fit(rows.filter(~F.col("is_test"))).transform(rows.filter("is_test"))
    return out.select(key, "label", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))


def leaderboard(df: DataFrame, features: Sequence[str], key: str, kind: str = "gbt", rows: int = 50) -> DataFrame:
    """The rows that a model fitted on all of them takes most surely for class 1."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learner(kind)])
    w = balanced_weights(df)
    out = pipe.fit(w).transform(w).select(key, vector_to_array("probability")[1].alias("p"), *features)
    return out.orderBy(F.col("p").desc(), key).limit(rows).withColumn("distinction_score", F.bround("p", 4)).drop("p")


def permutation_importance(df: DataFrame, model, features: Sequence[str], key: str) -> dict[str, float]:
    """Loss of ROC area when one feature takes another row's value (rows paired in hash order within 64 groups)."""
    judge = BinaryClassificationEvaluator()
    base = judge.evaluate(model.transform(df))
    w = Window.partitionBy(F.pmod(shared_hash(key, 1), F.lit(64))).orderBy(shared_hash(key, 2), key)
    return {f: base - judge.evaluate(model.transform(df.withColumn(f, F.coalesce(F.lag(f).over(w), F.col(f))))) for f in features}


def regression_importances(df: DataFrame, features: Sequence[str], target: str) -> list[tuple[str, float]]:
    """Gain importances of a boosted regressor of the target."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), GBTRegressor(labelCol=target, seed=42, maxIter=10, maxDepth=3)])
    gains = pipe.fit(df).stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, gains)), key=lambda x: -x[1])


#: Tasks (name, positive groups, negative groups) and the metrics that a variant leaves out.
TASKS = (
    ("GSQ_vs_GBLM", ("GSQ",), ("GBLM",)), ("GPQ_vs_GSQ", ("GPQ",), ("GSQ",)), ("GSQ_vs_NLB", ("GSQ",), ("NLB",)),
    ("T50Q_vs_T50LM", ("T50Q",), ("T50LM",)), ("GSQ_vs_T50Q", ("GSQ",), ("T50Q",)),
)
SENTIMENT = ("sentiment_polarity", "sentiment_pos", "sentiment_neu", "sentiment_neg", "sentiment_label")
VARIANTS = (("pmi",), ("pmi", *SENTIMENT), ("pmi", "swd", "mtld"))
#: The 243 points of the boosted-tree search, by this library's parameter names.
BOOSTED_GRID = {
    "maxIter": (100, 250, 400), "maxDepth": (3, 5, 7), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.8, 0.9, 1.0), "featureSubsetStrategy": ("0.8", "0.9", "1.0"),
}


def experiments() -> list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]]:
    """(name, positive groups, negative groups, metrics left out): every task in every variant, and the pooled task without sentiment."""
    names = ("no_pmi", "no_pmi_no_sentiment", "no_pmi_no_length")
    out = [(f"{n}_{told}", p, q, v) for told, v in zip(names, VARIANTS) for n, p, q in TASKS]
    return [*out, ("pooled_no_pmi_no_sentiment", ("GSQ", "GPQ", "T50Q"), ("T50LM", "GBLM", "NLB"), VARIANTS[1])]


def run_experiments(metrics: DataFrame, key: str, kind: str = "logistic", plan=None) -> DataFrame:
    """One row per experiment: task, excluded, held-out rows, ROC area, accuracy and macro F1, best area first.

    ``metrics`` is long (key, source, metric, value) and should be written already, as every experiment reads it.
    """
    rows = []
    for name, positive, negative, excluded in plan or experiments():
        frame, features = class_frame(metrics, key, positive, negative, excluded)
        scored = train_and_score(frame, features, key, kind)
        rows.append(quality(scored).select(F.lit(name).alias("task"), F.lit(",".join(excluded)).alias("excluded"), "*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.col("auc").desc_nulls_last(), "task")


def quality(scored: DataFrame) -> DataFrame:
    """n, auc, accuracy and macro_f1 of (label, score, predicted) in one row; the area is U over the pairs, from counts of distinct scores."""
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    cells = scored.groupBy("score").agg(ones.alias("a"), zeros.alias("b"), F.count_if((F.col("label") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("label") == 0) & (F.col("predicted") == 1)).alias("fp"))
    summed = upto(cells, [], ["score"], "upto", value="b")
    s = summed.withColumn("u", F.col("a") * (F.col("upto") - F.col("b") / 2)).agg(*[F.sum(c).cast("double").alias(c) for c in ("a", "b", "tp", "fp", "u")])
    f1 = 2 * F.col("tp") / (F.col("a") + F.col("tp") + F.col("fp"))
    tn, fn = F.col("b") - F.col("fp"), F.col("a") - F.col("tp")
    f0 = 2 * tn / (F.col("b") + tn + fn)
    return s.select((F.col("a") + F.col("b")).cast("bigint").alias("n"), F.try_divide("u", F.col("a") * F.col("b")).alias("auc"), ((F.col("tp") + tn) / (F.col("a") + F.col("b"))).alias("accuracy"), ((f0 + f1) / 2).alias("macro_f1"))
