"""Statistics, vectors, journeys, matching, models, files and streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as tk
from ..operators import entities as en
from ..operators import journeys as jo
from ..operators import matching as ma
from ..operators import pairs as pr
from ..operators import stats as st
from ..operators import vectors as ve
from ..operators import windows as wn
from ..operators.intervals import delta_interval
from ..sources import files as fi
from .registry import PLANS, Tables, plan
from .relational import h_sql


def _labelled(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    return d.withColumn("side", F.when(F.col("quality") == 1, 1).otherwise(2))


_RANKED = """WITH d AS (SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)),
  r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rk FROM d),
  s AS (SELECT lang, count(*) FILTER (quality = 1)::DOUBLE AS n1, count(*) FILTER (quality = 0)::DOUBLE AS n2, avg(n_chars) FILTER (quality = 1) AS mean1, avg(n_chars) FILTER (quality = 0) AS mean2,
    sum(rk) FILTER (quality = 1) AS r1 FROM r GROUP BY 1),
  t AS (SELECT lang, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT lang, n_chars, count(*) AS c FROM d GROUP BY ALL) GROUP BY 1),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s JOIN t USING (lang) WHERE n1 > 0 AND n2 > 0)"""


@plan("SI1 SI2", _RANKED + """ SELECT lang, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, u, round(2 * u / (n1 * n2) - 1, 8) AS delta,
  round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney_by_lang(spark, sf_dir):
    m = st.mann_whitney(_labelled(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "side", ["lang"])
    return m.select("lang", "n1", "n2", F.round("mean1", 6).alias("mean1"), F.round("mean2", 6).alias("mean2"), "u", F.round("delta", 8).alias("delta"), F.round("z", 6).alias("z"))


def _grouped_metrics(spark, sf_dir):
    """Two metrics of the documents, dealt to the six groups of texts by the shared hash: row_id, source, metric, value."""
    d = Tables(spark, sf_dir).documents
    names = F.array(*[F.lit(x) for x in ("GSQ", "GPQ", "T50Q", "GBLM", "T50LM", "NLB")])
    long = d.select(
        F.col("doc_id").alias("row_id"), F.get(names, F.pmod(wn.shared_hash("doc_id"), F.lit(6)).cast("int")).alias("source"),
        F.explode(F.array(F.struct(F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("value")), F.struct(F.lit("words").alias("metric"), tk.n_words(F.col("text")).cast("double").alias("value")))).alias("m"),
    ).select("row_id", "source", "m.*")
    return long


_PLAN = [*((n, a, b) for n, a, b in st.COMPARISONS), st.POOLED]
_SIDES = ", ".join(f"('{n}', '{g}', {k})" for n, a, b in _PLAN for k, groups in ((1, a), (2, b)) for g in ([groups] if isinstance(groups, str) else groups))


@plan("SI1 SI2 SI5", f"""WITH d AS (SELECT ['GSQ', 'GPQ', 'T50Q', 'GBLM', 'T50LM', 'NLB'][CAST(CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) % 6 AS INT) + 1] AS source,
    CAST(n_chars AS DOUBLE) AS chars, CAST(len({tk.split_words_sql('text')}) AS DOUBLE) AS words FROM documents),
  m AS (SELECT source, 'chars' AS metric, chars AS value FROM d UNION ALL SELECT source, 'words', words FROM d), p(comparison, source, side) AS (VALUES {_SIDES}),
  f AS (SELECT metric, comparison, side, value, rank() OVER w + (count(*) OVER (PARTITION BY metric, comparison, value) - 1) / 2.0 AS rk FROM m JOIN p USING (source) WINDOW w AS (PARTITION BY metric, comparison ORDER BY value)),
  s AS (SELECT metric, comparison, count(*) FILTER (side = 1)::DOUBLE AS n1, count(*) FILTER (side = 2)::DOUBLE AS n2, avg(value) FILTER (side = 1) AS mean1, avg(value) FILTER (side = 2) AS mean2, sum(rk) FILTER (side = 1) AS r1 FROM f GROUP BY ALL),
  t AS (SELECT metric, comparison, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT metric, comparison, value, count(*) AS c FROM f GROUP BY ALL) GROUP BY ALL),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s JOIN t USING (metric, comparison) WHERE n1 > 0 AND n2 > 0)
  SELECT metric, comparison, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(2 * u / (n1 * n2) - 1, 8) AS delta,
    round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""")
def group_comparisons(spark, sf_dir):
    """Effect and z of every planned comparison of two metrics."""
    tested = st.mann_whitney(st.comparison_rows(_grouped_metrics(spark, sf_dir), _PLAN), "value", "side", ["metric", "comparison"])
    return tested.select("metric", "comparison", "n1", "n2", F.round("mean1", 6).alias("mean1"), F.round("mean2", 6).alias("mean2"), F.round("delta", 8).alias("delta"), F.round("z", 6).alias("z"))


@plan("SI1 SI4 SI5 SI9")
def group_comparison_report(spark, sf_dir):
    """All comparisons of two metrics over six groups, p-values adjusted in one family, effects with stars."""
    from ..functions.metrics import stars

    long = _grouped_metrics(spark, sf_dir)
    tested = st.mann_whitney(st.comparison_rows(long, _PLAN), "value", "side", ["metric", "comparison"])
    done = wn.benjamini_hochberg(tested, "p", "comparison")
    return done.select(
        "metric", "comparison", F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"), F.round("delta", 6).alias("delta"), F.round("p", 8).alias("p"),
        F.round("p_adjusted", 8).alias("p_adjusted"), (F.col("p_adjusted") < 0.05).alias("significant"), F.concat(F.format_string("%+.2f", "delta"), stars(F.col("p_adjusted"))).alias("shown"),
    )


@plan("SI2", """WITH d AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id))
  SELECT round((count(*) FILTER (a.n_chars > b.n_chars) - count(*) FILTER (a.n_chars < b.n_chars))::DOUBLE / count(*), 8) AS delta FROM (SELECT * FROM d WHERE quality = 1) a, (SELECT * FROM d WHERE quality = 0) b""")
def cliffs_delta(spark, sf_dir):
    """By ranks; the twin compares all pairs."""
    d = _labelled(spark, sf_dir).withColumns({"all": F.lit(1), "n_chars": F.col("n_chars").cast("double")})
    return st.mann_whitney(d, "n_chars", "side", ["all"]).select(F.round("delta", 8).alias("delta"))


@plan("SI3")
def bootstrap_interval(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("all", F.lit(1))
    return delta_interval(d, "n_chars", "side", ["all"], replicates=2000).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plan("SI6 WN2", """WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a,
  rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events)
  SELECT event_type, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    s = st.spearman(Tables(spark, sf_dir).events, "value", "user_id", "event_id", ["event_type"])
    return s.select("event_type", F.round("rho", 6).alias("rho"), "n")


@plan("SI7 SI10 MT9", """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY 1""")
def pearson_and_line(spark, sf_dir):
    c = st.correlations(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return c.select("l_returnflag", F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@plan("ML6 SI1 TK8", """WITH d AS (SELECT doc_id, n_chars, toxic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT count(*) FILTER (toxic = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (toxic = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (toxic = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (toxic = 1 AND p = 0)::DOUBLE AS fn FROM d),
  a AS (SELECT avg(CASE WHEN x.n_chars > y.n_chars THEN 1.0 WHEN x.n_chars = y.n_chars THEN 0.5 ELSE 0 END) AS auc FROM (SELECT * FROM d WHERE toxic = 1) x, (SELECT * FROM d WHERE toxic = 0) y)
  SELECT round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 8) AS macro_f1, round(auc, 8) AS auc FROM c, a""")
def binary_quality(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumns({"all": F.lit(1), "p": (F.col("n_chars") > 1500).cast("int")})
    q = st.binary_quality(d, "toxic", "p", ["all"]).join(st.auc(d, "toxic", "n_chars", ["all"]), "all")
    return q.select(*[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "macro_f1", "auc")])


@plan("ML6", """WITH d AS (SELECT n_chars, toxic FROM documents JOIN labels USING (doc_id))
  SELECT n_chars, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 8) AS fpr FROM (SELECT n_chars, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM d GROUP BY 1)
  WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark, sf_dir):
    r = st.roc_points(_labelled(spark, sf_dir).withColumn("all", F.lit(1)), "toxic", "n_chars", ["all"])
    return r.select("n_chars", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


# --- vectors ---

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@plan("JN12 FN4", f"""SELECT id, other, round(s, 6) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS other, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rn
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rn = 1""")
def nearest_neighbour(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return ve.nearest(e, e, "vec_id", "embedding", same=True).withColumn("similarity", F.round("similarity", 6))


@plan("EM1 JN12", f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT a.vec_id FROM embeddings a, embeddings b WHERE a.vec_id > b.vec_id AND {_COS} >= 0.42)")
def embedding_dedupe(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id").join(ve.duplicate_rows(e, "vec_id", "embedding", 0.42), "vec_id", "left_anti")


@plan("JN13", f"SELECT a.vec_id AS id, round(min(1 - {_COS}), 6) AS distance FROM (SELECT * FROM embeddings WHERE label < 5) a, (SELECT * FROM embeddings WHERE label >= 5) b GROUP BY 1")
def distance_to_set(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    n = ve.nearest(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding")
    return n.select("id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@plan("JN14 MT18", f"SELECT a.vec_id, round(avg(1 - {_COS}), 6) AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE label = 0) b GROUP BY 1")
def originality(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return ve.mean_distance_to(e, "embedding", e.filter("label = 0")).select("vec_id", F.round("distance", 6).alias("distance"))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


@plan("AG12 EM3", """SELECT label, pos - 1 AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""")
def class_centroids(spark, sf_dir):
    c = ve.centroids(Tables(spark, sf_dir).embeddings, "embedding", ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@plan("AG18 EM3 MT22", f"SELECT a.label, round(avg(1 - {_COS}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def dispersion(spark, sf_dir):
    d = ve.mean_pairwise_distance(Tables(spark, sf_dir).embeddings, "embedding", ["label"])
    return d.select("label", F.round("distance", 6).alias("distance"))


@plan("MT25 MT22 TK7 EM10", """WITH c AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label = 1) GROUP BY 1),
  v AS (SELECT list(x ORDER BY pos) AS c FROM c), d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], v.c) AS d FROM embeddings, v),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rn FROM d) SELECT label, vec_id, round(d, 6) AS distance, rn FROM r WHERE rn <= 5""")
def nearest_to_centroid(spark, sf_dir):
    """Per class the five vectors nearest to the centroid of class 1."""
    from ..functions.metrics import cosine

    e = Tables(spark, sf_dir).embeddings
    c = ve.centroids(e.filter("label = 1").withColumn("one", F.lit(1)), "embedding", ["one"]).select("centroid")
    d = e.join(F.broadcast(c)).withColumn("distance", 1 - cosine(F.col("embedding"), F.col("centroid")))
    return wn.top_per_group(d, ["label"], ["distance", "vec_id"], 5).select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rn").cast("bigint").alias("rn"))


@plan("EM3", f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings),
  p AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(1 - list_dot_product(a.u, b.u)) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
  s AS (SELECT vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM p GROUP BY 1)
  SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s""")
def silhouettes(spark, sf_dir):
    s = ve.silhouettes(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", "label")
    return s.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@plan("EM2 JN13 SI1")
def outlier_test(spark, sf_dir):
    """Are vectors of one class nearer to each other than to the rest? Both distances per vector, U and delta."""
    e = Tables(spark, sf_dir).embeddings
    a, b = e.filter("label < 5"), e.filter("label >= 5")
    inter = ve.nearest(a, b, "vec_id", "embedding").select((1 - F.col("similarity")).alias("d"), F.lit(1).alias("side"))
    intra = ve.nearest(a, a, "vec_id", "embedding", same=True).select((1 - F.col("similarity")).alias("d"), F.lit(2).alias("side"))
    both = inter.unionByName(intra).withColumn("all", F.lit(1))
    return st.mann_whitney(both, "d", "side", ["all"], "greater").select("n1", "n2", "u", F.round("delta", 6).alias("delta"), F.round("p", 8).alias("p"))


@plan("EM4 SRC10", r"""WITH r AS (SELECT doc_id, 'Accuracy (95% CI): 0.' || (50 + doc_id % 40) || ' AUC (CI): 0.' || (60 + doc_id % 30) || chr(10) || 'Silhouette Score: -0.1' || chr(10) || 'Cliff''s Delta = x: ' || '-0.5' AS t FROM documents)
  SELECT doc_id, TRY_CAST(regexp_extract(t, 'Accuracy[^:]*:\s*([0-9.]+)', 1) AS DOUBLE) AS accuracy, TRY_CAST(regexp_extract(t, 'AUC[^:]*:\s*([0-9.]+)', 1) AS DOUBLE) AS auc,
  TRY_CAST(regexp_extract(t, 'Silhouette[^:]*:\s*(-?[0-9.]+)', 1) AS DOUBLE) AS silhouette, -0.5::DOUBLE AS mean_delta FROM r""")
def report_scan(spark, sf_dir):
    n = F.col("doc_id")
    t = F.concat(F.lit("Accuracy (95% CI): 0."), (50 + n % 40).cast("string"), F.lit(" AUC (CI): 0."), (60 + n % 30).cast("string"), F.lit("\nSilhouette Score: -0.1\nCliff's Delta = x: -0.5"))
    d = Tables(spark, sf_dir).documents.select("doc_id", t.alias("t"))
    return d.select("doc_id", *[c.alias(k) for k, c in fi.report_figures(F.col("t")).items()])


@plan("EM8", """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  c AS (SELECT label, pos, avg(x) AS c FROM v GROUP BY ALL), m AS (SELECT pos, avg(x) AS m FROM v GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  w AS (SELECT v.vec_id, v.label, sum((x - c) ** 2) AS sq FROM v JOIN c USING (label, pos) GROUP BY ALL), b AS (SELECT c.label, sum((c - m) ** 2) AS bq FROM c JOIN m USING (pos) GROUP BY 1),
  s AS (SELECT label, avg(sqrt(sq)) AS s FROM w GROUP BY 1), d AS (SELECT x.label AS i, y.label AS j, sqrt(sum((x.c - y.c) ** 2)) AS d FROM c x JOIN c y ON x.pos = y.pos AND x.label <> y.label GROUP BY ALL),
  r AS (SELECT i, max((a.s + e.s) / d) AS r FROM d JOIN s a ON a.label = i JOIN s e ON e.label = j GROUP BY 1)
  SELECT round((SELECT sum(n * bq) FROM b JOIN n USING (label)) / ((SELECT count(*) FROM n) - 1) / ((SELECT sum(sq) FROM w) / ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM n))), 6) AS calinski_harabasz,
  round((SELECT avg(r) FROM r), 6) AS davies_bouldin""")
def cluster_quality(spark, sf_dir):
    q = ve.cluster_quality(Tables(spark, sf_dir).embeddings, "embedding", "label")
    return q.select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


_CTF = r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS c FROM t GROUP BY ALL),
  l AS (SELECT lang, sum(c) AS n FROM c GROUP BY 1), w AS (SELECT token, sum(c) AS n FROM c GROUP BY 1),
  s AS (SELECT lang, token, c / l.n::DOUBLE * ln((SELECT count(*) FROM documents) / w.n::DOUBLE) AS score FROM c JOIN l USING (lang) JOIN w USING (token)),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, token) AS rn FROM s)"""


@plan("EM9 TK7", _CTF + " SELECT lang, token, round(score, 8) AS score, rn FROM r WHERE rn <= 5")
def class_tf_idf(spark, sf_dir):
    c = ve.class_tf_idf(Tables(spark, sf_dir).documents, tk.alnum(F.col("text")), "lang", "doc_id")
    return c.select("lang", "token", F.round("score", 8).alias("score"), F.col("rn").cast("bigint").alias("rn"))


@plan("EM12 EM11", _CTF + r""", k AS (SELECT lang, token FROM r WHERE rn <= 5), h AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) WHERE token IN (SELECT token FROM k)),
  u AS (SELECT token, count(*)::DOUBLE AS n FROM h GROUP BY 1), b AS (SELECT x.token AS x, y.token AS y, count(*)::DOUBLE AS n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.token < y.token GROUP BY ALL),
  p AS (SELECT a.lang, a.token AS x, c.token AS y FROM k a JOIN k c ON a.lang = c.lang AND a.token < c.token), d AS (SELECT count(*)::DOUBLE AS n FROM documents)
  SELECT lang, round(avg(CASE WHEN b.n IS NULL THEN -1 WHEN b.n = d.n THEN 1 ELSE ln((b.n / d.n) / (ux.n / d.n * uy.n / d.n)) / -ln(b.n / d.n) END), 6) AS coherence, count(*) AS pairs
  FROM p LEFT JOIN b USING (x, y) JOIN u ux ON ux.token = x JOIN u uy ON uy.token = y, d GROUP BY 1""")
def topic_coherence(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    words = ve.class_tf_idf(d, tk.alnum(F.col("text")), "lang", "doc_id").select("lang", "token")
    return ve.topic_coherence(d, tk.alnum(F.col("text")), "doc_id", words, "lang").withColumn("coherence", F.round("coherence", 6))


@plan("EM5 EM6")
def principal_components(spark, sf_dir):
    return ve.principal_components(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", 3)


@plan("EM7 EM10")
def kmeans_clusters(spark, sf_dir):
    c = ve.kmeans(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", 10)
    return c.groupBy("cluster").agg(F.count("*").alias("n"))


@plan("EM7")
def density_clusters(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return ve.density_clusters(e, "vec_id", "embedding", 0.42, 3)


# --- background, surprisal, sentiment, shift, flow ---

_TOK = r"""t AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark))"""


def _vec_sql(word: str, dim: int = 4) -> str:
    return "[" + ", ".join(f"{h_sql(word, k)} / 4294967296.0 - 0.5" for k in range(dim)) + "]"


def _bench(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select("item_id", "text"), tk.alnum(F.col("text"))


@plan("AG7 WN8 MT11 SNK4", f"""WITH {_TOK} SELECT a.token AS w1, b.token AS w2, count(*) AS n FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 GROUP BY ALL""")
def background_pairs(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    return jo.background(b, w)[1]


@plan("MT10 MT11", f"""WITH {_TOK}, uni AS (SELECT token, count(*)::DOUBLE AS n FROM t GROUP BY 1), bi AS (SELECT a.token AS w1, b.token AS w2, count(*)::DOUBLE AS n FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 GROUP BY ALL),
  nb AS (SELECT sum(n) AS nb FROM uni), own AS (SELECT item_id, token, count(*)::DOUBLE AS u FROM t GROUP BY ALL), sz AS (SELECT item_id, count(*)::DOUBLE AS n FROM t GROUP BY 1),
  c AS (SELECT a.item_id, a.token AS w1, b.token AS w2, count(*)::DOUBLE AS c FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 GROUP BY ALL)
  SELECT benchmark.item_id, round(s, 6) AS delta_pmi FROM benchmark LEFT JOIN (SELECT c.item_id, avg(log2((c / sz.n) / (x.u / sz.n * y.u / sz.n)) - log2(((coalesce(bi.n, 0) + 0.5) / (nb + 0.5)) / (g.n / nb * h.n / nb))) AS s
  FROM c JOIN sz USING (item_id) JOIN own x ON x.item_id = c.item_id AND x.token = w1 JOIN own y ON y.item_id = c.item_id AND y.token = w2 JOIN uni g ON g.token = w1 JOIN uni h ON h.token = w2 LEFT JOIN bi ON bi.w1 = c.w1 AND bi.w2 = c.w2, nb GROUP BY 1) q USING (item_id)""")
def delta_pmi(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    return pr.own_delta_pmi(b, w, "item_id").withColumn("delta_pmi", F.round("delta_pmi", 6))


_SURPRISAL = f"""WITH {_TOK}, s AS (SELECT item_id, pos, token, lag(token) OVER (PARTITION BY item_id ORDER BY pos) AS prev FROM t), q AS (SELECT * FROM s WHERE prev IS NOT NULL),
  b AS (SELECT prev, token, count(*)::DOUBLE AS c FROM q GROUP BY ALL), f AS (SELECT prev, sum(c) AS c1 FROM b GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM t),
  j AS (SELECT item_id, pos, token, -ln((c + 0.1) / (c1 + 0.1 * v)) AS x FROM q JOIN b USING (prev, token) JOIN f USING (prev), v)"""


@plan("MT6 MT7 MT8 TK-G SNK3", _SURPRISAL + " SELECT item_id, pos, token, round(x, 6) AS surprisal, round(x / ln(2), 6) AS bits FROM j")
def surprisal_journey(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    s = jo.bigram_surprisal(b, w, "item_id")
    return s.select("item_id", F.col("pos").cast("bigint").alias("pos"), "token", F.round("surprisal", 6).alias("surprisal"), F.round(F.col("surprisal") / F.log(F.lit(2.0)), 6).alias("bits"))


@plan("MT6 MT24 TK4", _SURPRISAL + " SELECT item_id, round(avg(x), 6) AS avg_value, round(max(x), 6) AS max_value, count(*) AS n FROM j GROUP BY 1")
def journey_summary(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    s = jo.summarize_series(jo.surprisal_series(b, w, "item_id"), "item_id")
    return s.select("item_id", F.round("avg_value", 6).alias("avg_value"), F.round("max_value", 6).alias("max_value"), "n")


@plan("MT23 WN10", _SURPRISAL + """, l AS (SELECT item_id, list(x ORDER BY pos) AS s FROM j GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT item_id, list_avg(s[1:greatest(1, len(s) // 4)]) AS a, list_avg(s[len(s) - greatest(1, len(s) // 4) + 1:]) AS z FROM l),
  m AS (SELECT median(a) AS ma, median(z) AS mz FROM e) SELECT item_id, round(a, 6) AS start, round(z, 6) AS finish, CASE WHEN a < ma AND z > mz THEN 'crescendo' WHEN a > ma AND z < mz THEN 'diminuendo' WHEN a > ma AND z > mz THEN 'sustained high' WHEN a < ma AND z < mz THEN 'sustained low' END AS archetype FROM e, m""")
def journey_archetypes(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    a = jo.archetypes(jo.series_quarters(jo.surprisal_series(b, w, "item_id"), "item_id"))
    return a.select("item_id", F.round("start", 6).alias("start"), F.round("finish", 6).alias("finish"), "archetype")


@plan("WN11 AG10 WN4", f"""WITH {_TOK}, p AS (SELECT item_id, pos, CASE WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN pos / (count(*) OVER (PARTITION BY item_id) - 1) * 100 ELSE 0.0 END AS percent FROM t)
  SELECT CAST(least(greatest(floor(percent / 100 * 10), 0), 9) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1""")
def position_bins(spark, sf_dir, texts=_bench):
    from ..operators.aggregates import equal_width_bins

    b, w = texts(spark, sf_dir)
    return equal_width_bins(jo.text_positions(b, w, "item_id"), "percent", 10, 0, 100)


@plan("WN4", r"""SELECT item_id, i, array_to_string(w[1:i], ' ') AS prefix FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark))""")
def text_prefixes(spark, sf_dir):
    """Prefixes up to the last word of each text."""
    b, w = _bench(spark, sf_dir)
    p = b.select("item_id", F.posexplode(jo.prefixes(w)).alias("i", "prefix"))
    return p.select("item_id", (F.col("i") + 1).cast("bigint").alias("i"), "prefix")


#: A small polarity lexicon, enough for the queries.
POSITIVE = ("good", "love", "great", "happy", "the", "la", "der")
NEGATIVE = ("bad", "hate", "stupid", "idiot", "of", "de", "und")


@plan("MT12", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN {POSITIVE}))::DOUBLE / greatest(len(w), 1) AS pos, len(list_filter(w, lambda x: x IN {NEGATIVE}))::DOUBLE / greatest(len(w), 1) AS neg FROM w)
  SELECT doc_id, round(pos, 6) AS pos, round(neg, 6) AS neg, round(1 - pos - neg, 6) AS neu, round(pos - neg, 6) AS polarity, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS label FROM s""")
def sentiment(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", tk.alnum(F.col("text")).alias("w"))
    s = jo.polarity(F.col("w"), POSITIVE, NEGATIVE)
    return d.select("doc_id", *[(c if k == "label" else F.round(c, 6)).alias(k) for k, c in s.items()])


@plan("MT13 WN3", f"""WITH {_TOK}, s AS (SELECT item_id, pos, sum(CASE WHEN token IN {POSITIVE} THEN 1.0::DOUBLE WHEN token IN {NEGATIVE} THEN -1.0 ELSE 0 END) OVER w / (pos + 1) AS p FROM t WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, p - lag(p) OVER (PARTITION BY item_id ORDER BY pos) AS x FROM s)
  SELECT item_id, round(max(abs(x)), 6) AS max_affective_shift, round(stddev_pop(p), 6) AS sentiment_volatility, round(arg_max(p, pos), 6) AS final_sentiment, count(*) AS word_count FROM d GROUP BY 1""")
def sentiment_journey(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    s = jo.sentiment_summary(jo.sentiment_journey(b, w, "item_id", POSITIVE, NEGATIVE), "item_id")
    return s.select("item_id", *[F.round(c, 6).alias(c) for c in ("max_affective_shift", "sentiment_volatility", "final_sentiment")], "word_count")


@plan("MT14 WN3", f"""WITH {_TOK}, v AS (SELECT *, {_vec_sql('token')} AS v FROM t), s AS (SELECT item_id, pos, token, [sum(v[1]) OVER w, sum(v[2]) OVER w, sum(v[3]) OVER w, sum(v[4]) OVER w] AS c FROM v WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT item_id, 1 - list_cosine_similarity(c::DOUBLE[], lag(c) OVER (PARTITION BY item_id ORDER BY pos)::DOUBLE[]) AS x FROM s)
  SELECT item_id, round(avg(x), 6) AS avg_value, round(max(x), 6) AS max_value FROM p WHERE x IS NOT NULL GROUP BY 1""")
def semantic_shift(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    s = jo.summarize(jo.prefix_shift(b, w, "item_id"), "item_id", "shift")
    return s.select("item_id", F.round("avg_value", 6).alias("avg_value"), F.round("max_value", 6).alias("max_value"))


@plan("MT15", f"""WITH s AS (SELECT item_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT item_id, {tk.sentences_sql('text')} AS s FROM benchmark)),
  t AS (SELECT item_id, i, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS token FROM (SELECT item_id, i, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+') AS w FROM s)), v AS (SELECT item_id, i, {_vec_sql('token')} AS v FROM t),
  m AS (SELECT item_id, i, [coalesce(avg(v[1]), 0), coalesce(avg(v[2]), 0), coalesce(avg(v[3]), 0), coalesce(avg(v[4]), 0)]::DOUBLE[] AS m FROM v GROUP BY ALL),
  d AS (SELECT item_id, list_distance(m, lag(m) OVER (PARTITION BY item_id ORDER BY i)) ** 2 AS d FROM m)
  SELECT item_id, round(avg(d), 6) AS swd FROM d GROUP BY 1""")
def stepwise_distance(spark, sf_dir, texts=_bench):
    b, _ = texts(spark, sf_dir)
    s = jo.stepwise_distance(b, tk.sentences(F.col("text")), "item_id", lambda x: jo.mean_vector(tk.alnum(x)))
    return s.withColumn("swd", F.round("swd", 6))


@plan("MT16 WN4", f"""WITH {_TOK}, v AS (SELECT *, {_vec_sql('token')}::DOUBLE[] AS v FROM t), d AS (SELECT a.item_id, a.pos, avg(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.item_id = b.item_id AND b.pos < a.pos GROUP BY ALL)
  SELECT item_id, round(avg(d), 6) AS flow FROM d GROUP BY 1""")
def forward_flow(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    return jo.forward_flow(b, w, "item_id").select("item_id", F.round("flow", 6).alias("flow"))


@plan("MT17", f"""WITH {_TOK}, v AS (SELECT *, {_vec_sql('token')}::DOUBLE[] AS v FROM t), d AS (SELECT item_id, 1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY item_id ORDER BY pos)) AS d FROM v)
  SELECT item_id, round(coalesce(avg(d), 0), 6) AS volatility FROM d GROUP BY 1""")
def adjacent_flow(spark, sf_dir, texts=_bench):
    b, w = texts(spark, sf_dir)
    return jo.adjacent_flow(b, w, "item_id").withColumn("volatility", F.round("volatility", 6))


@plan("MT19 SRC5", f"""WITH {_TOK}, v AS (SELECT *, {_vec_sql('token')} AS v FROM t) SELECT item_id, round(avg(v[1]), 6) AS x, round(avg(v[2]), 6) AS y FROM v WHERE token < 'n' GROUP BY 1""")
def static_vectors(spark, sf_dir, texts=_bench):
    """Mean of the vectors of the words that the lexicon (here words before n) knows."""
    b, w = texts(spark, sf_dir)
    lexicon = b.select(F.explode(w).alias("word")).distinct().filter("word < 'n'").withColumn("vec", jo.hash_vector(F.col("word")))
    v = jo.text_vectors(b, w, "item_id", lexicon, 4)
    return v.select("item_id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@plan("MT20 MT21", """WITH l(word, gloss) AS (VALUES ('the', 'a'), ('and', 'b'), ('er', 'c')), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT DISTINCT gloss FROM t JOIN l USING (word)""")
def definitions(spark, sf_dir):
    """Distinct glosses of the words that a gloss table knows."""
    words = Tables(spark, sf_dir).benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.join(_glosses(spark), "word").select("gloss").distinct()


def _glosses(spark):
    return spark.sql("SELECT * FROM VALUES ('the', 'a'), ('and', 'b'), ('er', 'c') AS t(word, gloss)")


@plan("MT21 MT22")
def definition_shifts(spark, sf_dir):
    """Distance of each document's mean word vector from the centroid of the vectors of its words' glosses."""
    b, w = _of_documents(spark, sf_dir)
    known = jo.definition_vectors(b, w, "item_id", _glosses(spark), lambda g: jo.mean_vector(tk.alnum(g)))
    out = jo.definition_shift(b, jo.mean_vector(w), "item_id", known)
    return out.select(F.col("item_id").alias("doc_id"), F.round("shift", 6).alias("shift"))


@plan("JN16", None)
def align_subwords(spark, sf_dir):
    """Sub-words of up to four letters matched to their words."""
    b, w = _bench(spark, sf_dir)
    cut = F.flatten(F.transform(w, lambda x: F.regexp_extract_all(x, F.lit(".{1,4}"), F.lit(0))))
    return b.select("item_id", F.array_join(jo.align_subwords(w, cut), ",").alias("word_of_part"))


def _of_documents(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("item_id"), "text"), tk.alnum(F.col("text"))


def _of_turns(spark, sf_dir):
    return Tables(spark, sf_dir).conversations.select(F.concat("conv_id", F.lit(":"), "turn").alias("item_id"), "text"), tk.alnum(F.col("text"))


def _over(name: str, table: str, key: str, texts, rows: str, twin: bool = True) -> None:
    """The query of that name over the texts of another table, whole; its SQL twin, where one is quick enough, reads ``rows``."""
    base = PLANS[name]

    def build(spark, sf_dir):
        out = base.build(spark, sf_dir, texts)
        return out.withColumnRenamed("item_id", key) if "item_id" in out.columns else out

    build.__name__ = f"{name}_{table}"
    plan(" ".join(base.ids), re.sub(r"\bitem_id\b", key, base.sql.replace("FROM benchmark", f"FROM {rows}")) if twin else None)(build)


# DuckDB's self joins of all words of a text are too slow over documents; the last two twins lack the rules for texts of
# fewer than two words or of none that is known, which no benchmark item is.
for _name in ("background_pairs", "delta_pmi", "forward_flow", "sentiment_journey", "static_vectors"):
    _over(_name, "documents", "doc_id", _of_documents, "documents", twin=False)
_STEPWISE = ("surprisal_journey", "journey_summary", "journey_archetypes", "position_bins", "sentiment_journey", "semantic_shift", "stepwise_distance")
for _name in (*(x for x in _STEPWISE if x != "sentiment_journey"), "adjacent_flow"):
    _over(_name, "documents", "doc_id", _of_documents, "documents")
for _name in (*_STEPWISE, "forward_flow"):
    _over(_name, "conversations", "turn_id", _of_turns, "(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations) c")


# --- matching and dedupe ---

_SENT = f"""s AS (SELECT doc_id, i, CAST(len({tk.split_words_sql('s')}) AS BIGINT) AS n, sum(len({tk.split_words_sql('s')})) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {tk.sentences_sql('text')} AS s FROM documents)))"""


@plan("SM1", f"""WITH {_SENT}, r AS (SELECT a.doc_id, a.i AS first, b.i AS last, CAST(b.upto - a.upto + a.n AS BIGINT) AS n, 1 AS stage FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i WHERE b.upto - a.upto + a.n BETWEEN 28 AND 52 UNION ALL SELECT doc_id, i, i, n, 2 FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, abs(n - 40), first, last) AS rn FROM r) SELECT doc_id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, n FROM k WHERE rn = 1 AND n <= 61 AND n >= 20""")
def length_matched_snippets(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", F.lit(40).alias("target"))
    s = ma.best_snippets(d, tk.sentences(F.col("text")), "doc_id", "target")
    return s.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("first", "last", "n")])


@plan("JN15")
def greedy_length_match(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", tk.split_words(F.col("text")).alias("w"), F.array(F.lit(30), F.lit(0), F.lit(60), F.lit(20)).alias("t"))
    return ma.match_lengths(d, "w", "t", "doc_id")


@plan("SIM3 WN6")
def sorted_neighbour_dedupe(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_name")
    return ma.sorted_neighbour_dedupe(p, "p_name", ["p_name"], "p_partkey", ["p_brand"])


@plan("EX1")
def author_candidates(spark, sf_dir):
    names = spark.sql("SELECT * FROM VALUES ('Ann Lee'), ('Bo Wu'), ('Cy Fox') AS t(author)")
    found = spark.sql("""SELECT * FROM VALUES ('Ann Lee', 1, 'Ann Leeds', 'city', NULL, 'France'), ('Ann Lee', 2, 'Ann Lee', 'English poet', 'English', 'UK'),
      ('Bo Wu', 1, 'Bo', 'a river', NULL, 'China'), ('Cy Fox', 1, 'cy fox', 'a village', NULL, 'Peru') AS t(author, rank, label, description, language, country)""")
    return en.best_authors(names, found)


@plan("EX2 EX3")
def book_candidates(spark, sf_dir):
    books = spark.sql("SELECT * FROM VALUES ('Dune', 'Frank Herbert'), ('Emma', 'Jane Austen') AS t(title, author)")
    found = spark.sql("""SELECT * FROM VALUES ('Dune', 'Frank Herbert', 1, 'Dune', 'Frank Herbert', false, false, true, 1984), ('Dune', 'Frank Herbert', 2, 'Dune', 'Frank Herbert', true, true, false, 1965),
      ('Emma', 'Jane Austen', 1, 'Emma Brown', 'Someone Else', true, false, false, 2003) AS t(title, author, rank, label, authors, is_work, has_keyword, is_edition, year)""")
    return en.best_books(books, found)


# --- models ---


def _metric_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "GSQ").otherwise("NLB").alias("source"), "text", "n_chars")
    parts = {"chars": F.col("n_chars").cast("double"), "marks": F.regexp_count(F.col("text"), F.lit("[^\\p{L}\\p{N} ]")).cast("double") / F.col("n_chars"), "words": tk.n_words(F.col("text")).cast("double")}
    return d.select("doc_id", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in parts.items()])).alias("m")).select("doc_id", "source", "m.*")


@plan("ML1", f"""SELECT doc_id, CASE WHEN quality = 1 THEN 'GSQ' ELSE 'NLB' END AS source, n_chars::DOUBLE AS chars, round(len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}} ]'))::DOUBLE / n_chars, 8) AS marks, len({tk.split_words_sql('text')})::DOUBLE AS words, quality AS label FROM documents JOIN labels USING (doc_id)""")
def class_frame(spark, sf_dir):
    from ..operators.ml import class_frame as build

    frame, names = build(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    return frame.select("doc_id", "source", *names, "label").withColumn("marks", F.round("marks", 8))


@plan("ML2 ML3 ML4 ML5 ML6")
def classifier_scores(spark, sf_dir):
    from ..operators import ml

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    rows = fi.materialize(frame)
    return ml.train_and_score(rows, names, "doc_id", "logistic").select("doc_id", "label", F.round("score", 6).alias("score"), "predicted")


@plan("ML8 ML6")
def experiment_summary(spark, sf_dir):
    """The sixteen experiments over two metrics of six groups, best ROC area first."""
    from ..operators import ml

    scored = ml.run_experiments(fi.materialize(_grouped_metrics(spark, sf_dir)), "row_id")
    return scored.select("task", "excluded", "n", *[F.round(c, 6).alias(c) for c in ("auc", "accuracy", "macro_f1")])


@plan("ML2 ML3")
def boosted_grid(spark, sf_dir):
    """Boosted trees searched over a part of the grid by folds, then the ROC area of the best; ``ml.BOOSTED_GRID`` is the whole."""
    from ..operators import ml

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    model, area = ml.cross_validated(fi.materialize(frame), names, "doc_id", "gbt", folds=3, grid={"maxIter": [5], "maxDepth": [2, 3], "stepSize": [0.1, 0.2]})
    best = model.stages[-1]
    return spark.createDataFrame([(best.getMaxIter(), best.getMaxDepth(), best.getStepSize(), round(float(area), 6))], "max_iter int, max_depth int, step_size double, area double")


@plan("ML5 ML7")
def boosted_importances(spark, sf_dir):
    """Gain importances of a boosted regressor of the label over median-imputed metrics."""
    from ..operators import ml

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in ml.regression_importances(fi.materialize(frame.withColumn("label", F.col("label").cast("double"))), names, "label")], "feature string, gain double")


@plan("ML7")
def feature_importances(spark, sf_dir):
    from ..operators import ml

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    model, area = ml.cross_validated(fi.materialize(frame), names, "doc_id", "logistic", folds=3)
    gains = ml.permutation_importance(frame, model, names, "doc_id")
    return spark.createDataFrame([(k, float(v), float(area)) for k, v in sorted(gains.items())], "feature string, loss double, area double")


@plan("ML9 TK6")
def distinction_leaderboard(spark, sf_dir):
    from ..operators import ml

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    return ml.leaderboard(fi.materialize(frame), names, "doc_id")


# --- files and streams ---


@plan("SRC2 SNK1", "SELECT conv_id, turn, role, text FROM conversations WHERE trim(text) NOT IN ('', '#N/A', 'N/A', 'NA', 'NaN', 'nan', 'None', 'null', 'NULL', 'n/a')")
def csv_round_trip(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    path = fi.scratch(spark)
    fi.write_csv(c, path)
    return fi.read_csv(spark, path, c.schema).filter("text IS NOT NULL")


@plan("SRC3", "SELECT item_id, trim(text) AS context, 'quote ' || item_id AS quote FROM benchmark")
def article_folder(spark, sf_dir):
    path = fi.scratch(spark)
    b = Tables(spark, sf_dir).benchmark.select(F.concat("text", F.lit("@highlight quote "), F.col("item_id").cast("string")).alias("value"), "item_id")
    b.write.partitionBy("item_id").text(path)
    rows = fi.read_articles(spark, path)
    return rows.select(F.regexp_extract("quote", r"(\d+)", 1).cast("bigint").alias("item_id"), "context", "quote")


@plan("SRC4 SNK2", "SELECT vec_id AS row_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS n FROM embeddings")
def npz_archives(spark, sf_dir):
    """Vectors packed to NumPy archives, one of each batch, and read from their bytes."""
    e = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("row_id"), "embedding")
    rows = fi.npz_rows(fi.pack_npz(e))
    return rows.select("row_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("bigint").alias("n"))


@plan("SRC1", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0")
def sqlite_databases(spark, sf_dir):
    """Rows packed to SQLite databases, one of each batch, and read by a query with a limit of their size."""
    n = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name", "n_regionkey")
    packed = fi.pack_sqlite(n, "nation")
    return fi.sqlite_rows(packed, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0 ORDER BY n_nationkey LIMIT 380000", "n_nationkey int, n_name string")


@plan("SRC5", "SELECT 'v' || vec_id AS word, round(embedding[1]::DOUBLE, 4) AS x, len(embedding) AS n FROM embeddings")
def word_vector_file(spark, sf_dir):
    """Vectors written as lines of a word and its numbers, and read back."""
    e, path = Tables(spark, sf_dir).embeddings, fi.scratch(spark)
    e.select(F.concat(F.lit("v"), "vec_id", F.lit(" "), F.array_join("embedding", " ")).alias("value")).write.text(path)
    return fi.read_word_vectors(spark, path).select("word", F.round(F.col("vec")[0].cast("double"), 4).alias("x"), F.size("vec").cast("bigint").alias("n"))


@plan("SRC8 EX4", "SELECT doc_id, upper(lang) AS code FROM documents")
def fetched_by_distinct_key(spark, sf_dir):
    """A look-up that is asked once for each language."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    looked = fi.map_distinct(d, ["lang"], lambda keys: fi.fetch(keys, "lang string, code string", lambda key: [(key[0], key[0].upper())]))
    return looked.select("doc_id", "code")


@plan("SRC9")
def recognised_pages(spark, sf_dir):
    """Files of the benchmark folder through a stand-in recogniser that tells their kind."""
    return fi.read_pages(spark, f"{sf_dir}/benchmark.parquet", lambda content: content[:4].decode("latin-1"))


@plan("SRC6 SNK3 FN7", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def journeys_round_trip(spark, sf_dir):
    steps = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("pos"), F.col("role").alias("token")))).alias("steps"))
    path = fi.scratch(spark)
    fi.write_journeys(steps, path)
    j = fi.read_journeys(spark, path, steps.schema)
    return j.select("conv_id", F.size("steps").cast("bigint").alias("n"), F.array_join(F.transform("steps", lambda s: s["token"]), ",").alias("roles"))


@plan("SNK2 SNK7 SRC4", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vectors_round_trip(spark, sf_dir):
    path = fi.scratch(spark)
    e = Tables(spark, sf_dir).embeddings
    fi.write_if_absent(e, path)
    fi.write_if_absent(e.limit(1), path)  # the sink is there: nothing changes
    return spark.read.parquet(path).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@plan("SNK6", "SELECT count(DISTINCT doc_id) AS keys, count(DISTINCT doc_id) AS rows FROM documents")
def resumed_append(spark, sf_dir):
    path = fi.scratch(spark)
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    fi.append_new(d.filter("doc_id % 3 = 0"), path, ["doc_id"])
    fi.append_new(d, path, ["doc_id"])
    return spark.read.parquet(path).agg(F.count_distinct("doc_id").alias("keys"), F.count("*").alias("rows"))


@plan("SNK5 TX20 TX25")
def report_text(spark, sf_dir):
    from ..sources import report

    rows = Tables(spark, sf_dir).region.orderBy("r_regionkey")
    text = report.latex_table(rows, "Regions", "tab:r") + "\n" + report.html_diff("a b c", "a c d")
    return spark.createDataFrame([(n, line) for n, line in enumerate(text.split("\n"))], "line int, text string")


@plan("WN3 SNK6", """SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streamed_windows(spark, sf_dir):
    """Daily counts of the event stream, run to the end of what there is."""
    from ..streaming import incremental as inc

    path = f"{sf_dir}/events.parque*"
    schema = spark.read.parquet(path).schema
    out, mark = fi.scratch(spark), fi.scratch(spark)
    held = inc.windowed_counts(_stream(spark, path, schema), "ts", ["event_type"], "1 day", "10 minutes", "value")
    # Complete results of a bounded stream: kept per micro-batch, the last one counts.
    def keep(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    q = held.writeStream.outputMode("complete").option("checkpointLocation", mark).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plan("SNK6 FLT5", f"SELECT doc_id, CAST(len({tk.split_words_sql('text')}) AS BIGINT) AS n FROM documents")
def streamed_word_counts(spark, sf_dir):
    """The batch transform, over a stream."""
    from ..streaming import incremental as inc

    path = f"{sf_dir}/documents.parque*"
    schema = spark.read.parquet(path).schema
    out, mark = fi.scratch(spark), fi.scratch(spark)
    inc.run_available(_stream(spark, path, schema).select("doc_id", tk.n_words(F.col("text")).cast("bigint").alias("n")), out, mark)
    return spark.read.parquet(out)


def _stream(spark, path: str, schema: T.StructType):
    return spark.readStream.schema(schema).parquet(path)


@plan("SNK6", """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    from ..streaming import incremental as inc

    s = inc.session_counts(Tables(spark, sf_dir).events, "ts", ["user_id"], "2 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
