"""Embedding spaces at scale: indexed neighbours, density clusters, layouts; attributions, intervals, sub-words, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import attribution as at
from ..operators import density as de
from ..operators import fuzzy as fu
from ..operators import intervals as it
from ..operators import journeys as jo
from ..operators import layout as la
from ..operators import lexicons as lx
from ..operators import matching as ma
from ..operators import neighbours as ne
from ..operators import subwords as sw
from ..operators import topic_runs as tr
from ..operators import topics as to
from ..operators import vectors as ve
from ..operators.windows import top_per_group
from ..sources import files as fi
from .registry import Tables, plan
from .relational import h_sql

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@plan("JN12 JN13")
def indexed_neighbours(spark, sf_dir):
    """Of every row whose id 20 divides the most similar of all others, found through the index, and beside it the best there is."""
    e = Tables(spark, sf_dir).embeddings
    asked = F.col("vec_id") % 20 == 0
    found = ne.nearest_rows(e, "vec_id", "embedding", queries=asked)
    best = ve.nearest(e.filter(asked), e, "vec_id", "embedding", k=2).filter("id <> other").groupBy("id").agg(F.max("similarity").alias("best"))
    return best.join(found, "id", "left").withColumn("hit", F.coalesce(F.col("similarity") >= F.col("best") - 1e-9, F.lit(False)))


@plan("EM1 JN12", f"""WITH p AS (SELECT a.vec_id AS id, count(*) AS n, min(b.vec_id) AS low FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.95 GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(vec_id < low, true) AS kept FROM embeddings LEFT JOIN p ON id = vec_id""")
def embedding_duplicates(spark, sf_dir):
    """Rows that a row of smaller id resembles by 0.95 leave; pairs are found exactly through cells that the angle can reach."""
    return ne.near_rows(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", 0.95)


@plan("EM7")
def hdbscan_clusters(spark, sf_dir):
    """Density clusters of the unit vectors with noise; a test holds them against a brute-force tree."""
    return de.hdbscan(Tables(spark, sf_dir).embeddings, "vec_id", ve.unit(F.col("embedding")), min_cluster_size=15)


# --- attributions, surest rows, intervals, densities ---


def _boosted(spark, sf_dir):
    """The metrics of the labelled documents, written, and boosted trees fitted on all of them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from ..operators import ml
    from .analytics import _metric_rows

    frame, names = ml.class_frame(_metric_rows(spark, sf_dir), "doc_id", ["GSQ"], ["NLB"])
    rows = fi.materialize(frame)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), ml.learner("gbt")]).fit(rows)
    return rows, names, model.stages[-1]


@plan("ML7")
def shap_values(spark, sf_dir):
    """Of every labelled document what each metric adds to the margin of boosted trees; base and the parts add up to it."""
    rows, names, model = _boosted(spark, sf_dir)
    return at.attributions(rows, model, names, "doc_id")


@plan("ML7")
def shap_importances(spark, sf_dir):
    """Mean absolute attribution of each metric."""
    rows, names, model = _boosted(spark, sf_dir)
    return at.mean_attributions(at.attributions(rows, model, names, "doc_id"), names)


_TOLD = "SELECT doc_id, toxic, CAST(n_chars < 400 AS INT) AS predicted, greatest(n_chars, 400.0) / (n_chars + 400.0) AS sure FROM documents JOIN labels USING (doc_id)"


@plan("TK8", f"""WITH t AS ({_TOLD}) SELECT toxic, toxic = predicted AS correct, doc_id, round(sure, 8) AS sure, CAST(row_number() OVER (PARTITION BY toxic, toxic = predicted ORDER BY sure DESC, doc_id) AS INT) AS place
  FROM t WHERE toxic IS NOT NULL AND sure IS NOT NULL QUALIFY place <= 3""")
def surest_examples(spark, sf_dir):
    """The three surest right and wrong rows of each class, of a rule that takes short documents for toxic."""
    t = Tables(spark, sf_dir)
    n = F.col("n_chars").cast("double")
    told = t.documents.join(t.labels, "doc_id").select("doc_id", "toxic", (n < 400).cast("int").alias("predicted"), (F.greatest(n, F.lit(400.0)) / (n + 400)).alias("sure"))
    return at.surest_rows(told, "toxic", "predicted", "sure", "doc_id").select("toxic", "correct", "doc_id", F.round("sure", 8).alias("sure"), "place")


@plan("SI3")
def area_interval(spark, sf_dir):
    """The bias-corrected, accelerated interval of the ROC area of a document's length for its toxicity, 9,999 replicates."""
    t = Tables(spark, sf_dir)
    return it.area_interval(t.documents.join(t.labels, "doc_id"), "toxic", "n_chars")


@plan("SI3")
def accuracy_interval(spark, sf_dir):
    """The same of the share that the rule of ``surest_examples`` tells right."""
    t = Tables(spark, sf_dir)
    return it.accuracy_interval(t.documents.join(t.labels, "doc_id").withColumn("predicted", (F.col("n_chars") < 400).cast("int")), "toxic", "predicted")


@plan("SI10 EX6", """WITH t AS (SELECT lang, count(*) AS n, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, stddev_samp(n_chars) * count(*) ** -0.2 AS h FROM documents GROUP BY 1),
  b AS (SELECT lang, least(floor((n_chars - low) / ((high - low) / 400)), 399) AS bin, count(*) AS c FROM documents JOIN t USING (lang) WHERE high > low GROUP BY ALL),
  g AS (SELECT *, low - 3 * h + point * ((high - low + 6 * h) / 49) AS x FROM t, (SELECT unnest(range(50)) AS point) WHERE high > low)
  SELECT lang, CAST(point AS INT) AS point, round(x, 6) AS x, round(sum(c * exp(-0.5 * ((x - (low + (bin + 0.5) * ((high - low) / 400))) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density
  FROM g JOIN b USING (lang) GROUP BY lang, point, x""")
def density_curves(spark, sf_dir):
    """Kernel densities of document lengths by language, the data of density and violin figures."""
    d = it.kernel_density(Tables(spark, sf_dir).documents, "n_chars", "lang")
    return d.select("lang", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


# --- sub-words ---

#: A public byte-pair vocabulary; its place is a setting, the file is not part of this library.
RANKS = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


@plan("TK-G")
def subword_tokens(spark, sf_dir):
    """Sub-word tokens of every document, as their number and the digest of the ids."""
    told = sw.subword_tokens(Tables(spark, sf_dir).documents, "doc_id", "text", RANKS)
    ids = F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",")
    return told.select("doc_id", "n_chars", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("tokens_sha256"))


@plan("MT7 MT8 TK-G")
def subword_surprisal(spark, sf_dir):
    """Bits per sub-word token, and surprisal over strided windows, of every benchmark item by the counts of the others."""
    return sw.surprisal(Tables(spark, sf_dir).benchmark, "item_id", "text", RANKS)


@plan("MT7 MT8 TK-G")
def subword_surprisal_documents(spark, sf_dir):
    """The same of every document."""
    return sw.surprisal(Tables(spark, sf_dir).documents, "doc_id", "text", RANKS)


# --- topics ---


def _topic_counts(spark, sf_dir):
    """Clusters of the documents in runs of texts, and of each topic its terms' counts in buckets of terms, written."""
    d = Tables(spark, sf_dir).documents
    runs = tr.topic_runs(to.text_clusters(d, tk.alnum(F.col("text")), "doc_id", 20), F.col("words"), "doc_id", "topic")
    return runs, tr.term_buckets(runs)


@plan("EM11 EM9 TK7")
def topic_model(spark, sf_dir):
    """Terms of one and two words of the documents' topics, near topics united, with the texts most typical of each."""
    runs, buckets = _topic_counts(spark, sf_dir)
    mass, total = tr.shared_mass(buckets), buckets.agg(F.sum("c")).first()[0]
    into = to.united({r[0]: r[0] for r in mass.select("x").distinct().collect()}, 0.9, (mass, total))
    sizes = tr.topic_sizes(buckets, into, min_df=2)
    weights, norms = tr.leading_weights(runs, buckets, into, sizes, min_df=2, top=30)
    words = to.diverse_terms(weights).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    scored = tr.scored_texts(runs, buckets, into, sizes, norms, 2, "doc_id")
    first = top_per_group(scored.filter("similarity IS NOT NULL"), ["topic"], [F.col("similarity").desc(), "doc_id"], 3, "place")
    texts = first.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("typical"))
    return scored.groupBy("topic").agg(F.count("*").alias("n")).join(words, "topic", "left").join(texts, "topic", "left")


_LANG_WORDS = r"""WITH RECURSIVE t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
  u AS (SELECT lang, unnest(w) AS token FROM t), c AS (SELECT lang, token, count(*) AS c FROM u GROUP BY ALL), l AS (SELECT lang, sum(c) AS n FROM c GROUP BY 1), f AS (SELECT token, sum(c) AS n FROM c GROUP BY 1),
  s AS (SELECT lang, token, c / l.n::DOUBLE * ln((SELECT count(*) FROM documents) / f.n::DOUBLE) AS score FROM c JOIN l USING (lang) JOIN f USING (token)),
  k AS (SELECT lang, token FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, token) <= 5)"""


@plan("EM12 EM11", _LANG_WORDS + r""", o AS (SELECT doc_id, greatest(len(w) - 109, 1) AS m, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM t),
  x AS (SELECT DISTINCT doc_id, token, unnest(range(greatest(p - 110, 0), least(p, m))) AS win FROM o WHERE token IN (SELECT token FROM k)),
  g AS (SELECT sum(greatest(len(w) - 109, 1))::DOUBLE AS n FROM t), a AS (SELECT token, count(*) / (SELECT n FROM g) AS p FROM x GROUP BY 1),
  j AS (SELECT y.token AS v, z.token AS w, count(*) / (SELECT n FROM g) AS p FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.win = z.win GROUP BY ALL),
  e AS (SELECT q.lang, q.token AS v, r.token AS w, ln((coalesce(j.p, 0) + 1e-12) / (pv.p * pw.p)) / -ln(coalesce(j.p, 0) + 1e-12) AS i FROM k q JOIN k r USING (lang)
    LEFT JOIN j ON j.v = q.token AND j.w = r.token JOIN a pv ON pv.token = q.token JOIN a pw ON pw.token = r.token),
  b AS (SELECT lang, w, sum(i) AS i FROM e GROUP BY ALL), h AS (SELECT lang, sqrt(sum(i * i)) AS n FROM b GROUP BY 1),
  d AS (SELECT e.lang, e.v, sum(e.i * b.i) / (sqrt(sum(e.i * e.i)) * any_value(h.n)) AS cosine FROM e JOIN b USING (lang, w) JOIN h USING (lang) GROUP BY e.lang, e.v)
  SELECT lang, round(avg(cosine), 6) AS coherence, CAST(count(*) AS INT) AS words FROM d GROUP BY 1""")
def window_coherence(spark, sf_dir):
    """Coherence of each language's leading words over sliding windows of 110 words."""
    d = Tables(spark, sf_dir).documents
    words = ve.class_tf_idf(d, tk.alnum(F.col("text")), "lang", "doc_id").select("lang", "token")
    return to.window_coherence(d, tk.alnum(F.col("text")), words, "lang", "token").withColumn("coherence", F.round("coherence", 6))


# --- layouts and fuzzy pairs ---


@plan("EM5")
def umap_layout(spark, sf_dir):
    """Every vector's place in a plane that keeps its fifteen nearest by cosine."""
    return la.umap(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", 2)


@plan("JN9 JN11 SIM4")
def indexed_fuzzy_match(spark, sf_dir):
    """Pairs of parts of one brand whose names have a token-set ratio of 90 or more, only candidates scored; a test holds them against all pairs."""
    return fu.similar_rows(Tables(spark, sf_dir).part, "p_partkey", ["p_brand"], "p_name", 90)


@plan("TX21")
def quote_sentences_removed(spark, sf_dir):
    """Every document without the sentences that repeat its quote, here its first sentence, by the scores of the reference: 65 for the text, 70 for a sentence."""
    s = tk.sentences(F.col("text"))
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", s.alias("s"))
    kept = ma.without_quote(F.col("s"), F.col("text"), F.try_element_at("s", F.lit(1)))
    out = d.select("doc_id", F.size("s").cast("long").alias("n"), kept.alias("kept"))
    return out.select("doc_id", "n", (F.col("n") - F.size("kept")).alias("dropped"), F.array_join("kept", " ").alias("cleaned"))


# --- lexicons learned from the texts ---

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_LEXICON = f"""w AS (SELECT doc_id, toxic, {_W} AS w FROM documents LEFT JOIN labels USING (doc_id)), u AS (SELECT doc_id, toxic, unnest(w) AS word FROM w),
  c AS (SELECT word, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS q FROM u WHERE toxic IN (0, 1) GROUP BY 1), a AS (SELECT sum(p) AS ap, sum(q) AS aq, count(*) AS v FROM c),
  l AS (SELECT word, CAST(sign(o) AS INT) AS polarity, p + q AS size FROM (SELECT *, ln((p + 1) / (ap + v)::DOUBLE) - ln((q + 1) / (aq + v)::DOUBLE) AS o FROM c, a WHERE p + q >= 5) WHERE abs(o) >= 1)"""


def _toxic_lexicon(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lx.polarity_lexicon(t.documents.join(t.labels, "doc_id"), tk.alnum(F.col("text")), "toxic")


@plan("MT12", f"WITH {_LEXICON} SELECT word, polarity, size FROM l")
def polarity_words(spark, sf_dir):
    """Words that the labelled documents use far more often on one side."""
    return _toxic_lexicon(spark, sf_dir)


@plan("MT12", f"""WITH {_LEXICON}, h AS (SELECT doc_id, count(*) FILTER (polarity > 0) AS p, count(*) FILTER (polarity < 0) AS q FROM u JOIN l USING (word) GROUP BY 1),
  s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN coalesce(p, 0) / len(w)::DOUBLE END AS pos, CASE WHEN len(w) > 0 THEN coalesce(q, 0) / len(w)::DOUBLE END AS neg FROM w LEFT JOIN h USING (doc_id))
  SELECT doc_id, round(pos, 6) AS pos, round(neg, 6) AS neg, round(1 - pos - neg, 6) AS neu, round(pos - neg, 6) AS polarity, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' WHEN pos IS NOT NULL THEN 'neutral' END AS label FROM s""")
def learned_sentiment(spark, sf_dir):
    """Polarity of every document by the lexicon of the labelled ones."""
    out = lx.polarity_by_lexicon(Tables(spark, sf_dir).documents, tk.alnum(F.col("text")), "doc_id", _toxic_lexicon(spark, sf_dir))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "neu", "polarity")], "label")


@plan("MT13 WN3", f"""WITH {_LEXICON}, t AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, {_W} AS w FROM benchmark)),
  s AS (SELECT item_id, pos, sum(coalesce(polarity, 0)) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / (pos + 1)::DOUBLE AS p FROM t LEFT JOIN l ON word = token),
  d AS (SELECT *, p - lag(p) OVER (PARTITION BY item_id ORDER BY pos) AS x FROM s)
  SELECT item_id, round(max(abs(x)), 6) AS max_affective_shift, round(stddev_pop(p), 6) AS sentiment_volatility, round(arg_max(p, pos), 6) AS final_sentiment, count(*) AS word_count FROM d GROUP BY 1""")
def learned_sentiment_journey(spark, sf_dir):
    """How the polarity of the benchmark items moves word by word, by the same lexicon."""
    b = Tables(spark, sf_dir).benchmark.select("item_id", "text")
    s = jo.sentiment_summary(lx.polarity_journey(b, tk.alnum(F.col("text")), "item_id", _toxic_lexicon(spark, sf_dir)), "item_id")
    return s.select("item_id", *[F.round(c, 6).alias(c) for c in ("max_affective_shift", "sentiment_volatility", "final_sentiment")], "word_count")


DIM = 8
_CONTEXT = f"""t AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, {_W} AS w FROM benchmark)),
  p AS (SELECT a.token AS w1, b.token AS w2, count(*) AS n FROM t a JOIN t b ON a.item_id = b.item_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 GROUP BY ALL),
  v AS (SELECT w1 AS word, CAST(sum(n) AS BIGINT) AS n, {', '.join(f"sum(n * ({h_sql('w2', k)} / 4294967296.0 - 0.5)) / sum(n) AS x{k}" for k in range(DIM))} FROM p GROUP BY 1)"""


def _context_table(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark.select("item_id", "text")
    return lx.context_vectors(jo.background(b, tk.alnum(F.col("text")))[1], DIM)


@plan("SRC5 MT14 MT19", f"WITH {_CONTEXT} SELECT word, n, {', '.join(f'round(x{k}, 6) AS x{k}' for k in range(DIM))} FROM v")
def context_vectors(spark, sf_dir):
    """Vectors of the benchmark's words, made from the words that stand within five places."""
    return _context_table(spark, sf_dir).select("word", "n", *[F.round(F.col("vec")[k], 6).alias(f"x{k}") for k in range(DIM)])


@plan("MT19 SRC5", f"""WITH {_CONTEXT}, m AS (SELECT item_id, {', '.join(f'avg(x{k}) AS x{k}' for k in range(DIM))} FROM t JOIN v ON word = token GROUP BY 1)
  SELECT benchmark.item_id, {', '.join(f'round(coalesce(x{k}, 0), 6) AS x{k}' for k in range(DIM))} FROM benchmark LEFT JOIN m USING (item_id)""")
def learned_text_vectors(spark, sf_dir):
    """Mean vector of each benchmark item by the learned word vectors."""
    b = Tables(spark, sf_dir).benchmark.select("item_id", "text")
    v = jo.text_vectors(b, tk.alnum(F.col("text")), "item_id", _context_table(spark, sf_dir), DIM)
    return v.select("item_id", *[F.round(F.col("vec")[k], 6).alias(f"x{k}") for k in range(DIM)])


_VEC = "[" + ", ".join(f"x{k}" for k in range(DIM)) + "]"
_MEAN = lambda c, out: ", ".join(f"avg({c}[{k + 1}]) AS {out}{k}" for k in range(DIM))


@plan("MT20 MT21 MT22", f"""WITH {_CONTEXT}, e AS (SELECT word, {_VEC} AS vec FROM v), c AS (SELECT w2, sum(n) AS a FROM p GROUP BY 1),
  g AS (SELECT w1 AS word, w2 AS gloss FROM p JOIN c USING (w2) WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY w1 ORDER BY n::DOUBLE / a DESC, w2) <= 5),
  d AS (SELECT word, {_VEC} AS vec FROM (SELECT g.word, {_MEAN('e.vec', 'x')} FROM g JOIN e ON e.word = g.gloss GROUP BY 1)),
  m AS (SELECT item_id, count(*) AS n, {_MEAN('vec', 'x')} FROM (SELECT DISTINCT item_id, token FROM t) JOIN d ON word = token GROUP BY 1),
  b AS (SELECT item_id, {_MEAN('vec', 'x')} FROM t JOIN e ON word = token GROUP BY 1)
  SELECT benchmark.item_id, coalesce(m.n, 0) AS n, round(1 - list_cosine_similarity([{', '.join(f'b.x{k}' for k in range(DIM))}], [{', '.join(f'm.x{k}' for k in range(DIM))}]), 6) AS shift
  FROM benchmark LEFT JOIN b USING (item_id) LEFT JOIN m USING (item_id)""")
def learned_definition_shifts(spark, sf_dir):
    """How far each benchmark item stands from the definitions of its words, a definition being the words that stand near a word most of their times."""
    b = Tables(spark, sf_dir).benchmark.select("item_id", "text")
    pairs = fi.materialize(jo.background(b, tk.alnum(F.col("text")))[1])
    vectors = fi.materialize(lx.context_vectors(pairs, DIM))
    out = lx.definition_shifts(b, tk.alnum(F.col("text")), "item_id", vectors, lx.definition_table(lx.glosses(pairs), vectors, DIM), DIM)
    return out.withColumn("shift", F.round("shift", 6))
