"""Relational core: projections, filters, joins, aggregates, windows, top-k, sets, samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import tables as tb
from ..operators import windows as wn
from .registry import Tables, plan

HASH_SQL = "CAST('0x' || substr(md5(CAST({c} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"


def h_sql(c: str, seed: int = 42) -> str:
    return HASH_SQL.format(c=c, seed=seed)


def u_sql(c: str, seed: int = 42) -> str:
    return f"(({h_sql(c, seed)} + 1) / 4294967297.0)"


# --- sources with a limit, projections ---


@plan("SRC1", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 300")
def scan_limit(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", "lang").orderBy("doc_id").limit(300)


@plan("SRC4", "SELECT vec_id, len(embedding) AS dim, label FROM embeddings")
def vector_scan(spark, sf_dir):
    return Tables(spark, sf_dir).embeddings.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), "label")


@plan("SRC7", """SELECT doc_id, running FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS running,
  sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars AS before FROM documents) WHERE before <= 20000""")
def budget_scan(spark, sf_dir):
    """Per language, documents in order until a character budget is passed."""
    d = wn.upto(Tables(spark, sf_dir).documents.select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], "running", "n_chars")
    return d.filter(F.col("running") - F.col("n_chars") <= 20000).select("doc_id", "running")


@plan("PRJ1", "SELECT c_name AS NAME, c_acctbal AS ACCTBAL, CAST(NULL AS VARCHAR) AS TAGS FROM (SELECT c_name, c_acctbal FROM customer)")
def conform_columns(spark, sf_dir):
    schema = T.StructType.fromDDL("NAME string, ACCTBAL double, TAGS string")
    c = Tables(spark, sf_dir).customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    return tb.conform(c, schema)


@plan("PRJ2", "SELECT p_partkey AS id, p_name AS title, p_type FROM part")
def rename_and_drop(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return tb.rename_drop(p, {"p_partkey": "id", "p_name": "title", "absent": "x"}, ["p_brand", "p_size", "p_retailprice", "nothing"])


@plan("PRJ3 JN4", """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def map_with_fallback(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    c = t.customer.withColumn("code", F.col("c_nationkey").cast("string"))
    return tb.map_values(c, "code", keys, "k", "n_name", "nation").select("c_custkey", "nation")


@plan("PRJ4", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status FROM orders")
def replace_exact(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", tb.replace_values("o_orderstatus", {"O": "open", "F": "filled"}).alias("status"))


@plan("PRJ5", """SELECT o_orderkey, CAST(floor(coalesce(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) || '.7' END AS DOUBLE), 0)) AS BIGINT) AS likes FROM orders""")
def coerce_number(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".7")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", tb.to_count(text).alias("likes"))


@plan("PRJ6 JN8")
def classify_table_columns(spark, sf_dir):
    parts = tb.classify_columns(Tables(spark, sf_dir).documents, ["text"], ["doc_id", "lang", "source"])
    return spark.createDataFrame([(k, c) for k, cs in sorted(parts.items()) for c in cs], "part string, column_name string")


@plan("PRJ7", """WITH n(metric) AS (VALUES ('t50_flesch'), ('t50free_pmi'), ('sample_ff'), ('other_x'), ('t50freelength_swd')),
  p(prefix) AS (VALUES ('t50'), ('t50free'), ('t50freelength'), ('sample'))
  SELECT metric, arg_max(prefix, length(prefix)) AS prefix FROM n LEFT JOIN p ON starts_with(metric, prefix || '_') GROUP BY metric""")
def metric_prefix(spark, sf_dir):
    names = spark.sql("SELECT * FROM VALUES ('t50_flesch'), ('t50free_pmi'), ('sample_ff'), ('other_x'), ('t50freelength_swd') AS t(metric)")
    prefixes = spark.sql("SELECT * FROM VALUES ('t50'), ('t50free'), ('t50freelength'), ('sample') AS t(prefix)")
    return tb.longest_prefix(names, "metric", prefixes, "prefix")


@plan("PRJ8", """SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END,
  (SELECT median(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END) FROM lineitem)), 6) AS q FROM lineitem""")
def median_imputation(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"))
    return tb.impute_median(li, ["q"]).withColumn("q", F.round("q", 6))


# --- filters ---


@plan("FLT1 FLT2", """SELECT conv_id, turn FROM conversations WHERE length(trim(text)) > 0 AND length(trim(role)) > 0 AND turn >= 1""")
def drop_blank_rows(spark, sf_dir):
    return tb.drop_blank(Tables(spark, sf_dir).conversations, ["text", "role"]).filter("turn >= 1").select("conv_id", "turn")


@plan("FLT3", "SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'fr') OR lang IS NULL")
def not_in_list(spark, sf_dir):
    return Tables(spark, sf_dir).documents.filter(tb.not_in("lang", ["en", "fr"])).select("doc_id")


@plan("FLT4", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'small')")
def prefix_any(spark, sf_dir):
    return Tables(spark, sf_dir).part.filter(tb.starts_with_any("p_name", ["red", "small"])).select("p_partkey")


@plan("FLT7", """SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'NaN' ELSE text END AS a, source FROM documents)
  WHERE lower(trim(a)) NOT IN ('', 'nan', 'none') AND lower(trim(source)) NOT IN ('', 'nan', 'none')""")
def complete_cases(spark, sf_dir):
    a = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 11 == 0, "NaN").otherwise(F.col("text"))
    return tb.complete_cases(Tables(spark, sf_dir).documents.select("doc_id", a.alias("a"), "source"), ["a", "source"]).select("doc_id")


@plan("FLT8", """WITH c AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS a,
  CASE WHEN c_custkey % 5 = 0 THEN ' not found ' ELSE c_name END AS b FROM customer),
  m AS (SELECT coalesce(lower(trim(a)) IN ('', 'unknown', 'not found'), true) AS ua, coalesce(lower(trim(b)) IN ('', 'unknown', 'not found'), true) AS ub FROM c)
  SELECT count(*) FILTER (NOT ua AND NOT ub) AS both_known, count(*) FILTER (NOT ua AND ub) AS only_a, count(*) FILTER (ua AND NOT ub) AS only_b, count(*) FILTER (ua AND ub) AS neither FROM m""")
def unknown_masks(spark, sf_dir):
    a = F.when(F.col("c_custkey") % 4 == 0, "Unknown").when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_mktsegment"))
    b = F.when(F.col("c_custkey") % 5 == 0, " not found ").otherwise(F.col("c_name"))
    m = Tables(spark, sf_dir).customer.select(a.alias("a"), b.alias("b")).select(tb.is_unknown("a").alias("ua"), tb.is_unknown("b").alias("ub"))
    return m.agg(
        F.count_if(~F.col("ua") & ~F.col("ub")).alias("both_known"), F.count_if(~F.col("ua") & F.col("ub")).alias("only_a"),
        F.count_if(F.col("ua") & ~F.col("ub")).alias("only_b"), F.count_if(F.col("ua") & F.col("ub")).alias("neither"),
    )


@plan("FLT9 FN1", "SELECT o_orderkey, CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998")
def plausible_years(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.withColumn("y", F.year("o_orderdate")).filter(F.col("y").between(1995, 1998))
    return o.select("o_orderkey", (F.floor(F.col("y") / 10) * 10).cast("bigint").alias("decade"))


@plan("FLT10", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
  SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_extendedprice NOT BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS outside
  FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def iqr_fence(spark, sf_dir):
    f = tb.tukey_fence(Tables(spark, sf_dir).lineitem.select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"], 0.5)
    return f.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("outside"))


@plan("FLT11", r"""SELECT count(*) FILTER (regexp_matches(p_name, '\(|\)')) AS parentheses, count(*) FILTER (regexp_matches(p_name, '^[a-zA-Z]{5,}[a-zA-Z]+$')) AS one_word,
  count(*) FILTER (regexp_matches(p_brand, '[0-9]')) AS digits, count(*) FILTER (length(p_type) < 6) AS short FROM part""")
def name_health(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.agg(
        F.count_if(F.rlike("p_name", F.lit(r"\(|\)"))).alias("parentheses"), F.count_if(F.rlike("p_name", F.lit("^[a-zA-Z]{5,}[a-zA-Z]+$"))).alias("one_word"),
        F.count_if(F.rlike("p_brand", F.lit("[0-9]"))).alias("digits"), F.count_if(F.length("p_type") < 6).alias("short"),
    )


@plan("FLT12", "SELECT count(*) AS changed FROM documents WHERE trim(text, chr(10)) IS DISTINCT FROM replace(text, '|', '')")
def changed_rows(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.trim("text", F.lit("\n")).alias("a"), F.replace("text", F.lit("|"), F.lit("")).alias("b"))
    return d.filter(tb.changed("a", "b")).agg(F.count("*").alias("changed"))


# --- joins ---


@plan("JN1 WN5", """SELECT c_nationkey, c_custkey, n_orders FROM (SELECT c_nationkey, c_custkey, count(*) OVER (PARTITION BY c_custkey) AS n_orders,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON c_custkey = o_custkey) WHERE rn = 1""")
def merge_then_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    both = t.customer.select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"))
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    first = wn.keep_first(both, ["c_nationkey"], [F.col("o_totalprice").desc(), "o_orderkey"])
    return first.join(n, "o_custkey").select("c_nationkey", "c_custkey", "n_orders")


@plan("JN2", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_scores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")


@plan("JN3", """SELECT pos, s_name, n_name FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, s_name FROM supplier)
  FULL JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name FROM nation) USING (pos)""")
def zip_by_position(spark, sf_dir):
    t = Tables(spark, sf_dir)
    z = jn.positional_zip(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    return z.select("pos", "s_name", "n_name")


@plan("JN4", """SELECT o_orderkey, p AS last_priority FROM orders JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) USING (o_custkey)""")
def lookup_last_wins(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    look = o.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("last_priority"))
    return jn.lookup_join(o.select("o_orderkey", "o_custkey"), look, ["o_custkey"], "o_orderkey", ["last_priority"]).select("o_orderkey", "last_priority")


@plan("JN5", """WITH f AS (SELECT trim(lang) AS a, substring(trim(text), 1, 100) AS k, arg_max('fixed ' || doc_id, doc_id) AS t FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
  SELECT doc_id, coalesce(t, text) AS text FROM documents d LEFT JOIN f ON trim(lang) = a AND substring(trim(text), 1, 100) = k""")
def composite_key_fix(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", F.trim("lang").alias("a"), F.substring(F.trim("text"), 1, 100).alias("k"))
    fixes = d.filter("doc_id % 3 = 0").select("a", "k", F.concat(F.lit("fixed "), F.col("doc_id").cast("string")).alias("text"), F.col("doc_id").alias("o"))
    return jn.overwrite_matched(d, fixes, ["a", "k"], "text", "o").select("doc_id", "text")


@plan("JN6 SNK6 ST4", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@plan("JN7", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi")


@plan("JN8 TX4", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ': ' || p_type ELSE p_name END AS title FROM part),
  k AS (SELECT DISTINCT title FROM t) SELECT p_partkey, CASE WHEN contains(t.title, ':') AND k.title IS NOT NULL THEN trim(split_part(t.title, ':', 1)) ELSE t.title END AS merged
  FROM t LEFT JOIN k ON trim(split_part(t.title, ':', 1)) = k.title""")
def merge_subtitles(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(": "), "p_type")).otherwise(F.col("p_name"))
    return jn.merge_subtitles(Tables(spark, sf_dir).part.select("p_partkey", title.alias("title")), "title").select("p_partkey", "merged")


# --- aggregates ---


@plan("AG1", """SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 7) AS mean, round(median(o_totalprice), 4) AS med, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY 1 HAVING count(*) >= 10""")
def grouped_having(spark, sf_dir):
    g = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 7).alias("mean"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 4).alias("med"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )
    return g.filter("n >= 10")


@plan("AG2", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(event_type) FROM events), 8) AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return ag.value_counts(Tables(spark, sf_dir).events, "event_type").withColumn("share", F.round("share", 8))


@plan("AG3", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_counts(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@plan("AG4 SI8 MT5", """SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS low, max(n_chars) AS high,
  round(quantile_cont(n_chars, 0.25), 4) AS q25, round(quantile_cont(n_chars, 0.5), 4) AS q50, round(quantile_cont(n_chars, 0.75), 4) AS q75 FROM documents GROUP BY 1""")
def describe_by_group(spark, sf_dir):
    d = ag.describe(Tables(spark, sf_dir).documents, "n_chars", ["lang"])
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@plan("AG5", r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents)
  GROUP BY 1 ORDER BY n DESC, token LIMIT 50""")
def token_frequency(spark, sf_dir):
    from ..functions.tokens import alnum

    return ag.token_counts(Tables(spark, sf_dir).documents, alnum(F.col("text"))).orderBy(F.col("n").desc(), "token").limit(50)


@plan("AG6", """SELECT conv_id, string_agg(role, '|||' ORDER BY turn) AS roles, arg_min(text, turn) AS first_text FROM conversations GROUP BY 1""")
def collect_joined(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    return c.groupBy("conv_id").agg(ag.joined_in_order("role", "turn", "|||").alias("roles"), F.min_by("text", "turn").alias("first_text"))


@plan("AG8", """SELECT 'doc_id' AS column, count(*) FILTER (doc_id IS NULL) AS nulls, count(DISTINCT doc_id) AS distinct_values, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) AS repeated_rows FROM labels
  UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(DISTINCT quality), count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) FROM labels
  UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(DISTINCT toxic), count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) FROM labels""")
def table_health(spark, sf_dir):
    return ag.health(Tables(spark, sf_dir).labels)


@plan("AG9", """SELECT sum(length(text)) AS original, sum(length(replace(text, ' ', ''))) AS cleaned, round(sum(length(replace(text, ' ', ''))) / sum(length(text)) * 100, 6) AS percent FROM documents""")
def character_retention(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("text")
    return ag.retention(d, d.select(F.replace("text", F.lit(" "), F.lit("")).alias("text")), "text").withColumn("percent", F.round("percent", 6))


@plan("AG10", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
  SELECT CAST(least(greatest(floor((l_extendedprice - lo) / (hi - lo) * 10), 0), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""")
def equal_width_bins(spark, sf_dir):
    return ag.equal_width_bins(Tables(spark, sf_dir).lineitem.select("l_extendedprice"), "l_extendedprice", 10)


@plan("AG11", """SELECT quality, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    return ag.confusion(Tables(spark, sf_dir).labels, "quality", "toxic", [0, 1])


@plan("AG13 WN7", """WITH r AS (SELECT c_acctbal + 1000 AS v, row_number() OVER (ORDER BY c_acctbal + 1000 DESC, c_custkey) AS rn, count(*) OVER () AS n, sum(c_acctbal + 1000) OVER () AS total FROM customer),
  h(head) AS (VALUES (0.01), (0.05), (0.1), (0.25), (0.5))
  SELECT CAST(head AS DOUBLE) AS head, count(*) AS rows, round(sum(v) / max(total), 8) AS share FROM r JOIN h ON rn <= floor(n * CAST(head AS DOUBLE)) GROUP BY 1""")
def concentration(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", (F.col("c_acctbal") + 1000).alias("v"))
    return ag.concentration(c, "v", "c_custkey", [0.01, 0.05, 0.1, 0.25, 0.5]).withColumn("share", F.round("share", 8))


@plan("AG14", """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def pivot_mean(spark, sf_dir):
    p = ag.pivot_mean(Tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity")
    return p.withColumns({"F": F.round("F", 6), "O": F.round("O", 6)})


@plan("AG15", """SELECT doc_id, metric, value FROM (UNPIVOT labels ON quality, toxic INTO NAME metric VALUE value)""")
def melt(spark, sf_dir):
    return ag.melt(Tables(spark, sf_dir).labels, ["doc_id"], ["quality", "toxic"])


@plan("AG16", r"""SELECT CAST(sum(len(regexp_extract_all(text, '\bthe\b'))) AS BIGINT) AS the, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS numbers, CAST(sum(len(regexp_extract_all(text, '[.!?]'))) AS BIGINT) AS stops FROM documents""")
def regex_totals(spark, sf_dir):
    return ag.regex_totals(Tables(spark, sf_dir).documents, "text", {"the": r"\bthe\b", "numbers": "[0-9]+", "stops": "[.!?]"})


@plan("AG17", """WITH y AS (SELECT year(o_orderdate) AS y FROM orders), m AS (SELECT y, count(*) AS n FROM y GROUP BY 1 ORDER BY n DESC, y LIMIT 1)
  SELECT (SELECT median(y) FROM y) AS med, (SELECT CAST(floor(y / 10) * 10 AS BIGINT) FROM m) AS mode_decade, (SELECT CAST(min(y) AS INT) FROM y) AS first_year, (SELECT CAST(max(y) AS INT) FROM y) AS last_year""")
def year_summary(spark, sf_dir):
    """Ties of the mode go to the earlier year."""
    y = Tables(spark, sf_dir).orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return y.agg(
        F.expr("percentile(y, 0.5, n)").alias("med"), (F.floor(F.max_by("y", F.struct("n", -F.col("y"))) / 10) * 10).cast("bigint").alias("mode_decade"),
        F.min("y").alias("first_year"), F.max("y").alias("last_year"),
    )


@plan("AG19", """SELECT r_name, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS nations, min(n_nationkey) AS earliest FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""")
def group_concat(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("nations"), F.min("n_nationkey").alias("earliest"))


# --- windows, top-k, sets ---


@plan("WN1", """SELECT doc_id, CASE WHEN count(*) OVER w = 50 THEN round(avg(n_chars) OVER w, 6) END AS rolling FROM documents
  WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark, sf_dir):
    d = wn.rolling_mean(Tables(spark, sf_dir).documents.select("doc_id", "lang", "n_chars"), "n_chars", ["n_chars", "doc_id"], 50, ["lang"])
    return d.select("doc_id", F.round("rolling", 6).alias("rolling"))


@plan("WN2", """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank FROM lineitem""")
def average_ranks(spark, sf_dir):
    return wn.average_ranks(Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@plan("WN3", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events")
def first_differences(spark, sf_dir):
    d = wn.differences(Tables(spark, sf_dir).events.select("event_id", "user_id", "value"), "value", "event_id", ["user_id"])
    return d.select("event_id", F.round("diff", 6).alias("diff"))


@plan("WN6 SIM3", """SELECT p_partkey, sum(CASE WHEN substr(p_name, 1, 5) = substr(prev, 1, 5) THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS island
  FROM (SELECT p_partkey, p_brand, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS prev FROM part)""")
def adjacent_islands(spark, sf_dir):
    p = wn.with_previous(Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_name"), ["p_name"], ["p_name", "p_partkey"], ["p_brand"])
    same = F.substring("p_name", 1, 5) == F.substring("__prev_p_name", 1, 5)
    return wn.adjacent_islands(p, ["p_name", "p_partkey"], same, ["p_brand"]).select("p_partkey", F.col("island").cast("bigint").alias("island"))


@plan("WN7", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS running_share FROM orders""")
def running_share(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    r = ag.running_share(o, "o_totalprice", [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_custkey"])
    return r.select("o_orderkey", F.round("running_share", 8).alias("running_share"))


@plan("WN9 SI4", """WITH p AS (SELECT p_partkey, p_brand, (p_retailprice - 899) / 2000 AS p FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS m FROM p)
  SELECT p_partkey, round(least(1.0, min(p * m / rn) OVER (PARTITION BY p_brand ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 8) AS p_adjusted FROM r""")
def benjamini_hochberg(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", ((F.col("p_retailprice") - 899) / 2000).alias("p"))
    return wn.benjamini_hochberg(p, "p", "p_partkey", ["p_brand"]).select("p_partkey", F.round("p_adjusted", 8).alias("p_adjusted"))


@plan("TK1 TK5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_rows(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@plan("TK2", "SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 20")
def top_per_source(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars")
    return wn.top_per_group(d, ["source"], [F.col("n_chars").desc(), "doc_id"], 20).select("source", "doc_id", F.col("rn").cast("bigint").alias("rn"))


@plan("TK3", """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS lo, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS hi, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT lang, doc_id, 'low' AS side, lo AS place FROM r WHERE n >= 40 AND lo <= 20 UNION ALL SELECT lang, doc_id, 'high', hi FROM r WHERE n >= 40 AND hi <= 20""")
def lowest_and_highest(spark, sf_dir):
    e = wn.both_ends(Tables(spark, sf_dir).documents.select("lang", "doc_id", "n_chars"), "n_chars", "doc_id", ["lang"])
    return e.select("lang", "doc_id", "side", F.col("place").cast("bigint").alias("place"))


@plan("TK4", "SELECT vec_id, list_position(embedding, list_max(embedding)) AS top, list_position(embedding, list_min(embedding)) AS bottom FROM embeddings")
def arg_extremes(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", *[F.array_position("embedding", f("embedding")).cast("int").alias(n) for f, n in ((F.array_max, "top"), (F.array_min, "bottom"))])


@plan("TK9", f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h_sql('doc_id')}, doc_id) AS place FROM documents")
def shuffled(spark, sf_dir):
    w = wn.Window.partitionBy("lang").orderBy(wn.shared_hash("doc_id"), "doc_id")
    return Tables(spark, sf_dir).documents.select("doc_id", F.row_number().over(w).cast("bigint").alias("place"))


@plan("ST1 ST2 ST3", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return tb.union_all([a, t.supplier.select(F.col("s_nationkey").alias("nation"))]).distinct()


@plan("ST4", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.select(F.col("c_nationkey").alias("nation")).subtract(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")))


@plan("ST5", "SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def set_intersection(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).intersect(t.part.filter("p_size > 25").select(F.col("p_partkey").alias("part")))


# --- samples ---


@plan("SM2", f"SELECT doc_id FROM documents ORDER BY {h_sql('doc_id')}, doc_id LIMIT 500")
def sample_uniform(spark, sf_dir):
    return wn.sample_n(Tables(spark, sf_dir).documents.select("doc_id"), "doc_id", 500)


@plan("SM3", f"SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY (quality IS NOT NULL) DESC, {h_sql('doc_id')}, doc_id LIMIT 450")
def sample_priority(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return wn.sample_priority(d, "doc_id", F.col("quality").isNotNull(), 450).select("doc_id")


@plan("SM4", f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln({u_sql('doc_id')}) / n_chars, doc_id LIMIT 200")
def sample_weighted(spark, sf_dir):
    return wn.sample_weighted(Tables(spark, sf_dir).documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 200).select("doc_id")


@plan("SM5", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {h_sql('doc_id')}, doc_id) AS rn FROM documents) WHERE rn = 1")
def sample_one_per_group(spark, sf_dir):
    return wn.one_per_group(Tables(spark, sf_dir).documents.select("source", "doc_id"), ["source"], "doc_id")


@plan("SM6", f"""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY {h_sql('doc_id')}, doc_id LIMIT 30),
  b AS (SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY {h_sql('doc_id')}, doc_id LIMIT 20)
  SELECT doc_id, 'first' AS section FROM a UNION ALL SELECT doc_id, 'second' FROM b""")
def sample_sections(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "source")
    a = wn.sample_n(d.filter("lang = 'fr'"), "doc_id", 30).select("doc_id")
    b = wn.sample_n(d.filter("source = 'src3'").join(a, "doc_id", "left_anti"), "doc_id", 20).select("doc_id")
    return a.withColumn("section", F.lit("first")).unionByName(b.withColumn("section", F.lit("second")))


@plan("SM7", f"""SELECT doc_id, CAST((row_number() OVER w - 1) % 5 AS INT) AS fold, row_number() OVER w <= floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) AS is_test FROM labels
  WINDOW w AS (PARTITION BY quality ORDER BY {h_sql('doc_id')}, doc_id)""")
def stratified_folds(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    return wn.stratified_split(wn.stratified_folds(l, "quality", "doc_id", 5), "quality", "doc_id").select("doc_id", "fold", "is_test")


@plan("SM8", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.4) THEN 'a' ELSE 'b' END AS part FROM documents")
def positional_split(spark, sf_dir):
    d = wn.upto(Tables(spark, sf_dir).documents.select("lang", "doc_id"), ["lang"], ["doc_id"], "place", total="n")
    return d.select("doc_id", F.when(F.col("place") <= F.floor(F.col("n") * 0.4), "a").otherwise("b").alias("part"))
