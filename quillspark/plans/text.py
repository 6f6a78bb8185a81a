"""Text cleaning, tokenisers, similarity and per-text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as cl
from ..functions import language as la
from ..functions import metrics as mt
from ..functions import similarity as sim
from ..functions import tokens as tk
from ..functions.rules import COLLAPSE, quoted, rules_sql, translate_sql
from ..operators import aggregates as ag
from .registry import Tables, plan


def _docs(spark, sf_dir, *more):
    return Tables(spark, sf_dir).documents.select("doc_id", "text", *more)


def _sql(rules, source: str = "text", table: str = "documents", key: str = "doc_id", out: str = "text") -> str:
    return f"SELECT {key}, {rules_sql(source, rules)} AS {out} FROM {table}"


_QUOTED = "chr(8220) || ' \"' || text || '\" ' || chr(8221) || ' ' || chr(8213)"


@plan("TX1", f"SELECT doc_id, {rules_sql(rules_sql(_QUOTED, cl.STRIP), cl.QUOTE_LAYER * 4)} AS text FROM documents")
def clean_quote(spark, sf_dir):
    wrapped = F.concat(F.lit('“ "'), "text", F.lit('" ” ―'))
    return _docs(spark, sf_dir).select("doc_id", cl.clean_quote(wrapped).alias("text"))


@plan("TX2", _sql(cl.CLEAN_WHITESPACE))
def clean_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.clean_whitespace(F.col("text")).alias("text"))


@plan("TX3", r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || '; ' || p_type WHEN 2 THEN p_name || ', ' || p_type
  WHEN 3 THEN '[''' || p_name || ''', ''' || p_type || ''']' ELSE p_name END AS tags FROM part)
  SELECT p_partkey, array_to_string(CASE WHEN tags IS NULL THEN [] WHEN starts_with(tags, '[') THEN list_transform(regexp_extract_all(tags, '''([^'']*)'''), lambda x: replace(x, '''', ''))
  WHEN contains(tags, ';') THEN list_transform(string_split(tags, ';'), lambda x: trim(x)) WHEN contains(tags, ',') THEN list_transform(string_split(tags, ','), lambda x: trim(x)) ELSE [tags] END, '|') AS tags FROM t""")
def standardize_tags(spark, sf_dir):
    p = Tables(spark, sf_dir).part.selectExpr("p_partkey", """CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || '; ' || p_type WHEN 2 THEN p_name || ', ' || p_type
      WHEN 3 THEN concat('[\\'', p_name, '\\', \\'', p_type, '\\']') ELSE p_name END AS tags""")
    return p.select("p_partkey", F.array_join(cl.standardize_tags(F.col("tags")), "|").alias("tags"))


@plan("TX5", f"SELECT p_partkey, {rules_sql(quoted('') + ' || p_name || ' + quoted(' (ed.) (2nd)'), cl.AUTHOR_PARENTHESES)} AS greedy, {rules_sql('p_name || ' + quoted(' (ed.) x (2nd)'), cl.TITLE_PARENTHESES)} AS lazy FROM part")
def strip_parentheses(spark, sf_dir):
    from ..functions.rules import apply_rules

    p = Tables(spark, sf_dir).part
    greedy = apply_rules(F.concat("p_name", F.lit(" (ed.) (2nd)")), cl.AUTHOR_PARENTHESES)
    return p.select("p_partkey", greedy.alias("greedy"), apply_rules(F.concat("p_name", F.lit(" (ed.) x (2nd)")), cl.TITLE_PARENTHESES).alias("lazy"))


@plan("TX6", f"SELECT item_id, CASE WHEN len({tk.split_words_sql('t')}) <= 3 THEN '' ELSE {rules_sql('t', cl.LIGHT_CLEAN)} END AS text FROM (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' - A Writer' ELSE '' END AS t FROM benchmark)")
def light_clean(spark, sf_dir):
    t = F.concat("text", F.when(F.col("item_id") % 2 == 0, " - A Writer").otherwise(""))
    return Tables(spark, sf_dir).benchmark.select("item_id", cl.light_clean(t).alias("text"))


_HEADER = "(length({x}) < 50 AND upper({x}) = {x} AND lower({x}) <> {x} AND NOT regexp_matches({x}, '[.?!][''\"\\x{{201d}}\\x{{2019}}]?$'))"


@plan("TX7 TX11", f"""SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[a-zA-Z]') AND NOT {_HEADER.format(x=rules_sql('x', cl.STRIP))}), chr(10)) AS text
  FROM (SELECT doc_id, upper(lang) || chr(10) || '- 12 -' || chr(10) || text AS t FROM documents)""")
def ocr_line_filter(spark, sf_dir):
    t = F.concat(F.upper("lang"), F.lit("\n- 12 -\n"), "text")
    return _docs(spark, sf_dir, "lang").select("doc_id", cl.ocr_lines(t).alias("text"))


@plan("TX7", f"SELECT doc_id, {rules_sql('text || ' + quoted(' Pages 3 to 12 are not shown in this preview. co-' + chr(10) + 'operate Copyrighted  Material'), cl.OCR_RULES)} AS text FROM documents")
def ocr_rules(spark, sf_dir):
    from ..functions.rules import apply_rules

    t = F.concat("text", F.lit(" Pages 3 to 12 are not shown in this preview. co-\noperate Copyrighted  Material"))
    return _docs(spark, sf_dir).select("doc_id", apply_rules(t, cl.OCR_RULES).alias("text"))


@plan("TX7 SIM5")
def ocr_credit_lines(spark, sf_dir):
    t = F.concat("source", F.lit("\n"), "text")
    return _docs(spark, sf_dir, "source", "lang").select("doc_id", cl.without_credit_lines(t, "source", "lang").alias("text"))


@plan("TX8", r"""SELECT item_id, CASE WHEN regexp_matches(t, '^[ \t\n\r]*[A-Za-z][ \t\n\r]+[A-Z]{2,}\b') THEN regexp_extract(t, '(?s)^[ \t\n\r]*([A-Za-z])[ \t\n\r]+([A-Z]{2,})\b(.*)$', 1) ||
  lower(regexp_extract(t, '(?s)^[ \t\n\r]*([A-Za-z])[ \t\n\r]+([A-Z]{2,})\b(.*)$', 2)) || regexp_extract(t, '(?s)^[ \t\n\r]*([A-Za-z])[ \t\n\r]+([A-Z]{2,})\b(.*)$', 3) ELSE t END AS text
  FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'T OMMY ' || text ELSE text END AS t FROM benchmark)""")
def drop_cap(spark, sf_dir):
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("T OMMY "), "text")).otherwise(F.col("text"))
    return Tables(spark, sf_dir).benchmark.select("item_id", cl.drop_cap(t).alias("text"))


@plan("TX9 TK-F")
def dialogue_sentences(spark, sf_dir):
    s = cl.trim_fragments(cl.merge_dialogue(tk.sentences(F.col("text"))))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("bigint").alias("n"), F.array_join(s, "\n").alias("text"))


@plan("TX10")
def remove_quote(spark, sf_dir):
    """Cuts benchmark items out of the texts of benchmark-bearing pages (an item within its own neighbourhood)."""
    b = Tables(spark, sf_dir).benchmark.withColumn("page", F.concat(F.lit("Before it. "), "text", F.lit("\nAfter it, more words.")))
    return b.select("item_id", cl.remove_fuzzy("page", "text").alias("text"))


@plan("TX11", f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {rules_sql('x', cl.STRIP)}), lambda x: regexp_matches(x, '[a-zA-Z0-9]')), chr(10)) AS text FROM documents""")
def alphanumeric_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.alphanumeric_lines(F.col("text")).alias("text"))


@plan("TX12", f"SELECT doc_id, {rules_sql('lower(text)', cl.MATCH_FORM)} AS text FROM documents")
def match_form(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.match_form(F.col("text")).alias("text"))


_CHAPTERED = "'CHAPTER XIV. ' || text || ' Chapter 7: end'"


@plan("TX13", f"SELECT doc_id, {rules_sql(_CHAPTERED, cl.CHAPTER)} AS text FROM documents")
def chapter_rules(spark, sf_dir):
    from ..functions.rules import apply_rules

    t = F.concat(F.lit("CHAPTER XIV. "), "text", F.lit(" Chapter 7: end"))
    return _docs(spark, sf_dir).select("doc_id", apply_rules(t, cl.CHAPTER).alias("text"))


@plan("TX13")
def chapters_recapitalised(spark, sf_dir):
    t = F.concat(F.lit("CHAPTER XIV. the start. "), "text")
    return _docs(spark, sf_dir).select("doc_id", cl.clean_chapters(t).alias("text"))


@plan("TX14", r"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 10 = 0 THEN ' Chapter 12 ' ELSE text END, '(?i)^[ \t\n\r\f\x0B]*CHAPTER[ \t\n\r\f\x0B]+\d+[ \t\n\r\f\x0B]*$', '', 'g') AS text FROM documents")
def blank_chapter_cells(spark, sf_dir):
    t = F.when(F.col("doc_id") % 10 == 0, " Chapter 12 ").otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", cl.blank_chapter_cell(t).alias("text"))


@plan("TX15", _sql(cl.NORMALIZE_WHITESPACE, "'  ' || text || chr(160) || chr(9)"))
def normalize_whitespace(spark, sf_dir):
    t = F.concat(F.lit("  "), "text", F.lit(" \t"))
    return _docs(spark, sf_dir).select("doc_id", cl.normalize_whitespace(t).alias("text"))


_SIGNS = "“x” ² -- [12] a…b ... ­"


@plan("TX16", f"SELECT doc_id, {rules_sql(translate_sql(f'nfc_normalize(text || {quoted(_SIGNS)})', *cl.TRANSLATE), cl.CLEAN_TEXT)} AS text FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.clean_text(F.concat("text", F.lit(_SIGNS))).alias("text"))


_MARKS = "_] do n't ( a ) tiger 's _so_ [ ] I 'm { _x_ }"


@plan("TX17", _sql(cl.NORMALIZE_TEXT, f"{quoted(_MARKS)} || text"))
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.normalize_text(F.concat(F.lit(_MARKS), "text")).alias("text"))


@plan("TX18", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'ye', 'g'), '(?i)\bof\b', 'o''', 'g') AS text FROM documents")
def word_corrections(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.corrections(F.col("text"), [("the", "ye"), ("of", "o'")]).alias("text"))


@plan("TX19", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
  k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark)
  SELECT token, count(*) AS n FROM t WHERE regexp_full_match(token, '[a-z]+') AND token NOT IN (SELECT token FROM k) GROUP BY 1""")
def spelling_candidates(spark, sf_dir):
    """Words that the lexicon (here the benchmark's words) lacks."""
    lexicon = Tables(spark, sf_dir).benchmark.select(F.explode(tk.alnum(F.col("text"))).alias("token")).distinct()
    words = _docs(spark, sf_dir).select(F.explode(tk.alnum(F.col("text"))).alias("token")).filter(F.rlike("token", F.lit("^[a-z]+$")))
    return words.groupBy("token").agg(F.count("*").alias("n")).join(lexicon, "token", "left_anti")


@plan("TX21", f"""WITH s AS (SELECT doc_id, unnest({tk.sentences_sql('text')}) AS s, generate_subscripts({tk.sentences_sql('text')}, 1) AS i FROM documents),
  q AS (SELECT doc_id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+') AS w FROM s WHERE i = 1)
  SELECT doc_id, count(*) AS n, count(*) FILTER (CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+')), list_distinct(w))) AS DOUBLE)
    / len(list_distinct(list_concat(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+'), w))) >= 0.5) AS dropped FROM s JOIN q USING (doc_id) WHERE len(w) > 0 GROUP BY 1""")
def sentence_quote_removal(spark, sf_dir):
    """How many sentences share half of their words with the quote (here the first sentence) and would go."""
    d = _docs(spark, sf_dir).select("doc_id", tk.sentences(F.col("text")).alias("s"))
    quote = tk.alnum(F.try_element_at("s", F.lit(1)))
    near = F.filter("s", lambda x: sim.token_jaccard(tk.alnum(x), quote) >= 0.5)
    return d.filter(F.size(quote) > 0).select("doc_id", F.size("s").cast("bigint").alias("n"), F.size(near).cast("bigint").alias("dropped"))


@plan("TX21")
def benchmark_sentence_removal(spark, sf_dir):
    """How many sentences of each document share half of their words with a benchmark item, whole or a sentence of it, and would go."""
    from ..operators.matching import near_sentences

    b = Tables(spark, sf_dir).benchmark.select(tk.sentences(F.col("text")).alias("s"), "text")
    quotes = b.select(F.explode(F.array_union(F.array("text"), "s")).alias("quote"))
    d = _docs(spark, sf_dir).select("doc_id", tk.sentences(F.col("text")).alias("s"))
    gone = near_sentences(d, "s", "doc_id", quotes, "quote", tk.alnum, 0.5)
    return d.select("doc_id", F.size("s").cast("bigint").alias("n")).join(gone, "doc_id", "left").select("doc_id", "n", F.coalesce("dropped", F.lit(0).cast("bigint")).alias("dropped"))


@plan("TX22", """SELECT page_id, split_part('x "' || url || '" inauthor:' || page_id, '"', 2) AS title, split_part('x "' || url || '" inauthor:' || page_id, 'inauthor:', 2) AS author FROM pages""")
def search_text(spark, sf_dir):
    p = Tables(spark, sf_dir).pages.select("page_id", F.concat(F.lit('x "'), "url", F.lit('" inauthor:'), F.col("page_id").cast("string")).alias("q"))
    return p.select("page_id", cl.quoted_query(F.col("q")).alias("title"), cl.query_author(F.col("q")).alias("author"))


@plan("TX23", "SELECT page_id, replace(url || '&printsec=frontcover', '&printsec=frontcover', '') || '&pg=PA7' AS url FROM pages")
def preview_links(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", cl.preview_link(F.concat("url", F.lit("&printsec=frontcover")), 7).alias("url"))


@plan("TX24", r"""SELECT o_orderkey, TRY_CAST(regexp_extract('in ' || CAST(year(o_orderdate) AS VARCHAR) || ' or so', '\b(1[0-9]{3}|20[0-2][0-9])\b', 1) AS INT) AS in_text,
  TRY_CAST(regexp_extract('+' || CAST(year(o_orderdate) AS VARCHAR) || '-01', '^\+?(\d{4})', 1) AS INT) AS leading FROM orders""")
def year_in_text(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    return Tables(spark, sf_dir).orders.select(
        "o_orderkey", cl.year_in(F.concat(F.lit("in "), y, F.lit(" or so"))).alias("in_text"), cl.year_in(F.concat(F.lit("+"), y, F.lit("-01")), cl.LEADING_YEAR).alias("leading")
    )


@plan("TX16 AG16", f"""WITH c AS (SELECT {rules_sql(translate_sql('text', *cl.TRANSLATE), cl.CLEAN_TEXT)} AS t FROM documents)
  SELECT {', '.join(f"CAST(sum(len(regexp_extract_all(t, {quoted(p)}))) AS BIGINT) AS {n}" for n, p in cl.RESIDUE.items())} FROM c""")
def residue_after_cleaning(spark, sf_dir):
    d = _docs(spark, sf_dir).select(cl.clean_text(F.col("text"), normalize=False).alias("t"))
    return ag.regex_totals(d, "t", cl.RESIDUE)


# --- tokenisers ---


@plan("TK-A FLT5", f"SELECT doc_id, CAST(len({tk.split_words_sql('text')}) AS BIGINT) AS n FROM documents WHERE len({tk.split_words_sql('text')}) >= 3")
def whitespace_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tk.n_words(F.col("text")).cast("bigint").alias("n")).filter("n >= 3")


@plan("TK-B")
def treebank_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(tk.treebank(F.col("text"))).cast("bigint").alias("n"))


@plan("TK-C", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')) AS digest FROM documents")
def alnum_words(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tk.alnum(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@plan("TK-D", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z'']*[a-z][a-z'']*')) AS BIGINT) AS n FROM documents")
def alphabetic_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(tk.alphabetic(F.col("text"))).cast("bigint").alias("n"))


@plan("TK-E", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_'']+|[.,!?;]')) AS BIGINT) AS n FROM documents")
def words_and_marks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(tk.words_and_marks(F.col("text"))).cast("bigint").alias("n"))


@plan("TK-F MT5", f"SELECT doc_id, CAST(len({tk.sentences_sql('text')}) AS BIGINT) AS n, md5(array_to_string({tk.sentences_sql('text')}, '|')) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tk.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


# --- similarity ---


@plan("SIM1 JN11", """SELECT a.p_partkey, round((1 - levenshtein(a.p_name, b.p_type)::DOUBLE / greatest(length(a.p_name), length(b.p_type))) * 100, 6) AS score
  FROM part a JOIN part b USING (p_partkey) WHERE levenshtein(a.p_name, b.p_type)::DOUBLE / greatest(length(a.p_name), length(b.p_type)) <= 0.8""")
def edit_similarity(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", sim.edit_ratio(F.col("p_name"), F.col("p_type")).alias("score"))
    return p.filter("score >= 20").withColumn("score", F.round("score", 6))


@plan("SIM1 SIM2 SIM3 SIM4 SIM5")
def similarity_scores(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    other = F.concat(F.lit("the "), "p_name", F.lit(" "), F.lower("p_type"))
    return p.select("p_partkey", *[sim.score(k, F.col("p_name"), other).alias(k) for k in sim.SCORES])


@plan("SIM6", "SELECT p_partkey, contains(p_name, 'red') OR contains(p_name, 'ring') AS flagged FROM part")
def keyword_flags(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", sim.contains_any(F.col("p_name"), ["red", "ring"]).alias("flagged"))


@plan("SIM4 JN9", """WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, ' ')) AS w FROM part)
  SELECT a.p_partkey, b.p_partkey AS other, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS score
  FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.3""")
def blocked_token_match(spark, sf_dir):
    """Pairs of all parts of one brand that share three in ten words."""
    from ..operators.joins import self_match

    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_name")
    return self_match(p, "p_partkey", ["p_brand"], "p_name", lambda a, b: sim.token_jaccard(F.split(a, " "), F.split(b, " ")), 0.3, digits=6)


@plan("JN9 JN11 SIM4")
def blocked_fuzzy_match(spark, sf_dir):
    """Names of one brand with a token-set ratio of 90 or more: links of different names by their first parts, and each name's other parts."""
    from ..operators.joins import class_match

    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_name")
    return class_match(p, "p_partkey", ["p_brand"], "p_name", lambda a, b: sim.score("token_set_ratio", a, b), 90)


@plan("JN10", """WITH k AS (SELECT s_suppkey AS id, 'NATION_' || (s_nationkey % 30) AS title FROM supplier),
  c AS (SELECT id, title, n_name, n_nationkey, CASE WHEN title = n_name THEN 1 WHEN starts_with(n_name, title) THEN 2 ELSE 3 END AS stage,
    (1 - levenshtein(title, n_name)::DOUBLE / greatest(length(title), length(n_name))) * 100 AS score FROM k JOIN nation ON substr(title, 1, 7) = substr(n_name, 1, 7))
  SELECT id, n_name, stage FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, score DESC, n_nationkey) AS rn FROM c WHERE stage < 3 OR score > 80) WHERE rn = 1""")
def best_match_cascade(spark, sf_dir):
    """Exact title, then title prefix, then best similarity over 80; ties go to the first."""
    from ..operators.joins import best_match

    t = Tables(spark, sf_dir)
    k = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("NATION_"), (F.col("s_nationkey") % 30).cast("string")).alias("title"))
    c = k.join(t.nation.select("n_name", "n_nationkey"), F.substring("title", 1, 7) == F.substring("n_name", 1, 7))
    stage = F.when(F.col("title") == F.col("n_name"), 1).when(F.col("n_name").startswith(F.col("title")), 2).otherwise(3)
    c = c.withColumns({"stage": stage, "score": sim.edit_ratio(F.col("title"), F.col("n_name"))}).filter("stage < 3 OR score > 80")
    return best_match(c, ["id"], "stage", "score", "n_nationkey").select("id", "n_name", "stage")


# --- scalars ---


@plan("FN7 SRC6", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || '}' AS next FROM events")
def json_fields(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct((F.col("p.k") + 1).alias("k"))).alias("next"))


@plan("FN8 FN2", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 1000, 1) AS even, round(log2(l_quantity), 6) AS bits, round(sqrt(l_quantity), 6) AS root FROM lineitem")
def rounding(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", F.bround(F.col("l_extendedprice") / 1000, 1).alias("even"), F.round(F.log2("l_quantity"), 6).alias("bits"), F.round(F.sqrt("l_quantity"), 6).alias("root")
    )


@plan("FN9 SI9", """SELECT p_partkey, printf('%+.2f', (p_size - 25) / 25.0) || CASE WHEN p_size < 2 THEN '***' WHEN p_size < 10 THEN '**' WHEN p_size < 30 THEN '*' ELSE '' END AS shown FROM part""")
def stars(spark, sf_dir):
    p = F.when(F.col("p_size") < 2, 0.0005).when(F.col("p_size") < 10, 0.005).when(F.col("p_size") < 30, 0.02).otherwise(0.5)
    return Tables(spark, sf_dir).part.select("p_partkey", mt.with_stars((F.col("p_size") - 25) / 25.0, p).alias("shown"))


@plan("FN3 MT9", "SELECT event_id, round(value / ln(2), 6) AS bits, round(power(2, -least(value / ln(2), 50)), 10) AS probability, round(exp(least(value, 20)), 4) AS perplexity FROM events")
def surprisal_units(spark, sf_dir):
    bits = mt.nats_to_bits(F.col("value"))
    return Tables(spark, sf_dir).events.select(
        "event_id", F.round(bits, 6).alias("bits"), F.round(F.pow(F.lit(2.0), -F.least(bits, F.lit(50.0))), 10).alias("probability"),
        F.round(mt.perplexity(F.least("value", F.lit(20.0))), 4).alias("perplexity"),
    )


@plan("FN5 FN6", "SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:3], '>') AS head, list(role ORDER BY turn)[1] AS first_role FROM conversations GROUP BY 1")
def array_slices(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    firsts = F.map_from_entries(F.slice(F.transform("t", lambda x: F.struct(x["turn"], x["role"])), 1, 1))
    return c.select("conv_id", F.array_join(F.slice(roles, 1, 3), ">").alias("head"), F.element_at(F.map_values(firsts), 1).alias("first_role"))


# --- per-text metrics ---

_WORDS = tk.split_words_sql("text")
_SYLL = f"list_sum(list_transform({_WORDS}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '{mt.VOWELS}')))))"
_COUNTS = f"""SELECT doc_id, lang, len({_WORDS})::DOUBLE AS w, greatest(1, len({tk.sentences_sql('text')}))::DOUBLE AS s, {_SYLL}::DOUBLE AS y,
  length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE AS l FROM documents"""


@plan("MT1 MT2", f"""SELECT doc_id, round(CASE WHEN w >= 10 THEN 206.835 - 1.015 * w / s - 84.6 * y / w END, 6) AS flesch, round(CASE WHEN w >= 10 THEN 0.0588 * (l / w * 100) - 0.296 * (s / w * 100) - 15.8 END, 6) AS coleman_liau FROM ({_COUNTS})""")
def readability(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in mt.counts(F.col("text")).items()])
    w, s, y, l = (F.col(f"n_{x}") for x in ("words", "sentences", "syllables", "letters"))
    return d.select("doc_id", F.round(mt.flesch(w, s, y), 6).alias("flesch"), F.round(mt.coleman_liau(w, s, l), 6).alias("coleman_liau"))


@plan("MT3")
def lexical_diversity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(mt.mtld(tk.alnum(F.col("text"))), 6).alias("mtld"))


_ENTROPY = r"""SELECT doc_id, any_value(lang) AS lang, CASE WHEN sum(c) >= 10 THEN log2(sum(c)) - sum(c * log2(c)) / sum(c) END AS entropy FROM
  (SELECT doc_id, any_value(lang) AS lang, count(*) AS c FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY doc_id, t) GROUP BY doc_id"""


@plan("MT4", f"SELECT doc_id, round(e.entropy, 6) AS entropy FROM documents LEFT JOIN ({_ENTROPY}) e USING (doc_id)")
def entropy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(mt.entropy(F.col("text")), 6).alias("entropy"))


@plan("MT4 AG4 SI8", f"""SELECT lang, count(entropy) AS n, round(avg(entropy), 6) AS mean, round(stddev_samp(entropy), 6) AS std, round(min(entropy), 6) AS low, round(max(entropy), 6) AS high,
  round(quantile_cont(entropy, 0.25), 6) AS q25, round(quantile_cont(entropy, 0.5), 6) AS q50, round(quantile_cont(entropy, 0.75), 6) AS q75 FROM ({_ENTROPY}) GROUP BY lang""")
def entropy_by_lang(spark, sf_dir):
    d = _docs(spark, sf_dir, "lang").select("lang", mt.entropy(F.col("text")).alias("entropy"))
    out = ag.describe(d, "entropy", ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "low", "high", "q25", "q50", "q75")})


@plan("MT5", f"""SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, length(text) AS n_code_points, round(CASE WHEN len({_WORDS}) > 0 THEN len(list_distinct({_WORDS}))::DOUBLE / len({_WORDS}) END, 6) AS ttr FROM documents""")
def text_lengths(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("bigint").alias("n_code_points"), tk.split_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), "n_code_points", F.round(mt.type_token_ratio(F.col("w")), 6).alias("ttr"))


@plan("PRJ2 TX2", _sql(COLLAPSE))
def collapse_spaces(spark, sf_dir):
    from ..functions.rules import apply_rules

    return _docs(spark, sf_dir).select("doc_id", apply_rules(F.col("text"), COLLAPSE).alias("text"))


_VOTES = ", ".join(f"{{'n': -len(list_filter(w, lambda x: x IN {ws})), 'lang': '{k}'}}" for k, ws in la.FUNCTION_WORDS.items())


@plan("FLT6", f"""WITH w AS (SELECT doc_id, text, {tk.alnum_sql('text')} AS w FROM documents), v AS (SELECT doc_id, text, list_min([{_VOTES}]) AS b FROM w)
  SELECT doc_id FROM v WHERE len({tk.split_words_sql('text')}) >= 3 AND length(text) >= 4 AND b.n < 0 AND b.lang = 'en'""")
def language_predicate(spark, sf_dir):
    return _docs(spark, sf_dir).filter(la.is_language(F.col("text"))).select("doc_id")
