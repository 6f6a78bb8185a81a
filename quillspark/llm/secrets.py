"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: a
literal run demands its trigrams, an alternation demands one of its branches. The
index posts, for every trigram that the queries name, the documents that hold it;
postings are intersected per branch and only candidates are verified with the
expression itself. Rules without mandatory trigrams read every text.

Spans come from cutting a text at the matches: the lengths of what lies between
and of the matches add up to their places in code points.

Texts are not shuffled: the candidates, (id, hash, rules) rows, are written and come to
the texts by broadcast while there are at most ``BROADCAST_ROWS`` of them (some 100 bytes
each). Beyond that only the candidates' texts move, and the narrow results meet by key.

Defined cases: null text counts as empty; offsets are code points, end exclusive;
matches are leftmost and without overlap within a rule; rows are told apart by id
and text, so repeated rows and null ids are answered each by itself; an empty table
gives no rows; very long texts are read whole; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: So many candidate rows are sent to all executors at most.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the group (0: all) that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Base rules first, as the contract lists them; group 0 and a length go into hex and access as a bound on the run.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


# --- Boolean trigram queries: a query is a set of alternatives, each a set of trigrams that must all occur. ---


def literals(pattern: str) -> list[list[str]]:
    """Alternatives, each a list of lower-case literal runs that a match must contain."""

    def walk(items) -> list[list[str]]:
        """Runs of a sequence; the first and last may still grow, marked by open ends."""
        ways: list[list[str]] = [[""]]
        for op, arg in items:
            if op is rc.LITERAL:
                ways = [[*w[:-1], w[-1] + chr(arg).lower()] for w in ways]
                continue
            if op is rc.SUBPATTERN:
                parts = walk(arg[3])
            elif op is rc.BRANCH:
                parts = [p for branch in arg[1] for p in walk(branch)]
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
                low, high, body = arg
                if low == 0 and high == 1:
                    parts = [[""], *walk(body)]
                elif low >= 1:
                    once = walk(body)
                    parts = [[*w, ""] for w in once] if high > 1 else once
                else:
                    parts = [["", ""]]
            elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
                parts = [[chr(c).lower()] for _, c in arg]
            elif op is rc.AT:
                parts = [[""]]
            else:
                parts = [["", ""]]
            if len(ways) * len(parts) > 64:
                parts = [["", ""]]
            ways = [[*w[:-1], w[-1] + p[0], *p[1:]] for w in ways for p in parts]
        return ways

    return walk(rp.parse(pattern))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams; None if some way to match has none."""
    ways = {frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in literals(pattern)}
    if not all(ways):
        return None
    return sorted((w for w in ways if not any(o < w for o in ways)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], key: list[str], text: str) -> DataFrame:
    """Postings (trigram, key): which documents hold which of the trigrams, letter case aside."""
    lower = docs.select(*key, F.lower(text).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return lower.select(F.explode(held).alias("trigram"), *key)


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], key: list[str]) -> DataFrame:
    """(key, kinds): the documents that lie in all postings of an alternative, with the kinds of its rules."""
    rows = [(kind, n, t, len(way)) for kind, ways in sorted(queries.items()) for n, way in enumerate(ways) for t in sorted(way)]
    wants: dict[str, list[str]] = {}
    for kind, n, t, size in rows:
        wants.setdefault(t, []).append(f"named_struct('kind', '{kind}', 'way', {n}, 'size', {size})")
    demand = F.create_map(*[x for t, w in wants.items() for x in (F.lit(t), F.expr(f"array({', '.join(w)})"))])
    each = index.select(*key, "trigram", F.explode(demand[F.col("trigram")]).alias("d")).select(*key, "trigram", "d.*")
    met = each.groupBy(*key, "kind", "way", "size").agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return met.groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    fit = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.transform(F.split(text, rule.pattern), lambda x: F.length(x).cast("long"))
    sizes = F.transform(hits, lambda x: F.length(x).cast("long"))
    walked = F.zip_with(gaps, F.zip_with(sizes, F.transform(fit, F.length), lambda s, f: F.struct(s.alias("size"), f.alias("fit"))), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    out = "CAST(array() AS array<struct<start:bigint,end:bigint,kind:string>>)"

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["m"]["size"], F.lit(0).cast("long"))
        own = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["m"]["fit"] >= rule.least, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    def spans(block: Column, before: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), F.expr(out).alias("out")), step, lambda acc: acc["out"])

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + F.coalesce(x["m"]["size"], F.lit(0).cast("long")))

    def whole(steps: Column) -> Column:
        """Block by block of about the root of the matches, so that no long array is copied for each match."""
        size = F.ceil(F.sqrt(F.size(steps).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), size), lambda i: F.slice(steps, i, size))
        return _let(blocks, lambda held: _let(F.aggregate(F.transform(held, length), F.array(F.lit(0).cast("long")), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))), lambda before: F.flatten(F.zip_with(held, F.slice(before, 1, F.size(held)), spans))))

    return _let(walked, whole)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a variable of a lambda, where a column would be computed at each use."""
    return F.transform(F.array(value), body)[0]


EMPTY = "CAST(array() AS array<struct<start:bigint,end:bigint,kind:string>>)"


def _verified(rules: list[Rule], posted: bool) -> Column:
    """Spans of the rules in a text; those ``posted`` only where the column ``kinds`` names them."""
    parts = [F.expr(EMPTY)]
    for r in rules:
        hit = F.rlike(F.col("text"), F.lit(r.pattern))
        if posted:
            hit = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & hit
        parts.append(F.when(hit, match_spans(F.col("text"), r)).otherwise(F.expr(EMPTY)))
    return F.concat(*parts)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id and spans (start, end, kind) by start, then kind in order of the rules."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for way in q for t in way})
    posted, whole = [r for r in rules if r.kind in queries], [r for r in rules if r.kind not in queries]
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h"))
    found = keyed.select("doc_id", _verified(whole, False).alias("spans"))
    if posted:
        key = ["doc_id", "h"]
        told = materialize(candidates(trigram_index(keyed, trigrams, key, "text"), queries, key).toDF("c_id", "c_h", "kinds"))
        if told.count() <= broadcast_rows:
            near = keyed.join(F.broadcast(told), same, "left")
            found = near.select("doc_id", F.concat(_verified(whole, False), _verified(posted, True)).alias("spans"))
        else:
            near = keyed.join(told.hint("shuffle_hash"), same)
            more = near.select("c_id", "c_h", _verified(posted, True).alias("more")).dropDuplicates(["c_id", "c_h"])
            narrow = keyed.select("doc_id", "h", _verified(whole, False).alias("spans"))
            found = narrow.join(more, same, "left").select("doc_id", F.concat("spans", F.coalesce("more", F.expr(EMPTY))).alias("spans"))
    order = {r.kind: n for n, r in enumerate(rules)}
    number = lambda s: F.create_map(*[F.lit(x) for k, n in order.items() for x in (k, n)])[s["kind"]]
    compare = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(number(a) - number(b))
    return found.select("doc_id", F.array_sort("spans", compare).alias("spans"))
