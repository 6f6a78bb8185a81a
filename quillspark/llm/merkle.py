"""Merkle manifest: one hash tree over the documents of each group, one over the groups' roots, a proof for every document.

Leaves are dealt by ranges of (group, order) as an RDD, so that a group of any size is spread over many
tasks. How many leaves of its first and last group each partition holds gives, for the whole RDD, the place of every
leaf in its group; a partition then builds alone every subtree whose leaves it holds. The nodes at its ragged edges,
some for each level, meet the other partitions' by their coordinates (group, level, run) until each group has its
root. A last pass hands every partition the few runs that it lacked and writes the proofs.

Null groups are a group of their own, the first; null fields are a mark that no value gives; empty and very long texts
are hashed whole. Rows of equal order stand by their leaf's digest; repeated rows are leaves each. Other columns of any
name are left alone. An empty table has an empty manifest.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_places

#: Children of a node.
FAN = 8
#: Leaves that a partition holds, about.
PART_ROWS = 200_000
#: Keys drawn for each partition to find the ranges.
DRAWN = 40

PROOF = "array<struct<before:string,after:string>>"
_FOUND = "kind string, part int, g string, level int, idx long, total long, digest string"


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """order, group, leaf, subroot, root, proof of every row, and the columns of ``carry``, computed from the row.

    A proof lists, level by level up to the root, the digests before and after the node on the path, joined.
    """
    carry = carry or {}
    placed, places = with_places(docs)
    names = [f"c{n}" for n in range(len(carry))]
    leaves = materialize(
        placed.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("leaf"),
                      *[F.col(p).alias(f"p{n}") for n, p in enumerate(places)], *[c.alias(n) for n, c in zip(names, carry.values())])
    )
    spark, kinds = docs.sparkSession, [leaves.schema[n].dataType for n in names]
    schema = T.StructType().add(order, leaves.schema["o"].dataType).add(group, "string")
    for name in ("leaf", "subroot", "root"):
        schema = schema.add(name, "string")
    schema = schema.add("proof", T.DataType.fromDDL(PROOF))
    for name, kind in zip(carry, kinds):
        schema = schema.add(name, kind)
    n = leaves.count()
    if not n:
        return spark.createDataFrame([], schema)
    rows = leaves.rdd.map(lambda r: ((_coded(r[0]), (r[1] is not None, r[1]), bytes(r[2]), r[3], r[4]), tuple(r[5:])))
    forest = _Forest(rows, n, _width(leaves, n))
    tops = forest.subroots.rdd.map(lambda r: (("", (True, r["g"]), bytes.fromhex(r["digest"]), 0, 0), ()))
    crown = _Forest(tops, groups := forest.subroots.count(), max(1, groups // PART_ROWS))
    top = materialize(spark.createDataFrame(crown.proofs(None).map(lambda x: (x[0][1][1], x[1], x[2], x[3])), f"g string, subroot string, root string, top {PROOF}"))

    def row(x: tuple) -> tuple:
        key, leaf, head, proof, kept = x
        subroot, root, above = head
        return (key[1][1], _decoded(key[0]), leaf, subroot, root, [*proof, *above], *kept)

    return spark.createDataFrame(forest.proofs(top).map(row), schema, verifySchema=False)


def _width(df: DataFrame, n: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))


def _coded(group: str | None) -> str:
    """A text in whose order null comes first."""
    return "0" if group is None else "1" + group


def _decoded(group: str) -> str | None:
    return None if group == "0" else group[1:]


def _h(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _own(part: int) -> int:
    return part


def grow(digests: list[str], start: int, total: int) -> list[tuple[int, list[str], int]]:
    """Of each level (first index, nodes, nodes of the whole level): all whose leaves are among the given ones.

    The given ones stand from ``start`` on in a level of ``total`` nodes.
    """
    levels = [(start, digests, total)]
    while total > 1:
        above, stop = -(-total // FAN), start + len(digests)
        first, last = -(-start // FAN), above if stop == total else stop // FAN
        digests = [_h(digests[FAN * j - start : FAN * (j + 1) - start]) for j in range(first, last)]
        start, total = first, above
        levels.append((start, digests, total))
    return levels


class _Forest:
    """Trees of 8 over the groups of an RDD of (key, kept); a key is (group, order, digest, place, place)."""

    def __init__(self, rows: RDD, n: int, width: int):
        bounds = _bounds(rows, n, width)
        near = lambda kv: (bisect.bisect_left(bounds, kv[0]), kv)
        # The partition number is the key, so that what is sent to a partition later finds it without another shuffle.
        dealt = rows.map(near).partitionBy(width, _own)
        self.rows = dealt.mapPartitions(lambda part: iter(sorted(part, key=lambda x: x[1][0])), preservesPartitioning=True)
        self.where = _offsets(self.rows.mapPartitions(_ends).collect())
        self.found = materialize(_session().createDataFrame(self.rows.mapPartitions(_builder(self.where)), _FOUND, verifySchema=False))
        self._finish()

    def _finish(self) -> None:
        """Joins ragged nodes level by level into ``runs`` (g, level, run, nodes) and ``subroots`` (g, digest)."""
        self.subroots, self.runs = self.found.filter("kind = 'root'").select("g", "digest"), None
        ragged = self.found.filter("kind = 'node'").select("g", "level", "idx", "total", "digest")
        longest, level, built = max((t for ends in self.where.values() for _, _, t in ends), default=0), 0, None
        while longest > 1:
            here = ragged.filter(F.col("level") == level).drop("level")
            here = here.unionByName(built) if built is not None else here
            nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
            runs = materialize(here.groupBy("g", F.expr(f"idx div {FAN}").alias("run")).agg(nodes.alias("nodes"), F.max("total").alias("total")))
            up = runs.select("g", F.col("run").alias("idx"), F.ceil(F.col("total") / FAN).alias("total"), F.sha2(F.array_join("nodes", ""), 256).alias("digest"))
            self.subroots = self.subroots.unionByName(up.filter("total = 1").select("g", "digest"))
            built = up.filter("total > 1")
            runs = runs.select("g", F.lit(level).alias("level"), "run", "nodes")
            self.runs = runs if self.runs is None else self.runs.unionByName(runs)
            longest, level = -(-longest // FAN), level + 1

    def proofs(self, top: DataFrame | None) -> RDD:
        """(key, digest, head, proof, kept) of every row; head is the row's group in ``top``, or else its group's root."""
        asks = self.found.filter("kind = 'ask'").select("part", "g", "level", F.col("idx").alias("run"))
        spans = self.found.filter("kind = 'span'").select("part", "g")
        if top is None:
            sent = spans.join(self.subroots, "g").rdd.map(lambda r: (r["part"], (None, r["g"], r["digest"])))
        else:
            sent = spans.join(top, "g").rdd.map(lambda r: (r["part"], (None, r["g"], (r["subroot"], r["root"], [tuple(x) for x in r["top"]]))))
        if self.runs is not None:
            lacked = asks.join(self.runs, ["g", "level", "run"])
            sent = sent.union(lacked.rdd.map(lambda r: (r["part"], (None, r["g"], r["level"], r["run"], list(r["nodes"])))))
        # Both sides lie by partition number already: what was sent comes first, then the sorted rows.
        both = sent.partitionBy(self.rows.getNumPartitions(), _own).union(self.rows)
        return both.mapPartitions(_prover(self.where))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def _bounds(rows: RDD, n: int, width: int) -> list:
    """Keys that part the rows into ``width`` ranges of about equal size: DRAWN keys for each come to the driver."""
    drawn = sorted(rows.keys().sample(False, min(1.0, DRAWN * width / n), 1).collect()) if width > 1 else []
    return [drawn[len(drawn) * k // width] for k in range(1, width)] if drawn else []


def _ends(part: Iterator) -> Iterator[tuple]:
    """(part, first group, its rows, last group, its rows) of a partition with rows; no last where there is one group. Groups as digests."""
    number, first, last, groups = None, None, None, 0
    for g, rows in itertools.groupby(part, key=lambda x: (x[0], x[1][0][0])):
        number, groups = g[0], groups + 1
        last = (_h([g[1]]), sum(1 for _ in rows))
        first = first or last
    if first:
        yield number, first, last if groups > 1 else None


def _offsets(ends: list[tuple]) -> dict[int, list[tuple[str, int, int]]]:
    """For the first and last group of each partition, if it reaches into others: (group, rows of it before, rows of it in all)."""
    pieces = [(number, *piece) for number, first, last in sorted(ends) for piece in (first, last) if piece]
    out: dict[int, list] = {}
    for group, own in itertools.groupby(pieces, key=lambda x: x[1]):
        own, before = list(own), 0
        total = sum(count for _, _, count in own)
        for number, _, count in own if len(own) > 1 else ():
            out.setdefault(number, []).append((group, before, total))
            before += count
    return out


def _groups(part: Iterable, where: dict) -> Iterator[tuple]:
    """(part, group, rows, levels) of each group of a partition, in order."""
    for (number, g), rows in itertools.groupby(part, key=lambda x: (x[0], x[1][0][0])):
        rows, name = [x[1] for x in rows], _h([g])
        before, total = next(((b, t) for h, b, t in where.get(number, ()) if h == name), (0, len(rows)))
        yield number, g, rows, grow([key[2].hex() for key, _ in rows], before, total)


def _builder(where: dict):
    def build(part: Iterator) -> Iterator[tuple]:
        for number, g, rows, levels in _groups(part, where):
            yield "span", number, g, 0, 0, 0, ""
            first, last = levels[0][0], levels[0][0] + len(rows) - 1
            for level, (start, nodes, total) in enumerate(levels[:-1]):
                begin, up, _ = levels[level + 1]
                done = range(begin, begin + len(up))
                yield from (("node", number, g, level, start + k, total, x) for k, x in enumerate(nodes) if (start + k) // FAN not in done)
                first, last = first // FAN, last // FAN
                yield from (("ask", number, g, level, run, 0, "") for run in {first, last} if run not in done)
            if levels[-1][1]:
                yield "root", number, g, 0, 0, 0, levels[-1][1][0]

    return build


class _Paths:
    """Siblings on the way from a node to its group's root; neighbours share what lies above them."""

    def __init__(self, levels: list, sent: dict[tuple[int, int], list[str]]):
        self.levels, self.sent = levels, sent
        self.last: list[tuple] = [(None, None, None)] * len(levels)

    def run(self, level: int, run: int) -> list[str]:
        start, nodes, _ = self.levels[level]
        begin, up, _ = self.levels[level + 1]
        return nodes[FAN * run - start : FAN * (run + 1) - start] if begin <= run < begin + len(up) else self.sent[level, run]

    def of(self, level: int, idx: int) -> list[tuple[str, str]]:
        if level + 1 == len(self.levels):
            return []
        run = idx // FAN
        if self.last[level][0] != run:
            self.last[level] = (run, self.run(level, run), self.of(level + 1, run))
        _, nodes, above = self.last[level]
        return [("".join(nodes[: idx % FAN]), "".join(nodes[idx % FAN + 1 :])), *above]


def _prover(where: dict):
    def prove(part: Iterator) -> Iterator[tuple]:
        heads, sent = {}, {}

        def rest() -> Iterator:
            for x in part:
                if x[1][0] is not None:
                    yield x
                elif len(x[1]) == 3:
                    heads[x[1][1]] = x[1][2]
                else:
                    sent.setdefault(x[1][1], {})[x[1][2], x[1][3]] = x[1][4]

        for _, g, rows, levels in _groups(rest(), where):
            paths, start = _Paths(levels, sent.get(g, {})), levels[0][0]
            for k, (key, kept) in enumerate(rows):
                yield key, key[2].hex(), heads[g], paths.of(0, start + k), kept

    return prove
