"""Rewriting rules that two engines read alike.

A rule is (pattern, replacement) with ``\\1`` for groups. Patterns keep to what both
Java and RE2 know: no look-around, and classes written out instead of ``\\w`` and ``\\s``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]
W = r"[\p{L}\p{N}_]"
S = r"[ \t\n\r\f\x0B]"
STRIP: list[Rule] = [(rf"^{S}+", ""), (rf"{S}+$", "")]
COLLAPSE: list[Rule] = [(rf"{S}+", " "), *STRIP]


_FAR = re.compile(r"\[((?:\\x\{[0-9A-Fa-f]{4}\}-?)+)\]")


def for_java(pattern: str) -> str:
    """The same pattern, whose classes of listed signs ask first whether a sign lies between the least and the greatest of them."""

    def ranged(m: re.Match) -> str:
        codes = sorted(int(x, 16) for x in re.findall(r"\{(\w+)\}", m[1]))
        return rf"[\x{{{codes[0]:04X}}}-\x{{{codes[-1]:04X}}}&&[{m[1]}]]"

    return _FAR.sub(ranged, pattern)


def apply_rules(c: Column, rules: Sequence[Rule]) -> Column:
    for pattern, new in rules:
        new = new.replace("$", r"\$")
        for k in range(1, 5):
            new = new.replace(f"\\{k}", f"${k}")
        c = F.regexp_replace(c, for_java(pattern), new)
    return c


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rules_sql(c: str, rules: Sequence[Rule]) -> str:
    for pattern, new in rules:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return c


def translate_sql(c: str, source: str, target: str) -> str:
    return f"translate({c}, {quoted(source)}, {quoted(target)})"
