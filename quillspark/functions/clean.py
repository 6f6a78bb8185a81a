"""Text cleaning as column expressions; each keeps null as null unless said otherwise."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import COLLAPSE, STRIP, S, W, apply_rules


def clean_quote(c: Column, rounds: int = 4) -> Column:
    """Outer curly or straight quotes and trailing horizontal bars are taken off, layer by layer."""
    c = apply_rules(c, STRIP)
    for _ in range(rounds):
        c = apply_rules(c, QUOTE_LAYER)
    return c


QUOTE_LAYER = [
    (rf"(?s)^\x{{201C}}{S}*(.*?){S}*\x{{201D}}$", r"\1"),
    ("[ \\t\\r\\n\\x{2015}]+$", ""),
    (rf'(?s)^"{S}*(.*?){S}*"$', r"\1"),
]

CLEAN_WHITESPACE = [*STRIP, (r"  +", " "), (r"[\t\n\r]", " "), *STRIP]


def clean_whitespace(c: Column) -> Column:
    """Doubled spaces first, then single line breaks and tabs: their order lets doubled spaces come back."""
    return apply_rules(c, CLEAN_WHITESPACE)


def standardize_tags(c: Column) -> Column:
    """Tags as an array: of a bracketed list, else parted by semicolons, else by commas, else one tag."""
    whole = F.trim(c)
    is_list = whole.startswith("[") & whole.endswith("]")
    inner = F.regexp_extract_all(whole, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    listed = F.transform(inner, lambda x: F.regexp_replace(x, r"""^['"]|['"]$""", ""))
    parts = lambda sep: F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(c.isNull(), empty).when(is_list, listed).when(c.contains(";"), parts(";")).when(c.contains(","), parts(",")).otherwise(F.array(whole))


def title_case(c: Column) -> Column:
    """First letters of space-parted words in upper case, blank as null."""
    t = F.initcap(apply_rules(c, STRIP))
    return F.when(F.length(t) > 0, t)


AUTHOR_PARENTHESES = [(r"\(.*\)", ""), *STRIP]
TITLE_PARENTHESES = [(r"\(.*?\)", ""), *STRIP]
LIGHT_CLEAN = [(rf"{S}+[-\x{{2014}}\x{{2013}}]+{S}*[\p{{L}}\p{{N}}_ \t\n\r\f.]+$", ""), *COLLAPSE]


def light_clean(c: Column) -> Column:
    """Of more than three words: a trailing attribution after a dash goes, white space collapses; else empty."""
    words = F.size(F.filter(F.split(c, rf"{S}+"), lambda x: x != ""))
    return F.when(c.isNull() | (words <= 3), F.lit("")).otherwise(apply_rules(c, LIGHT_CLEAN))


def drop_cap(c: Column) -> Column:
    """A decorative initial apart from its word in capitals is joined to it."""
    pattern = r"(?s)^[ \t\n\r]*([A-Za-z])[ \t\n\r]+([A-Z]{2,})\b(.*)$"
    one, rest, tail = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    return F.when(one != "", F.concat(one, F.lower(rest), tail)).otherwise(c)


# Notices that a book preview leaves in its text (English, then Dutch).
PREVIEW_NOTICES = [
    r"(?i)Pages?\s+\d+\s+to\s+\d+\s+(?:is|are)\s+not\s+shown\s+in\s+this\s+preview\.?",
    r"(?i)Some\s+pages?\s+(?:is|are)\s+omitted\s+from\s+this\s+book\s+preview\.?",
    r"(?i)Page\s+\d+\s+is\s+not\s+part\s+of\s+this\s+book\s+preview\.?",
    r"(?i)copyrighted\s+material",
    r"(?i)Auteursrechtelijk\s+beschermd\s+materiaal",
    r"(?i)Sommige\s+pagina'?s?\s+zijn\s+weggelaten\s+uit\s+dit\s+boekvoorbeeld\.?",
    r"(?i)Pagina\s+\d+\s+maakt\s+geen\s+deel\s+uit\s+van\s+dit\s+boekvoorbeeld\.?",
    r"(?i)Pagina'?s?\s+\d+\s+tot\s+\d+\s+(?:wordt|worden)\s+niet\s+weergegeven\s+in\s+dit\s+boekvoorbeeld\.?",
    r"(?i)Pagina'?s?\s+\d+\s+tot\s+en\s+met\s+\d+\s+worden\s+niet\s+getoond\s+in\s+dit\s+voorbeeld\.?",
]
OCR_GLYPHS = "[\ufb01\ufb02\ufb03\ufb04\u25a0\u25a1\u25b2\x0c]"
OCR_RULES = [*[(p, "") for p in PREVIEW_NOTICES], (OCR_GLYPHS, ""), (rf"({W})-\n({W})", r"\1\2"), (r"(\)\.)[ \t\n\r]+([A-Z])", "\\1\n\\2")]


def ocr_lines(c: Column) -> Column:
    """Lines without an ASCII letter, and short headers in capitals that end no sentence, go."""
    header = lambda x: (F.length(x) < 50) & (F.upper(x) == x) & (F.lower(x) != x) & ~F.rlike(x, F.lit("[.?!]['\"\u201d\u2019]?$"))
    keep = lambda x: F.rlike(x, F.lit("[a-zA-Z]")) & ~header(apply_rules(x, STRIP))
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _credits(lines: pd.Series, title: pd.Series, author: pd.Series) -> pd.Series:
    """The lines much like the author or the title: similarity over 0.8, not much longer."""

    def one(own, *names):
        held, names_ = [], [n.lower() for n in names if n]
        for line in () if own is None else own:
            low = line.strip().lower()
            if any(len(low) < 1.5 * len(n) and difflib.SequenceMatcher(None, low, n).ratio() > 0.8 for n in names_):
                held.append(line)
        return held

    return pd.Series([one(*r) for r in zip(lines, title, author)], dtype=object)


def without_credit_lines(text: Column | str, title: Column | str, author: Column | str) -> Column:
    """Lines much like the author or the title go. Only short lines, each once, leave the engine to be compared."""
    text, *names = (F.col(c) if isinstance(c, str) else c for c in (text, title, author))
    longest = F.greatest(*[F.coalesce(F.length(n), F.lit(0)) for n in names])
    # Lower case at most doubles a name; white space at a line's ends does not count.
    short = lambda x: F.length(F.regexp_replace(x, r"[\s\p{Z}\x1C-\x1F\x{85}]+", "")) < 3 * longest
    lines = F.split(text, "\n")
    found = _credits(F.array_distinct(F.filter(lines, short)), *names)
    # The found lines are a variable of the outer lambda, or they would be looked up anew for every line.
    kept = F.transform(F.array(found), lambda held: F.filter(lines, lambda x: ~F.array_contains(held, x)))[0]
    return F.array_join(kept, "\n")


def merge_dialogue(sentences: Column) -> Column:
    """A sentence that ends in . ? ! (and quotes) takes up a next one that starts in lower case; pairs do not chain."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("used"))

    def step(acc, s):
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = (~acc["used"]) & F.coalesce(F.rlike(last, F.lit("[.?!][\"'\u201d\u2019 \t\n]*$")) & F.rlike(s, F.lit("^[ \t\n]*[a-z]")), F.lit(False))
        head = F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        out = F.when(joins, F.concat(head, F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct(out.alias("out"), joins.alias("used"))

    return F.aggregate(sentences, start, step, lambda a: a["out"])


def trim_fragments(sentences: Column) -> Column:
    """A last sentence without an end mark and a first one without a capital go."""
    ended = F.slice(sentences, 1, F.size(sentences) - F.when(F.rlike(F.try_element_at(sentences, F.lit(-1)), F.lit("[.?!][\"'\u201d\u2019]?[ \t\n]*$")), 0).otherwise(1))
    ended = F.when(F.size(sentences) > 0, ended).otherwise(sentences)
    begun = F.rlike(F.try_element_at(ended, F.lit(1)), F.lit("^[ \t\n]*[\"'\u2018\u201c\\[(-]*[A-Z]"))
    return F.when((F.size(ended) > 0) & ~begun, F.slice(ended, 2, F.greatest(F.size(ended) - 1, F.lit(0)))).otherwise(ended)


def fuzzy_cut(text: str | None, part: str | None, least_block: int = 4, cover: float = 0.8) -> str | None:
    """The text without the blocks it shares with ``part``, if these cover it well and lie close together."""
    if text is None or part is None:
        return text
    blocks = [b for b in difflib.SequenceMatcher(None, text, part, autojunk=False).get_matching_blocks() if b.size >= least_block]
    if not blocks:
        return text
    span = blocks[-1].b + blocks[-1].size - blocks[0].b
    gaps = [y.a - x.a - x.size for x, y in zip(blocks, blocks[1:])]
    if sum(b.size for b in blocks) < cover * span or max(gaps, default=0) > len(part) // 2:
        return text
    out, at = [], 0
    for b in blocks:
        out.append(text[at : b.a])
        at = b.a + b.size
    joined = re.sub("  +", " ", "".join([*out, text[at:]]))
    return joined.replace(" \n", "\n").replace("\n ", "\n").strip()


@F.pandas_udf(T.StringType())
def remove_fuzzy(text: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_cut(t, p) for t, p in zip(text, part)])


def alphanumeric_lines(c: Column) -> Column:
    """Lines with a letter or digit, stripped; null is empty."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: apply_rules(x, STRIP))
    return F.array_join(F.filter(lines, lambda x: F.rlike(x, F.lit("[a-zA-Z0-9]"))), "\n")


MATCH_FORM = [(rf"[^\p{{L}}\p{{N}}_ \t\n\r\f]", " "), *COLLAPSE]


def match_form(c: Column) -> Column:
    """Lower case, punctuation as spaces, white space collapsed."""
    return apply_rules(F.lower(c), MATCH_FORM)


CHAPTER = [
    (rf"(?i)\bCHAPTER{S}+[IVXLCDM]+\b[^\p{{L}}\p{{N}}_]*", ""),
    (rf"(?i)\bCHAPTER{S}+\d+\b[^\p{{L}}\p{{N}}_]*", ""),
    (r"(?i)\bCHAPTER\b[^\p{L}\p{N}_]*", ""),
    (rf"{S}+", " "),
    (rf"{S}+([,.;:!?])", r"\1"),
    (rf"([,.;:!?])({W})", r"\1 \2"),
    *STRIP,
]
# The same for Spark: a c is sought first, and only behind it whether a word begins there.
CHAPTER_STEPS = [(p.replace(r"(?i)\bCHAPTER", r"[cC](?<=\b.)(?i)HAPTER"), new) for p, new in CHAPTER]
CHAPTER_PATTERNS = {
    "with_roman": rf"(?i)\bCHAPTER{S}+[IVXLCDM]+\b", "with_number": rf"(?i)\bCHAPTER{S}+\d+\b", "total": r"(?i)\bCHAPTER\b",
}


def clean_chapters(c: Column) -> Column:
    """Chapter marks go, spaces about punctuation are mended, sentences start with a capital."""
    parts = F.regexp_extract_all(apply_rules(c, CHAPTER_STEPS), F.lit(r"[^.!?]+|[.!?]+[ \t\n\r]*"), F.lit(0))
    raised = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"^[ \t\n\r]*\p{Ll}")), F.concat(F.upper(F.substring(F.ltrim(x), 1, 1)), F.substring(F.ltrim(x), F.lit(2), F.length(x)))).otherwise(x))
    return apply_rules(F.array_join(raised, ""), COLLAPSE)


def blank_chapter_cell(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^{S}*CHAPTER{S}+\d+{S}*$", "")


UNICODE_SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NORMALIZE_WHITESPACE = [(r"[\x00\x{FEFF}]", ""), (UNICODE_SPACES, " "), (r"[\t\n\r\f\x0B]", " "), (r" +", " "), (r"^ +", ""), (r" +$", "")]


def normalize_whitespace(c: Column) -> Column:
    return apply_rules(F.when(c.isNull() | (c == "nan"), F.lit("")).otherwise(c), NORMALIZE_WHITESPACE)


# Quotation marks to their ASCII forms, and raised and lowered digits.
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb\u02ba\u02ee\u275d\u275e\u2760\u2761\u275f\u2762\u2763\uff02"
SINGLE_QUOTES = (
    "\u2018\u2019\u201a\u2039\u203a\u276e\u276f\u275b\u275c"
    "\u02bb\u02bc\u02bd\u02be\u02bf\u02c0\u02c1\u02c2\u02c3\u02c4\u02c5\u02c6\u02c7\u02c8\uff07"
)
RAISED, LOWERED, DIGITS = "\u2070\u00b9\u00b2\u00b3\u2074\u2075\u2076\u2077\u2078\u2079", "\u2080\u2081\u2082\u2083\u2084\u2085\u2086\u2087\u2088\u2089", "0123456789"
TRANSLATE = (
    DOUBLE_QUOTES + SINGLE_QUOTES + RAISED + LOWERED,
    '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + DIGITS + DIGITS,
)
# Signs that stand for an ellipsis, and dashes.
ELLIPSES = r"\.{2,}|[\x{2026}\x{2025}\x{22EF}\x{2030}\x{2031}\x{2024}\x{2038}\x{2056}\x{2058}\x{2059}\x{205B}]"
DASHES = rf"{S}*(?:--+|\x{{2014}}+|\x{{2013}}+|\x{{2212}}+|\x{{2E3A}}+|\x{{2E3B}}+){S}*"
CLEAN_TEXT = [
    (r"\x{00AD}", ""), (r"[\x00-\x1F\x7F-\x{9F}]", ""), (ELLIPSES, " \u2026 "), (DASHES, " \u2014 "), (r"\^\d+", ""), (r"\[\d+\]", ""),
    (rf"{S}+", " "), (rf"{S}+([.,?!;:])", r"\1"), (rf"{UNICODE_SPACES}+", " "), (r" +", " "), (r"\.{2,}", " \u2026 "), (r" +", " "), *STRIP,
]
# The same for Spark: signs and runs of dots apart, dashes without the spaces about them, which a later rule makes one.
_SIGN = ELLIPSES.split("|", 1)[1]
_DASH = r"[\x{2014}\x{2013}\x{2212}\x{2E3A}\x{2E3B}]"
_APART = {
    ELLIPSES: [(_SIGN, " \u2026 "), (r"\.{2,}", " \u2026 ")],
    DASHES: [(rf"({_DASH})\1*", " \u2014 "), (r"--+", " \u2014 ")],
}
CLEAN_STEPS = [step for rule in CLEAN_TEXT for step in _APART.get(rule[0], [rule])]
RESIDUE = {
    "smart_quotes": r"[\x{201c}\x{201d}\x{2018}\x{2019}\x{201a}\x{201e}\x{2039}\x{203a}\x{00ab}\x{00bb}\x{02ba}\x{02ee}\x{201f}]",
    "superscripts": r"[\x{2070}\x{00b9}\x{00b2}\x{00b3}\x{2074}-\x{2079}]", "soft_hyphens": r"\x{00AD}", "control_chars": r"[\x00-\x1F]",
    "multiple_spaces": r"  +", "footnote_markers": r"\^\d+|\[\d+\]", "multiple_dashes": r"--+", "en_dashes": r"\x{2013}+",
    "ellipses": r"\.{2,}|[\x{2025}\x{22EF}\x{2030}\x{2031}\x{2024}\x{2038}\x{2056}\x{2058}\x{2059}\x{205B}]",
}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(c: Column, normalize: bool = True) -> Column:
    """Signs in one form each: quotes, digits, ellipses, dashes, spaces; footnote marks and controls go. Null is empty."""
    c = F.coalesce(nfc(c) if normalize else c, F.lit(""))
    return apply_rules(F.translate(c, *TRANSLATE), CLEAN_STEPS)


def _inner(a: str, b: str) -> tuple[str, str]:
    return (rf"\{a}[ _]*([^\{b}\n]*?)[ _]*\{b}", rf"{a}\1{b}")


NORMALIZE_TEXT = [
    (rf"^{S}*_{S}*\]{S}*", ""), (r"\b_([^_]+)_\b", r"\1"), _inner("[", "]"), _inner("(", ")"), _inner("{", "}"),
    (rf"({W}){S}+n't\b", r"\1n't"), (rf"({W}){S}+'s\b", r"\1's"), (rf"([(\[{{]){S}+", r"\1"), (rf"{S}+([)\]}}])", r"\1"),
    (rf"({W}){S}+'(m|re|ve|ll|d)\b", r"\1'\2"), (rf"\[{S}*_", "["), (rf"_{S}*\]", "]"),
    (rf"\[{S}*\]|\({S}*\)|\{{{S}*\}}", ""), *STRIP,
]


def normalize_text(c: Column) -> Column:
    """Stage marks, emphasis underscores, parted contractions and bracket spacing."""
    return apply_rules(c, NORMALIZE_TEXT)


def corrections(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words replaced in order, letter case aside."""
    for wrong, right in pairs:
        c = F.regexp_replace(c, rf"(?i)\b\Q{wrong}\E\b", right.replace("\\", r"\\").replace("$", r"\$"))
    return c


def quoted_query(c: Column) -> Column:
    """The quoted part of a search text."""
    return F.try_element_at(F.split(c, '"'), F.lit(2))


def query_author(c: Column) -> Column:
    return F.when(c.contains("inauthor:"), F.try_element_at(F.split(c, "inauthor:"), F.lit(2)))


def preview_link(c: Column, page: int) -> Column:
    return F.concat(F.replace(c, F.lit("&printsec=frontcover"), F.lit("")), F.lit(f"&pg=PA{page}"))


YEAR_IN_TEXT = r"\b(1[0-9]{3}|20[0-2][0-9])\b"
LEADING_YEAR = r"^\+?(\d{4})"


def year_in(c: Column, pattern: str = YEAR_IN_TEXT) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found.cast("int"))


def word_diff(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """(mark, word) with marks ' ', '-' and '+' for kept, removed and added words."""
    a, b, out = (before or "").split(), (after or "").split(), []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [(" ", w) for w in a[i:j]]
        else:
            out += [("-", w) for w in a[i:j]] + [("+", w) for w in b[k:m]]
    return out
