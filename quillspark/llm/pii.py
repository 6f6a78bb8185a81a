"""Personal data with offset-preserving deobfuscation.

Base detectors run on the text as it is. Then transducers rewrite disguises -
homoglyphs and full-width forms to ASCII, runs of spelled digits to digits, ``at``
and ``dot`` in words or brackets to ``@`` and ``.`` - and note for every piece of
normalised text which source characters it stands for. The detectors run on the
normalised text, and spans that a rewrite touches are mapped back to the source.

Defined cases: null counts as empty; offsets are code points, end exclusive;
texts are read whole, names and hosts of any length; base spans stay, and a disguised
span that overlaps one of its kind is dropped; repeated rows and null ids are answered
each by itself; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP_TAIL = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters and the ASCII letters they stand for (Cyrillic, then Greek, then signs).
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "∙": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-",
    " ": " ", " ": " ", " ": " ",
}
#: Full-width ASCII by rule, and decimal digits of other scripts by their first code point.
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
HOMOGLYPHS |= {chr(first + d): str(d) for first in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50) for d in range(10)}

# Spelled digits in English, French, German and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_GLYPHS = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]+")
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = rf"(?:{_WORDS}|[0-9]+)"
_SPELLED = re.compile(rf"(?<!\w){_NUMBER}(?:[\x20,./-]{{1,2}}{_NUMBER}){{2,}}(?!\w)", re.I)
_ONE = re.compile(_NUMBER, re.I)
_DOT_WORD = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\x20(?:dot|punkt|punto)\x20)"
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|arroba|chez|@|dot|punkt|punto|point|\.)\s?[\])}>]", re.I)
_SPACED = (" dot ", " punkt ", " punto ")
_AT_RE = re.compile(r"\s?[\[({<]\s?(?:at|arroba|chez|@)\s?[\])}>]\s?|\x20(?:at|arroba)\x20|@", re.I)
_DOT_RE = re.compile(_DOT_WORD, re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_DOT_WORD}(?=[0-9])", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT_WORD})[A-Za-z0-9-]++)++", re.I)
#: A name with its dots, read from its end: over the reversed text.
_TOD_WORD = r"(?:\s?[\])}>]\s?(?:tod|tknup|otnup|tniop|\.)\s?[\[({<]\s?|\x20(?:tod|tknup|otnup)\x20)"
_EMAN = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.|{_TOD_WORD})[A-Za-z0-9_%+-]++)*+", re.I)


def has_disguise(text: str, lower: str) -> bool:
    """Whether any bracketed at or dot, or a dot in words, is there; bare words ``at`` need one beside them."""
    return bool(_BRACKETED.search(text)) or any(w in lower for w in _SPACED)


def disguised_numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised dots between digits into plain ones."""
    return [(*m.span(), ".") for m in _NUMBER_DOT.finditer(text)]


def disguised_mail(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised addresses into plain ones; bare words ``at`` count only beside a disguised dot."""
    edits, last, back = [], 0, text[::-1]
    for m in _AT_RE.finditer(text):
        host = _HOST.match(text, m.end())
        name = host and m.start() >= last and _EMAN.match(back, len(text) - m.start(), len(text) - last)
        if name and (m[0].strip().lower() not in ("at", "arroba") or _DOT_RE.search(host[0])):
            a, b = len(text) - name.end(), host.end()
            plain = f"{_DOT_RE.sub('.', name[0][::-1])}@{_DOT_RE.sub('.', host[0])}"
            ending = plain.rsplit(".", 1)[1].lower()
            if plain != text[a:b] and ending.isalpha() and ending not in ("at", "arroba", "dot", "punkt", "punto", "point"):
                edits.append((a, b, plain))
                last = b
    return edits


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base detectors, leftmost and without overlap within a kind."""
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    last, m = 0, _IP_TAIL.search(text)
    while m:
        start = at = m.start()
        while start > last and text[start - 1] in _DIGITS:
            start -= 1
        if start < at:
            parts = [x.lstrip("0") for x in text[start : m.end()].split(".")]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                out.append((1, start, m.end()))
            last = m.end()
        m = _IP_TAIL.search(text, m.end() if start < at else at + 1)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


class Rewriting:
    """A text under rewriting, with the source span of every rewritten piece."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int, int]] = []  # new start, new end, source start, source end

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, in order and without overlap."""
        if not edits:
            return
        out, at, shift, pieces = [], 0, 0, []
        for a, b, new in edits:
            out += [self.text[at:a], new]
            pieces.append((a + shift, a + shift + len(new), self.source(a, False), self.source(b, True)))
            shift += len(new) - (b - a)
            at = b
        moved, k, shift = [], 0, 0
        for p in self.pieces:
            while k < len(edits) and edits[k][1] <= p[0]:
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
            if not any(a < p[1] and p[0] < b for a, b, _ in edits[k : k + 2]):
                moved.append((p[0] + shift, p[1] + shift, p[2], p[3]))
        self.text = "".join([*out, self.text[at:]])
        self.pieces = sorted(pieces + moved)

    def source(self, at: int, end: bool) -> int:
        """Source place of a place in the present text; inside a piece, its begin or end."""
        k = bisect_right(self.pieces, (at - end, float("inf"))) - 1
        if k < 0:
            return at
        a, b, x, y = self.pieces[k]
        if at - end < b:
            if b - a == y - x:
                return x + at - a
            return y if end else x
        return y + at - b

    def touched(self, a: int, b: int) -> bool:
        k = bisect_right(self.pieces, (a, float("inf"))) - 1
        return any(p[0] < b and a < p[1] for p in self.pieces[max(0, k) : k + 2])


def deobfuscate(text: str) -> Rewriting | None:
    """The normalised text with its map to the source; None if nothing is disguised."""
    r = Rewriting(text)
    if not text.isascii():
        r.apply([(*m.span(), "".join(map(HOMOGLYPHS.__getitem__, m[0]))) for m in _GLYPHS.finditer(text)])
    lower = r.text.lower()
    if not SPELLED.keys().isdisjoint(lower.replace(",", " ").replace("-", " ").replace(".", " ").replace("/", " ").replace("+", " ").split()):
        edits = []
        for m in _SPELLED.finditer(r.text):
            if sum(x.lower() in SPELLED for x in _ONE.findall(m[0])) < 3:
                continue
            digits = "".join(SPELLED.get(x.lower(), x) for x in _ONE.findall(m[0]))
            edits.append((*m.span(), digits))
        r.apply(edits)
        lower = r.text.lower()
    if has_disguise(r.text, lower):
        r.apply(disguised_mail(r.text))
        r.apply(disguised_numbers(r.text))
    return r if r.pieces else None


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that only the normalised text shows), by kind and start, in source code points."""
    if not text:
        return [], []
    base = sorted(detect(text))
    r = deobfuscate(text)
    more = []
    for kind, a, b in sorted(detect(r.text)) if r else ():
        if r.touched(a, b):
            a, b = r.source(a, False), r.source(b, True)
            # A disguised one may be wider than what the bare text shows of it; it is added beside that.
            if not any(k == kind and x <= a and b <= y for k, x, y in base) and not any(k == kind and x < b and a < y for k, x, y in more[-1:]):
                more.append((kind, a, b))
    return base, more


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: kind, start, end, base (whether the bare text shows it), by kind and start."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base, more = scan(text)
                rows = sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": x} for k, s, e, x in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each (start, end, kind) span replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
