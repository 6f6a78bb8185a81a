"""Per-text metrics as column expressions over one row; nothing here shuffles."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import alnum, sentences

_VOWEL = "aeiouyàâäéèêëîïôöùûüáíóúñ"
VOWELS = f"[{_VOWEL}]+"
_BLANK = r" \t\n\r\f\x0B"


def syllables(text: Column) -> Column:
    """Vowel groups of all words, one at least for each: the groups of the text and the words without any."""
    low = F.lower(text)
    bare = rf"(?<![^{_BLANK}])[^{_BLANK}{_VOWEL}]++(?![^{_BLANK}])"
    return F.regexp_count(low, F.lit(VOWELS)) + F.regexp_count(low, F.lit(bare))


def counts(text: Column) -> dict[str, Column]:
    return {
        "n_words": F.regexp_count(text, F.lit(rf"[^{_BLANK}]+")), "n_sentences": F.greatest(F.lit(1), F.size(sentences(text))), "n_syllables": syllables(text),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), "n_chars": F.length(text),
    }


def flesch(words: Column, sents: Column, sylls: Column, least: int = 10) -> Column:
    return F.when(words >= least, 206.835 - 1.015 * words / sents - 84.6 * sylls / words)


def coleman_liau(words: Column, sents: Column, letters: Column, least: int = 10) -> Column:
    return F.when(words >= least, 0.0588 * (letters / words * 100) - 0.296 * (sents / words * 100) - 15.8)


def entropy(text: Column, least: int = 10) -> Column:
    """Shannon entropy in bits of the word distribution of one text; null under ``least`` words.

    The ends of runs in the sorted words give the counts: no explode, no shuffle. The arrays are
    bound to lambda variables, so that they are made once for each text.
    """

    def of(words):
        n = F.size(words)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(words, i - 1) != F.get(words, i)))
        counts = lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda x, y: (x - y).cast("double"))
        summed = lambda e: F.aggregate(counts(e), F.lit(0.0), lambda s, c: s + c * F.log2(c))
        return F.when(n >= F.lit(max(1, least)), F.log2(n.cast("double")) - F.get(F.transform(F.array(ends), summed), F.lit(0)) / n)

    return F.get(F.transform(F.array(F.array_sort(alnum(text))), of), F.lit(0))


def type_token_ratio(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words))


def mtld_value(tokens: list[str], threshold: float = 0.72, least_factor: int = 10) -> float:
    """Mean length of runs that keep their type-token ratio over the threshold, read both ways."""

    def one_way(seq):
        factors, start, types = 0.0, 0, set()
        for i, t in enumerate(seq):
            types.add(t)
            n = i - start + 1
            if n >= least_factor and len(types) / n < threshold:
                factors += 1
                start, types = i + 1, set()
        if start < len(seq):
            rest = len(types) / (len(seq) - start)
            factors += (1 - rest) / (1 - threshold) if rest < 1 else 0.0
        return len(seq) / factors if factors else float(len(seq))

    return (one_way(tokens) + one_way(tokens[::-1])) / 2


@F.pandas_udf(T.DoubleType())
def mtld(tokens: pd.Series) -> pd.Series:
    """MTLD of token arrays; null under 20 tokens. A fold over a growing set is linear here and quadratic in SQL."""
    return pd.Series([None if t is None or len(t) < 20 else mtld_value(list(t)) for t in tokens], dtype="float64")


def surprisal_total(average: Column, n: Column) -> Column:
    return average * n


def perplexity(average: Column) -> Column:
    return F.exp(average)


def nats_to_bits(c: Column) -> Column:
    return c / F.log(F.lit(2.0))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def with_stars(value: Column, p: Column) -> Column:
    return F.concat(F.format_string("%+.2f", value), stars(p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


