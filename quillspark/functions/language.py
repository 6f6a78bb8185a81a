"""A language guess by function words, JVM-side: the default provider where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import alnum, n_words

# Frequent function words of each language.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "auf", "im"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "as", "this", "are"),
    "es": ("el", "la", "los", "las", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se"),
    "fr": ("le", "les", "et", "est", "un", "une", "du", "des", "pour", "dans", "qui", "sur", "pas", "au"),
}


def guess_language(text: Column, least_chars: int = 4) -> Column:
    """The language with most function words, the first by name among equals; ``unknown`` for short or voteless texts."""
    words = alnum(text)
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    votes = F.array(*[F.struct((-count(known)).alias("n"), F.lit(lang).alias("lang")) for lang, known in FUNCTION_WORDS.items()])
    best = F.array_min(votes)
    return F.when(F.length(text) < least_chars, "unknown").when(best["n"] == 0, "unknown").otherwise(best["lang"])


def is_language(text: Column, lang: str = "en", least_words: int = 3) -> Column:
    return (n_words(text) >= least_words) & (guess_language(text) == lang)
