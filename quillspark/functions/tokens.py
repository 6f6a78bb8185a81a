"""Tokenisers, one for each metric, and sentence splitting; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_OR_NUMBER = r"[\p{L}\p{N}]+"
ALPHABETIC = r"[a-z']*[a-z][a-z']*"
WORD_OR_MARK = r"[\p{L}\p{N}_']+|[.,!?;]"
#: Words with their contractions split off, numbers with inner points, and single marks.
TREEBANK = r"(?i)n't\b|'(?:s|m|re|ve|ll|d)\b|\p{N}+(?:[.,]\p{N}+)*|\p{L}+?(?=n't\b)|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|\.\.\.|[^\p{L}\p{N}_\s]"
#: Spaces that SQL trims.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
#: Parts sentences: a line break, which no text holds once its white space is single spaces.
SENTENCE_MARK = "\n"


def split_words(c: Column) -> Column:
    """Runs of non-space characters; empty and blank texts have none."""
    return F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.size(split_words(c)))


def _lower(c: Column) -> Column:
    """Every letter by itself: Java makes two letters of a dotted I, and a sigma at the end of a word another letter."""
    return F.lower(F.replace(F.replace(c, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def alnum(c: Column) -> Column:
    return F.regexp_extract_all(_lower(c), F.lit(WORD_OR_NUMBER), F.lit(0))


def alphabetic(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ALPHABETIC), F.lit(0))


def words_and_marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_OR_MARK), F.lit(0))


def treebank(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TREEBANK), F.lit(0))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? (and closing quotes) before white space; line breaks are spaces; blanks are left out."""
    flat = F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " ")
    marked = F.regexp_replace(flat, r"([.!?][\"'\x{201d}\x{2019}]*) ", "$1" + SENTENCE_MARK)
    return F.filter(F.transform(F.split(marked, SENTENCE_MARK), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def sentences_sql(c: str) -> str:
    flat = rf"regexp_replace({c}, '[ \t\n\r\f\x0B]+', ' ', 'g')"
    marked = f"regexp_replace({flat}, '([.!?][\"''\\x{{201d}}\\x{{2019}}]*) ', '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def split_words_sql(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"


def alnum_sql(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
