"""Choice of the best candidate for an author or a book from a table of candidates (no network)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import score
from .windows import keep_first

# Words in a description that tell a person of letters.
PERSON_WORDS = ("writer", "author", "novelist", "poet", "philosopher", "playwright", "journalist", "essayist")


def best_authors(names: DataFrame, candidates: DataFrame, key: str = "author") -> DataFrame:
    """Per author the first candidate of letters whose label is near (over 90), else the first candidate if its label is near.

    ``candidates``: author, rank, label, description, language, country; language goes before country.
    """
    j = names.join(candidates, key).withColumn("near", score("token_sort_ratio", F.lower(key), F.lower("label")) > 90)
    letters = F.exists(F.array(*[F.lit(w) for w in PERSON_WORDS]), lambda w: F.contains(F.lower("description"), w))
    best = keep_first(j.withColumn("stage", F.when(F.col("near") & letters, 1).otherwise(2)), [key], ["stage", "rank"])
    found = best.filter("near").select(key, F.coalesce("language", "country").alias("language_or_country"))
    return names.join(found, key, "left").withColumn("language_or_country", F.coalesce("language_or_country", F.lit("Not Found")))


def best_books(books: DataFrame, candidates: DataFrame, title: str = "title", author: str = "author") -> DataFrame:
    """Per book the candidate with the highest score, and a status.

    Title and author similarities count; a far author costs 500, a work 150 more, a telling word 50, an edition 1000 less.
    ``candidates``: title, author, rank, label, authors, is_work, has_keyword, is_edition, year.
    """
    j = books.join(candidates, [title, author])
    j = j.withColumns({"ts": score("token_set_ratio", F.lower(title), F.lower("label")), "as_": score("token_set_ratio", F.lower(author), F.lower("authors"))})
    total = F.col("ts") + F.when(F.col("as_") < 75, F.lit(-500)).otherwise(F.col("as_"))
    total = total + F.when(F.col("is_work"), 150).otherwise(0) + F.when(F.col("has_keyword"), 50).otherwise(0) - F.when(F.col("is_edition"), 1000).otherwise(0)
    fits = (F.col("ts") > F.when(F.col("as_") > 95, 75).otherwise(80)) & (F.col("as_") > 80) & (total > 0)
    best = keep_first(j.withColumn("total", total).filter(fits), [title, author], [F.col("total").desc(), "rank"])
    found = best.select(title, author, F.col("year").alias("publication_date"), F.when(F.col("year").isNull(), "no date").otherwise("found").alias("date_fetch_status"))
    out = books.join(found, [title, author], "left")
    return out.withColumns({"publication_date": F.coalesce(F.col("publication_date").cast("string"), F.lit("Unknown")), "date_fetch_status": F.coalesce("date_fetch_status", F.lit("no match"))})


def coalesce_sources(df: DataFrame, sources: list[str], out: str) -> DataFrame:
    """The first known value of several sources in order of trust, and which it was."""
    named = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])
    return df.withColumns({out: F.coalesce(*sources), f"{out}_source": named})
