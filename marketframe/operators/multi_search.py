"""P8, P9 and P10 for a whole DataFrame of searches at once.

One search is a filter over all names.  Many searches are not: testing every
name against every text is a cross join.  Here they meet on pieces of text:

1. names that occur more than once are one *value*; each value posts its
   distinct grams of one, two and three characters, and the empty gram;
2. a search text is cut at its wildcards.  Its trigrams are all in a value that
   matches (texts with no stretch of three characters use their two- or
   one-character grams, texts of wildcards alone the empty gram, so every text
   has a defined way);
3. of a text's grams the one that fewest values post is joined to the postings,
   an equi-join that emits candidates only; a gram that no value posts settles
   the search at once;
4. candidates are verified with the very ``ILIKE`` of the single search, and
   matching values are joined back to their rows.

Texts that are NULL or blank are no searches (the single form raises); they give
no row and are listed by ``rejected_requests``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.semantics import is_blank, is_falsy

#: Longest gram.
GRAM = 3


def _like_body(text: Column) -> Column:
    """The text as the database reads it between the outer ``%``: a backslash
    before any character but ``%``, ``_`` and itself is dropped."""
    return F.regexp_replace(text, r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def _grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters."""
    last = F.length(text) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def _postings(values: DataFrame) -> DataFrame:
    """(gram, value) of every distinct value."""
    low = F.lower("value")
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(low, n) for n in range(1, GRAM + 1)]))
    return values.select(F.explode(grams).alias("gram"), "value")


def _needles(requests: DataFrame) -> DataFrame:
    """(request_id, pattern, gram, n_grams): the grams that a matching value
    must post."""
    body = _like_body(F.col("text"))
    # escapes end a stretch too: fewer grams, never a wrong one
    stretches = F.split(F.regexp_replace(F.lower(body), r"(?s)\\.?", "%"), "[%_]")
    r = requests.select("request_id", F.concat(F.lit("%"), body, F.lit("%")).alias("pattern"), stretches.alias("parts"))

    def all_of(n):
        return F.array_distinct(F.flatten(F.transform("parts", lambda p: _grams(p, n))))
    r = r.select("request_id", "pattern", *[all_of(n).alias(f"g{n}") for n in range(1, GRAM + 1)])
    grams = F.array(F.lit(""))
    for n in range(1, GRAM + 1):
        grams = F.when(F.size(f"g{n}") > 0, F.col(f"g{n}")).otherwise(grams)
    return r.select("request_id", "pattern", F.size(grams).alias("n_grams"), F.explode(grams).alias("gram"))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Searches without a text."""
    return requests.where(F.col("text").isNull() | is_blank("text")).withColumn(
        "reason", F.lit("parameter 'text' is required"))


def matching_values(values: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, value) where ``value ILIKE '%text%'``; ``values`` has one
    distinct column ``value``."""
    asked = requests.where(F.col("text").isNotNull() & ~is_blank("text")).select("request_id", "text")
    posted = _postings(values)
    spread = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("posted"))
    rarest = (_needles(asked).join(spread, "gram").groupBy("request_id", "pattern", "n_grams")
              .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("posted", "gram")).alias("best"))
              .where("known = n_grams").select("request_id", "pattern", F.col("best.gram").alias("gram")))
    return rarest.join(posted, "gram").where(F.expr("value ILIKE pattern")).select("request_id", "value")


def search_many(rows: DataFrame, columns: Sequence[str], requests: DataFrame, key: str = "id") -> DataFrame:
    """(request_id, key) of the rows that have the text of ``requests
    (request_id, text)`` in one of ``columns``."""
    values = rows.select(F.explode(F.array(*columns)).alias("value")).where("value IS NOT NULL").distinct()
    found = matching_values(values, requests)
    held = rows.select(F.col(key), F.explode(F.array_distinct(F.array(*columns))).alias("value"))
    out = held.join(found, "value").select("request_id", key)
    return out.distinct() if len(columns) > 1 else out


def offers_for_requests(detail: DataFrame, requests: DataFrame) -> DataFrame:
    """P10 / P11 for many listings: ``requests (request_id, text, condicion,
    idioma, precio_max)``; a filter that is NULL or falsy is left out, a price
    bound drops offers without a price.  (request_id, inventario_id, ...)."""
    found = matching_values(detail.select(F.col("card_name").alias("value")).where("value IS NOT NULL").distinct(), requests)
    asked = found.join(requests.select("request_id", F.col("condicion").alias("_condicion"),
                                       F.col("idioma").alias("_idioma"), F.col("precio_max").alias("_max")), "request_id")
    same = ((is_falsy("_condicion") | (F.col("condicion") == F.col("_condicion")))
            & (is_falsy("_idioma") | (F.col("idioma") == F.col("_idioma")))
            & (F.col("_max").isNull() | (F.col("precio") <= F.col("_max"))))
    return detail.join(asked, F.col("card_name") == F.col("value")).where(same).select("request_id", *detail.columns)
