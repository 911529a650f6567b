"""Card search (E2): filter cards by name, then re-nest their children into
documents shaped like the feed.

One plan instead of "collect the ids, then five lookups": the matching
cards are the build side of semi joins into each child table, each child
table is grouped per card (``collect_list`` of structs, sorted for a
deterministic order), and the groups are left-joined back.  A card's
children came from one feed document, so each array is as large as that
document's array, not as large as the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.semantics import ilike_contains, money_text, pg_asc, require_text
from marketframe.operators.catalog import PRICE_FIELDS


def search_cards(cards: DataFrame, name: str) -> DataFrame:
    """P2 + P8 + O1: ``WHERE name ILIKE '%name%' ORDER BY name`` with the
    feed's field names."""
    require_text(name, "name")
    return (cards.where(ilike_contains("name", name))
                 .select("id", "name", "type",
                         F.col("human_readable_card_type").alias("humanReadableCardType"),
                         F.col("frame_type").alias("frameType"),
                         F.col("description").alias("desc"), "race", "atk", "def", "level",
                         "attribute", "archetype", "ygoprodeck_url")
                 .orderBy(pg_asc("name"), "id"))


def semi_by_keys(child: DataFrame, keys: DataFrame, key: str = "card_id") -> DataFrame:
    """``WHERE key = ANY($1)`` as a semi join on a key DataFrame."""
    k = keys.select(F.col(keys.columns[0]).alias(key))
    return child.join(k, key, "left_semi")


def nest_types(card_types: DataFrame) -> DataFrame:
    """A5: ``typeline`` per card, sorted (the source order is undefined)."""
    return card_types.groupBy("card_id").agg(
        F.sort_array(F.collect_list("type_name")).alias("typeline"))


def nest_printings(card_printings: DataFrame) -> DataFrame:
    """``card_sets`` per card ordered by set name; the price is the
    decimal's text (F20; a NULL price stays NULL)."""
    s = F.struct("set_name", "set_code", "set_rarity", "set_rarity_code",
                 money_text("set_price").alias("set_price"))
    return card_printings.groupBy("card_id").agg(F.array_sort(F.collect_list(s)).alias("card_sets"))


def nest_banlist(banlist: DataFrame, seq: str | None = None) -> DataFrame:
    """One ``banlist_info`` struct per card; with several rows the last
    one (by ``seq``) wins, otherwise the table is unique on ``card_id``."""
    row = F.struct("ban_ocg")
    pick = F.max_by(row, F.col(seq)) if seq else F.max(row)
    return banlist.groupBy("card_id").agg(pick.alias("banlist_info"))


def nest_images(card_images: DataFrame) -> DataFrame:
    """Images per card; the image ``id`` is the card id."""
    s = F.struct(F.col("card_id").alias("id"), "image_url", "image_url_small",
                 "image_url_cropped")
    return card_images.groupBy("card_id").agg(F.array_sort(F.collect_list(s)).alias("card_images"))


def nest_prices(card_prices: DataFrame) -> DataFrame:
    """Price entries per card, every price as decimal text."""
    s = F.struct(*[money_text(f).alias(f) for f in PRICE_FIELDS])
    return card_prices.groupBy("card_id").agg(F.array_sort(F.collect_list(s)).alias("card_prices"))


def search_nested(cards: DataFrame, card_types: DataFrame, card_printings: DataFrame,
                  banlist: DataFrame, card_images: DataFrame, card_prices: DataFrame,
                  name: str) -> DataFrame:
    """The search result as feed-shaped documents.
    Missing children give ``[]``; a missing banlist gives a NULL struct."""
    found = search_cards(cards, name)
    ids = found.select(F.col("id").alias("card_id"))
    parts = [
        (nest_types(semi_by_keys(card_types, ids)), "typeline", True),
        (nest_printings(semi_by_keys(card_printings, ids)), "card_sets", True),
        (nest_banlist(semi_by_keys(banlist, ids)), "banlist_info", False),
        (nest_images(semi_by_keys(card_images, ids)), "card_images", True),
        (nest_prices(semi_by_keys(card_prices, ids)), "card_prices", True),
    ]
    doc = found
    for df, col, is_array in parts:
        doc = doc.join(df.withColumnRenamed("card_id", "id"), "id", "left")
        if is_array:
            doc = doc.withColumn(col, F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType)))
    return doc.select("id", "name", "typeline", "type", "humanReadableCardType", "frameType",
                      "desc", "race", "atk", "def", "level", "attribute", "archetype",
                      "ygoprodeck_url", "card_sets", "banlist_info", "card_images",
                      "card_prices").orderBy(pg_asc("name"), "id")


def to_json_documents(docs: DataFrame) -> DataFrame:
    """One JSON text per document with NULL fields kept as ``null``
    (Spark drops them by default), except a missing banlist, which is left
    out like an ``undefined`` field."""
    opts = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(*docs.columns), opts)
    no_ban = F.to_json(F.struct(*[c for c in docs.columns if c != "banlist_info"]), opts)
    return docs.select("id", F.when(F.col("banlist_info").isNull(), no_ban)
                              .otherwise(full).alias("doc"))
