"""Inventory listings: the detail view, optional-filter listings, whitelisted
sorts, top-k offers, per-card best offers, paged nesting and statistics.

Per-request routes become set operations: a listing "for one seller" or
"for one card" is a listing for every key of a key DataFrame (a semi join),
so one job answers all requests.  Joins with the card and seller dimensions
are plain equi-joins: AQE turns them into broadcast joins when the
dimension is below the broadcast threshold at run time and keeps a
sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.semantics import (ilike_contains, parse_float_param,
                                             parse_int_param, pg_asc, pg_desc)

DETAIL_COLUMNS = ("inventario_id", "vendedor_id", "vendedor_nombre", "konami_id", "whatsapp",
                  "instagram", "card_id", "card_name", "cantidad", "precio", "condicion",
                  "idioma", "edicion", "notas", "created_at", "updated_at")
SORT_WHITELIST = ("name", "cantidad", "precio", "created_at")


def _keys(df: DataFrame | None, name: str) -> DataFrame | None:
    if df is None:
        return None
    return df.select(F.col(df.columns[0]).alias(name)).distinct()


def inventory_detail(inv: DataFrame, cards: DataFrame, sellers: DataFrame,
                     only_in_stock: bool = True, only_active: bool = True) -> DataFrame:
    """The ``inventario_detallado`` view (its definition is not in
    the source; ours joins inventory, cards and sellers)."""
    if only_in_stock:
        inv = inv.where(F.col("cantidad") > 0)
    s = sellers
    if only_active:
        s = s.where(F.col("activo"))
    s = s.select("vendedor_id",
                 F.concat("nombres", F.lit(" "), "apellidos").alias("vendedor_nombre"),
                 "konami_id", "whatsapp", "instagram")
    c = cards.select(F.col("id").alias("card_id"), F.col("name").alias("card_name"))
    return inv.join(c, "card_id").join(s, "vendedor_id").select(*DETAIL_COLUMNS)


def _optional_filters(df: DataFrame, condicion=None, idioma=None) -> DataFrame:
    """P10: each predicate is added only when its parameter is truthy."""
    if condicion:
        df = df.where(F.col("condicion") == F.lit(condicion))
    if idioma:
        df = df.where(F.col("idioma") == F.lit(idioma))
    return df


def inventory_sort(orden: str | None, name_col: str = "name") -> list[Column]:
    """O2: whitelisted sort; ``name`` ascending, every other key descending
    (NULLs first, as in the source database).  Unknown keys fall back to
    ``name``."""
    orden = orden if orden in SORT_WHITELIST else "name"
    if orden == "name":
        return [pg_asc(name_col)]
    return [pg_desc(orden)]


def my_inventory(inv: DataFrame, cards: DataFrame, seller_ids: DataFrame | None = None,
                 condicion: str | None = None, idioma: str | None = None,
                 search: str | None = None, orden: str = "name") -> DataFrame:
    """E3 / J1 + P5 + P10 + O2: each seller's in-stock inventory with card
    fields, optional filters and the whitelisted order (within a seller,
    ``inventario_id`` breaks ties)."""
    i = inv.where(F.col("cantidad") > 0)
    ks = _keys(seller_ids, "vendedor_id")
    if ks is not None:
        i = i.join(ks, "vendedor_id", "left_semi")
    i = _optional_filters(i, condicion, idioma)
    c = cards.select(F.col("id").alias("card_id"), "name", "type", "race", "attribute",
                     "archetype", "atk", "def", "level")
    if search:
        c = c.where(ilike_contains("name", search))
    out = i.join(c, "card_id").select(
        "vendedor_id", "inventario_id", "card_id", "name", "type", "race", "attribute",
        "archetype", "atk", "def", "level", "cantidad", "precio", "condicion", "idioma",
        "edicion", "notas", "created_at", "updated_at")
    return out.orderBy("vendedor_id", *inventory_sort(orden), "inventario_id")


def inventory_stats(inv: DataFrame, seller_ids: DataFrame | None = None) -> DataFrame:
    """A4: per seller ``COUNT(*), SUM(cantidad), AVG(precio), MAX(precio)``
    over rows with ``cantidad > 0`` (list filters ignored).  With
    ``seller_ids`` every requested seller gets a row, ``0, NULL, NULL, NULL``
    when it has no stock.  Partial aggregation runs map-side."""
    i = inv.where(F.col("cantidad") > 0)
    agg = i.groupBy("vendedor_id").agg(*_stats_columns())
    ks = _keys(seller_ids, "vendedor_id")
    if ks is None:
        return agg
    return ks.join(agg, "vendedor_id", "left").select(
        "vendedor_id", F.coalesce("total_cartas_unicas", F.lit(0)).alias("total_cartas_unicas"),
        "total_cartas", "precio_promedio", "precio_maximo")


def _stats_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_cartas_unicas"),
            F.sum("cantidad").alias("total_cartas"),
            F.round(F.avg("precio").cast("double"), 6).alias("precio_promedio"),
            F.max("precio").alias("precio_maximo")]


def inventory_stats_total(inv: DataFrame) -> DataFrame:
    """A4 single-row form (one row even for an empty input)."""
    return inv.where(F.col("cantidad") > 0).agg(*_stats_columns())


def card_offers(detail: DataFrame, card_ids: DataFrame | None = None,
                condicion: str | None = None, idioma: str | None = None,
                precio_max=None) -> DataFrame:
    """Offers for cards from the detail view: optional filters, P11 price
    bound (``parseFloat``; NaN keeps every non-NULL price, NULL prices fall
    out), ``ORDER BY precio ASC NULLS LAST`` within a card."""
    d = detail
    ks = _keys(card_ids, "card_id")
    if ks is not None:
        d = d.join(ks, "card_id", "left_semi")
    d = _optional_filters(d, condicion, idioma)
    if precio_max:
        bound = parse_float_param(precio_max)
        d = d.where(F.col("precio").cast("double") <= F.lit(bound))
    return d.orderBy("card_id", pg_asc("precio"), "inventario_id")


def name_offers_topk(detail: DataFrame, nombre: str, limit=20) -> DataFrame:
    """``card_name ILIKE '%nombre%' ORDER BY precio ASC NULLS LAST LIMIT k``
    (``inventario_id`` breaks ties).  Spark plans this as a per-partition
    top-k followed by a final top-k (``TakeOrderedAndProject``)."""
    k = parse_int_param(limit)
    if k is None:
        raise ValueError("limit is not a number")
    d = detail.where(ilike_contains("card_name", nombre))
    return d.orderBy(pg_asc("precio"), "inventario_id").limit(k)


def name_offers_total(detail: DataFrame, nombre: str, limit=20) -> DataFrame:
    """``total`` = number of rows returned after the limit."""
    return name_offers_topk(detail, nombre, limit).agg(F.count(F.lit(1)).alias("total"))


def seller_inventory(detail: DataFrame, seller_ids: DataFrame | None = None,
                     search: str | None = None) -> DataFrame:
    """O1: a seller's listing ordered by card name (key as tie-break)."""
    d = detail
    ks = _keys(seller_ids, "vendedor_id")
    if ks is not None:
        d = d.join(ks, "vendedor_id", "left_semi")
    if search:
        d = d.where(ilike_contains("card_name", search))
    return d.orderBy("vendedor_id", pg_asc("card_name"), "inventario_id")


def best_offers_per_card(detail: DataFrame, k: int = 20,
                         order: Sequence[Column] | None = None) -> DataFrame:
    """The ``k`` cheapest offers of every card at once.  ``row_number
    <= k`` is planned as ``WindowGroupLimit`` before and after the shuffle,
    so a card with millions of offers ships at most ``k`` rows per task."""
    order = list(order) if order else [pg_asc("precio"), F.col("inventario_id")]
    w = Window.partitionBy("card_id").orderBy(*order)
    return (detail.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k))


def offers_nested(detail: DataFrame, page_size: int = 50,
                  search: str | None = None) -> DataFrame:
    """Per seller, the header taken from the listing (id, name,
    konami id, contacts) and the lines nested as arrays.  Lines are numbered
    in listing order with skew-safe prefix counts and nested in pages of at
    most ``page_size`` lines, so no array grows with a hot seller and every
    line is kept."""
    from marketframe.operators.ordered import running_totals
    d = detail
    if search:
        d = d.where(ilike_contains("card_name", search))
    numbered = running_totals(
        d, ["vendedor_id"], [F.col("card_name").asc_nulls_last(), F.col("inventario_id")],
        rank_name="line_no")
    paged = numbered.withColumn("page", F.floor((F.col("line_no") - 1) / page_size).cast("long"))
    line = F.struct("line_no", "inventario_id", "card_id", "card_name", "cantidad", "precio",
                    "condicion", "idioma")
    return paged.groupBy("vendedor_id", "page").agg(
        F.struct(F.col("vendedor_id").alias("id"),
                 F.first("vendedor_nombre").alias("nombre"),
                 F.first("konami_id").alias("konami_id"),
                 F.first("whatsapp").alias("whatsapp"),
                 F.first("instagram").alias("instagram")).alias("vendedor"),
        F.array_sort(F.collect_list(line)).alias("inventario"))


def offers_by_card(detail: DataFrame, page_size: int = 50) -> DataFrame:
    """Per card, the header (id, name, number of offers) and the offers by
    price (NULLs last), in pages of at most ``page_size`` lines as in
    ``offers_nested``."""
    from marketframe.operators.ordered import paged_lists
    pages = paged_lists(detail, "card_id", [F.col("precio").asc_nulls_last(), F.col("inventario_id")], "card_name",
                        ["inventario_id", "vendedor_id", "vendedor_nombre", "konami_id", "whatsapp", "instagram",
                         "precio", "condicion", "idioma"], page_size)
    return pages.select("card_id", "page", F.struct(F.col("card_id").alias("id"), F.col("card_name").alias("name"),
                                                    "total").alias("carta"), F.col("lines").alias("ofertas"))
