"""Catalog feed: shred nested card documents into six relational tables,
report what was prepared, and run the whole ingest as one job.

Shredding is a set of narrow projections over the feed (``explode`` /
``inline`` are generators: NULL and empty arrays give no rows), so it
scales with the feed and never shuffles.  The ingest then applies the
keyed change rules of ``marketframe.operators.changes``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.semantics import falsy_to_null, parse_float_or_zero
from marketframe.operators import changes as ch

PRICE_FIELDS = ("cardmarket_price", "tcgplayer_price", "ebay_price", "amazon_price",
                "coolstuffinc_price")
CARD_UPDATE_COLUMNS = ("name", "description", "atk", "def", "level", "attribute", "archetype")


def shred_cards(feed: DataFrame) -> DataFrame:
    """Card rows: renames to stored names; ``atk``/``def``/``level``/
    ``attribute``/``archetype`` use ``?? null`` (0 and '' survive)."""
    return feed.select(
        "id", "name", "type", F.col("humanReadableCardType").alias("human_readable_card_type"),
        F.col("frameType").alias("frame_type"), F.col("desc").alias("description"), "race",
        "atk", "def", "level", "attribute", "archetype", "ygoprodeck_url")


def shred_types(feed: DataFrame) -> DataFrame:
    """F8: one row per ``typeline`` entry (missing array -> no rows)."""
    return feed.select(F.col("id").alias("card_id"), F.explode("typeline").alias("type_name"))


def shred_printings(feed: DataFrame) -> DataFrame:
    """F8 + F10 + F14: one row per set; ``set_rarity_code || null``,
    ``parseFloat(set_price) || 0``."""
    s = feed.select(F.col("id").alias("card_id"), F.inline("card_sets"))
    return s.select("card_id", "set_name", "set_code", "set_rarity",
                    falsy_to_null("set_rarity_code").alias("set_rarity_code"),
                    parse_float_or_zero("set_price").alias("set_price"))


def shred_banlist(feed: DataFrame) -> DataFrame:
    """a row only when ``banlist_info`` is present; ``ban_ocg || null``."""
    return (feed.where(F.col("banlist_info").isNotNull())
                .select(F.col("id").alias("card_id"),
                        falsy_to_null("banlist_info.ban_ocg").alias("ban_ocg")))


def shred_images(feed: DataFrame) -> DataFrame:
    s = feed.select(F.col("id").alias("card_id"), F.inline("card_images"))
    return s.select("card_id", "image_url",
                    falsy_to_null("image_url_small").alias("image_url_small"),
                    falsy_to_null("image_url_cropped").alias("image_url_cropped"))


def shred_prices(feed: DataFrame) -> DataFrame:
    s = feed.select(F.col("id").alias("card_id"), F.inline("card_prices"))
    return s.select("card_id", *[parse_float_or_zero(f).alias(f) for f in PRICE_FIELDS])


def report_measures() -> dict[str, Column]:
    """Rows prepared per table (before any dedupe), as aggregates."""
    def entries(array: str) -> Column:
        return F.coalesce(F.sum(F.size(F.coalesce(array, F.array()))), F.lit(0))
    return {"cards": F.count(F.lit(1)), "types": entries("typeline"), "printings": entries("card_sets"),
            "banlist": F.count("banlist_info"), "images": entries("card_images"), "prices": entries("card_prices")}


def ingest_report(feed: DataFrame) -> DataFrame:
    """S8 in one pass over the feed."""
    return feed.agg(*[m.alias(n) for n, m in report_measures().items()])


def unnest_zip(arrays: DataFrame, names: dict[str, str] | list[str] | None = None,
               types: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``SELECT * FROM unnest($1::type[], ...)``: several arrays of
    one row zipped into rows; shorter arrays pad with NULL, a NULL array counts as
    empty.  ``names`` renames
    the outputs, ``types`` casts the arrays first (an entry that cannot be cast
    is an error, as in the source), ``keep`` repeats columns on every row."""
    names = names if isinstance(names, dict) else {c: c for c in (names or arrays.columns)}
    types = types or {}
    kinds = {c: f"array<{types[c]}>" if c in types else arrays.schema[c].dataType.simpleString() for c in names}
    zipped = [F.coalesce(F.col(c).cast(kinds[c]), F.array().cast(kinds[c])).alias(n) for c, n in names.items()]
    return arrays.select(*(keep or []), F.inline(F.arrays_zip(*zipped)))


class CatalogState(NamedTuple):
    cards: DataFrame
    card_types: DataFrame
    card_printings: DataFrame
    banlist_info: DataFrame
    card_images: DataFrame
    card_prices: DataFrame


def ingest(state: CatalogState, feed: DataFrame, check_duplicates: bool = True) -> CatalogState:
    """One feed applied to the stored catalog.

    * cards: D1 partial upsert (name, description, atk, def, level,
      attribute, archetype updated; the rest keeps stored values);
    * types / printings / images / prices: D7 replace the children of the
      feed's cards (types then insert-ignore on (card_id, type_name));
    * banlist: D6 upsert of ``ban_ocg``; a card that left the list keeps it.

    Duplicate card ids in one feed are an error (D2), as in the source.
    ``CatalogStore`` makes the returned tables one new version."""
    if check_duplicates:
        ch.assert_unique(feed, ["id"])
        ch.assert_unique(shred_banlist(feed), ["card_id"])
    ids = feed.select(F.col("id").alias("card_id"))
    cards = ch.upsert_columns(state.cards, shred_cards(feed), ["id"], CARD_UPDATE_COLUMNS)
    types_kept = state.card_types.join(ids.distinct(), "card_id", "left_anti")
    types = ch.insert_ignore(types_kept, shred_types(feed), ["card_id", "type_name"])
    printings = ch.replace_children(state.card_printings, ids, shred_printings(feed))
    images = ch.replace_children(state.card_images, ids, shred_images(feed))
    prices = ch.replace_children(state.card_prices, ids, shred_prices(feed))
    banlist = ch.upsert_columns(state.banlist_info, shred_banlist(feed), ["card_id"], ["ban_ocg"])
    return CatalogState(cards.new_state, types.new_state, printings.new_state,
                        banlist.new_state, images.new_state, prices.new_state)


class CatalogStore:
    """Versions of the six tables under ``root``, each seen whole or not at all::

        v=N/<table>/      one version of a table
        v=N/_feed, _ids   the delivery it was made of
        manifest/         one row per version, written last

    Readers follow the manifest, so an ingest that dies half-way leaves the
    version before it in place; its folder is overwritten by the next attempt.
    What the load reports (S8, D2, rows per table) is observed while the data
    are written: no extra job counts them."""

    MANIFEST = "version long, report map<string,long>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifest")

    def latest(self) -> int | None:
        try:
            return self.versions().agg(F.max("version")).first()[0]
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":   # anything else is a real failure
                raise
            return None                                 # no version yet

    def read(self, version: int | None = None) -> CatalogState:
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no committed catalog under {self.root}")
        return CatalogState(*[self.spark.read.parquet(f"{self.root}/v={version}/{t}") for t in CatalogState._fields])

    def _written(self, df: DataFrame, path: str, **measures: Column) -> tuple[DataFrame, dict]:
        seen = Observation()
        df.observe(seen, *[m.alias(n) for n, m in measures.items()]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def write(self, version: int, state: CatalogState, report: dict | None = None) -> dict:
        """All six tables, then the manifest row that makes them a version."""
        report = dict(report or {})
        for name, df in state._asdict().items():
            _, seen = self._written(df, f"{self.root}/v={version}/{name}", rows=F.count(F.lit(1)))
            report[f"rows_{name}"] = seen["rows"]
        self.spark.createDataFrame([(version, report)], self.MANIFEST).coalesce(1).write.mode("append").parquet(
            f"{self.root}/manifest")
        return report

    def ingest(self, feed: DataFrame) -> dict:
        """R10 as one step: the delivery is staged once (S8 observed), its ids
        are folded (D2 observed), the changed tables become the next version.
        Raises on a repeated card id, with no version made.  Returns the report."""
        before = self.latest()
        version = 0 if before is None else before + 1
        path = f"{self.root}/v={version}"
        staged, report = self._written(feed, f"{path}/_feed", **report_measures())
        ids = staged.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
        ids, seen = self._written(ids, f"{path}/_ids", most=F.max("times"))
        if (seen["most"] or 0) > 1:
            raise ValueError("the feed repeats a card id")
        shred = (shred_cards, shred_types, shred_printings, shred_banlist, shred_images, shred_prices)
        state = self.read(before) if before is not None else CatalogState(
            *[self.spark.createDataFrame([], f(staged).schema) for f in shred])
        return self.write(version, ingest(state, staged, check_duplicates=False), report)
