import json
from decimal import Decimal

from pyspark.sql import functions as F

from marketframe.operators import catalog as cat
from marketframe.operators import search as se
from marketframe.sources.tables import read_feed

FEED = {"data": [
    {"id": 1, "name": "100% Dragon_X", "type": "Effect Monster", "humanReadableCardType": "Effect",
     "frameType": "effect", "desc": "d", "race": "Dragon", "atk": 0, "def": 2500, "level": 8,
     "attribute": "", "archetype": None, "ygoprodeck_url": "u1",
     "typeline": ["Dragon", "Effect", "Dragon"],
     "card_sets": [{"set_name": "B", "set_code": "B1", "set_rarity": "R", "set_rarity_code": "",
                    "set_price": "12.5abc"},
                   {"set_name": "A", "set_code": "A1", "set_rarity": "C", "set_rarity_code": "(C)",
                    "set_price": "1,234"},
                   {"set_name": "C", "set_code": "C1", "set_rarity": "C", "set_rarity_code": "(C)",
                    "set_price": None}],
     "banlist_info": {"ban_ocg": None},
     "card_images": [{"image_url": "i1", "image_url_small": "", "image_url_cropped": "c1"}],
     "card_prices": [{"cardmarket_price": "0.10", "tcgplayer_price": "abc", "ebay_price": "",
                      "amazon_price": "12.50", "coolstuffinc_price": None}]},
    {"id": 2, "name": "Plain", "type": "Spell Card", "humanReadableCardType": "Spell",
     "frameType": "spell", "desc": "e", "race": "Normal", "ygoprodeck_url": "u2",
     "typeline": [], "banlist_info": {"ban_ocg": "Banned"}},
]}


def _feed(spark, scratch_dir):
    path = f"{scratch_dir}/feed.json"
    with open(path, "w") as f:
        json.dump(FEED, f)
    return read_feed(spark, path)


def test_read_and_shred(spark, scratch_dir):
    feed = _feed(spark, scratch_dir)
    cards = {r.id: r for r in cat.shred_cards(feed).collect()}
    assert cards[1].atk == 0 and cards[1].attribute == "" and cards[2].atk is None
    assert sorted(tuple(r) for r in cat.shred_types(feed).collect()) == [
        (1, "Dragon"), (1, "Dragon"), (1, "Effect")]
    pr = {r.set_code: (r.set_rarity_code, r.set_price) for r in cat.shred_printings(feed).collect()}
    assert pr == {"B1": (None, Decimal("12.50")), "A1": ("(C)", Decimal("1.00")),
                  "C1": ("(C)", Decimal("0.00"))}
    assert sorted(tuple(r) for r in cat.shred_banlist(feed).collect()) == [(1, None), (2, "Banned")]
    assert [tuple(r) for r in cat.shred_images(feed).collect()] == [(1, "i1", None, "c1")]
    assert [tuple(r) for r in cat.shred_prices(feed).collect()] == [
        (1, Decimal("0.10"), Decimal("0.00"), Decimal("0.00"), Decimal("12.50"), Decimal("0.00"))]
    rep = cat.ingest_report(feed).first().asDict()
    assert rep == dict(cards=2, types=3, printings=3, banlist=2, images=1, prices=1)


def test_ingest_and_round_trip(spark, scratch_dir):
    feed = _feed(spark, scratch_dir)
    empty = cat.CatalogState(*[spark.createDataFrame([], s) for s in (
        cat.shred_cards(feed).schema, cat.shred_types(feed).schema, cat.shred_printings(feed).schema,
        cat.shred_banlist(feed).schema, cat.shred_images(feed).schema, cat.shred_prices(feed).schema)])
    st = cat.ingest(empty, feed)
    st2 = cat.ingest(st, feed)          # re-ingest: same content, no duplicates
    for a, b in zip(st, st2):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    docs = se.search_nested(*st2, name="dragon")
    d = docs.first()
    # card_types is unique on (card_id, type_name): the repeated entry is stored once
    assert d.id == 1 and d.typeline == ["Dragon", "Effect"]
    assert [s.set_name for s in d.card_sets] == ["A", "B", "C"]
    assert d.banlist_info is not None and d.banlist_info.ban_ocg is None
    assert d.card_images[0].id == 1 and d.card_prices[0].cardmarket_price == "0.10"
    js = se.to_json_documents(se.search_nested(*st2, name="plain")).first().doc
    doc = json.loads(js)
    assert doc["typeline"] == [] and doc["card_sets"] == [] and doc["atk"] is None
    assert doc["banlist_info"] == {"ban_ocg": "Banned"}


def test_store_makes_a_version_whole_or_not_at_all(spark, scratch_dir, monkeypatch):
    import pytest
    feed = _feed(spark, scratch_dir)
    store = cat.CatalogStore(spark, f"{scratch_dir}/catalog")
    with pytest.raises(FileNotFoundError):
        store.read()
    report = store.ingest(feed)
    assert {k: report[k] for k in ("cards", "types", "printings", "banlist", "images", "prices")} == cat.ingest_report(
        feed).first().asDict()
    assert report["rows_card_types"] == 2 and report["rows_cards"] == 2
    first = [sorted(map(tuple, t.collect())) for t in store.read()]
    # a later delivery dies after the third table: the first version stays
    later = feed.withColumn("name", F.concat("name", F.lit("!")))
    written = store._written

    def dies(df, path, **measures):
        if path.endswith("/banlist_info"):
            raise RuntimeError("executor lost")
        return written(df, path, **measures)
    monkeypatch.setattr(store, "_written", dies)
    with pytest.raises(RuntimeError):
        store.ingest(later)
    assert store.latest() == 0 and [sorted(map(tuple, t.collect())) for t in store.read()] == first
    monkeypatch.setattr(store, "_written", written)
    store.ingest(later)
    assert store.latest() == 1 and {r.name for r in store.read().cards.collect()} == {"100% Dragon_X!", "Plain!"}
    assert [sorted(map(tuple, t.collect())) for t in store.read(0)] == first
    # a repeated id makes no version
    with pytest.raises(ValueError):
        store.ingest(feed.unionByName(feed))
    assert store.latest() == 1
    same = cat.ingest(store.read(0), later)
    assert [sorted(map(tuple, t.collect())) for t in same] == [sorted(map(tuple, t.collect())) for t in store.read()]


def test_duplicate_ids_are_an_error(spark):
    feed = spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string")
    import pytest
    with pytest.raises(ValueError):
        from marketframe.operators import changes as ch
        ch.assert_unique(feed, ["id"])


def test_unnest_zip_pads(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a"])], "a array<long>, b array<string>")
    assert [tuple(r) for r in cat.unnest_zip(df).collect()] == [(1, "a"), (2, None), (3, None)]


def test_unnest_zip_casts_and_null_arrays(spark):
    df = spark.createDataFrame([(1, ["1", None], None, ["7.50"]), (2, None, None, None), (3, [], ["9"], [" 2 "])],
                               "k int, a array<string>, b array<string>, c array<string>")
    out = cat.unnest_zip(df, {"a": "x", "b": "y", "c": "z"}, types={"a": "bigint", "b": "int", "c": "decimal(12,2)"}, keep=["k"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, 1, None, Decimal("7.50")), (1, None, None, None), (3, None, 9, Decimal("2.00"))], key=str)
