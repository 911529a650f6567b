"""Many searches at once against the filter of each."""
import random
from decimal import Decimal

from pyspark.sql import functions as F

from marketframe.functions.semantics import ilike_contains
from marketframe.operators import multi_search as ms

TEXTS = ["red", "RING", "e", "ld", "r_d", "a%n", "%", "_", "__", "100%", "100\\%", "\\_x", "a\\b", "\\\\", "Ñandú", "zzz",
         "re ", " r", "d  w", "x_%y", "ANCIENT RED", "İ", "red ring of the old", "''", "e\\"]


def _cards(spark):
    rng = random.Random(4)
    words = ["red", "ring", "old", "ancient", "ñandú", "100%", "a_x", "ab", "a\\b", "World", "wi", "e", "İz", "it's ''q''"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)] + ["", None, " ", "e%"]
    names += names[:60]
    return spark.createDataFrame([(k, n, rng.choice([*words, None])) for k, n in enumerate(names)],
                                 "id long, name string, other string")


def test_equals_one_filter_a_request(spark):
    cards = _cards(spark).cache()
    requests = spark.createDataFrame([*enumerate(TEXTS), (90, None), (91, ""), (92, "  ")], "request_id long, text string")
    got = sorted(tuple(r) for r in ms.search_many(cards, ["name"], requests).collect())
    want = sorted((k, r.id) for k, t in enumerate(TEXTS) for r in cards.where(ilike_contains("name", t)).collect())
    assert got == want and want
    assert {r.request_id for r in ms.rejected_requests(requests).collect()} == {90, 91, 92}
    got = sorted(tuple(r) for r in ms.search_many(cards, ["name", "other"], requests).collect())
    want = sorted((k, r.id) for k, t in enumerate(TEXTS) for r in cards.where(
        ilike_contains("name", t) | ilike_contains("other", t)).collect())
    assert got == want


def test_no_cross_join(spark):
    cards = _cards(spark)
    requests = spark.createDataFrame([(1, "red")], "request_id long, text string")
    plan = ms.search_many(cards, ["name"], requests)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_optional_filters_of_each_request(spark):
    detail = spark.createDataFrame(
        [(1, "red ring", "Mint", "EN", Decimal("5.00")), (2, "red ring", "Used", "ES", None),
         (3, "old ring", "Mint", "ES", Decimal("9.00"))],
        "inventario_id long, card_name string, condicion string, idioma string, precio decimal(12,2)")
    requests = spark.createDataFrame(
        [(1, "ring", None, "", None), (2, "ring", "Mint", None, None), (3, "red", "", "ES", None),
         (4, "RING", None, None, 6.0), (5, "ring", "Mint", "ES", float("nan")), (6, None, None, None, None)],
        "request_id long, text string, condicion string, idioma string, precio_max double")
    got = {}
    for r in ms.offers_for_requests(detail, requests).collect():
        got.setdefault(r.request_id, set()).add(r.inventario_id)
    assert got == {1: {1, 2, 3}, 2: {1, 3}, 3: {2}, 4: {1}, 5: {3}}


def test_empty_tables(spark):
    cards, none = _cards(spark), spark.createDataFrame([], "request_id long, text string")
    assert ms.search_many(cards, ["name"], none).count() == 0
    one = spark.createDataFrame([(1, "red")], "request_id long, text string")
    assert ms.search_many(cards.where(F.lit(False)), ["name"], one).count() == 0
