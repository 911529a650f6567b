import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketframe.operators import inventory as inv
from marketframe.schemas import INVENTARIO

T0 = dt.datetime(2024, 1, 1)
CARDS = ("id long, name string, type string, race string, attribute string, archetype string, "
         "atk int, def int, level int")
SELLERS = ("vendedor_id long, nombres string, apellidos string, konami_id string, whatsapp string, "
           "instagram string, activo boolean")


def _data(spark):
    rows = [
        (1, 1, 10, 2, Decimal("5.00"), "Mint", "EN", None, None, T0, T0),
        (2, 1, 11, 1, None, "Mint", "ES", None, None, T0 + dt.timedelta(days=1), T0),
        (3, 1, 12, 0, Decimal("1.00"), "Mint", "EN", None, None, T0, T0),
        (4, 2, 10, 3, Decimal("4.00"), "Played", "EN", None, None, T0, T0),
        (5, 2, 11, 3, Decimal("9.00"), "Mint", "EN", None, None, T0, T0),
        (6, 3, 10, 3, Decimal("1.00"), "Mint", "EN", None, None, T0, T0),   # inactive seller
    ]
    i = spark.createDataFrame(rows, INVENTARIO)
    c = spark.createDataFrame([(10, "Red Dragon", "M", None, None, None, 1, 1, 1),
                               (11, "rod", "M", None, None, None, 1, 1, 1),
                               (12, "Blue", "M", None, None, None, 1, 1, 1)], CARDS)
    s = spark.createDataFrame([(1, "Ana", "P", "K1", None, None, True),
                               (2, "Bo", "Q", None, "+1", None, True),
                               (3, "Cy", "R", None, None, None, False)], SELLERS)
    return i, c, s


def test_detail_and_listings(spark):
    i, c, s = _data(spark)
    d = inv.inventory_detail(i, c, s)
    assert sorted(r.inventario_id for r in d.collect()) == [1, 2, 4, 5]
    assert {r.inventario_id: r.vendedor_nombre for r in d.collect()}[4] == "Bo Q"
    by_price = [r.inventario_id for r in inv.my_inventory(i, c, orden="precio").collect()]
    assert by_price == [2, 1, 5, 4, 6]     # NULL first in DESC, within seller
    by_bad = [r.inventario_id for r in inv.my_inventory(i, c, orden="drop table").collect()]
    assert by_bad == [1, 2, 4, 5, 6]       # whitelist falls back to name ASC
    filt = inv.my_inventory(i, c, spark.createDataFrame([(1,)], "v long"), condicion="Mint",
                            idioma="EN", search="DRAG")
    assert [r.inventario_id for r in filt.collect()] == [1]


def test_offers_topk_best_and_stats(spark):
    i, c, s = _data(spark)
    d = inv.inventory_detail(i, c, s)
    top = [r.inventario_id for r in inv.name_offers_topk(d, "r_d", "2").collect()]
    assert top == [4, 1]
    assert inv.name_offers_total(d, "r_d", 2).first().total == 2
    offers = inv.card_offers(d, precio_max="abc")      # NaN keeps every non-NULL price
    assert sorted(r.inventario_id for r in offers.collect()) == [1, 4, 5]
    offers = inv.card_offers(d, precio_max="5")
    assert sorted(r.inventario_id for r in offers.collect()) == [1, 4]
    best = {(r.card_id, r.rank): r.inventario_id for r in inv.best_offers_per_card(d, 1).collect()}
    assert best == {(10, 1): 4, (11, 1): 5}
    stats = {r.vendedor_id: tuple(r)[1:] for r in inv.inventory_stats(
        i, spark.createDataFrame([(1,), (2,), (9,)], "v long")).collect()}
    assert stats[1] == (2, 3, 5.0, Decimal("5.00"))
    assert stats[9] == (0, None, None, None)
    assert inv.inventory_stats_total(i.where(F.lit(False))).first().total_cartas_unicas == 0


def test_offers_nested_pages_keep_every_line(spark):
    i, c, s = _data(spark)
    d = inv.inventory_detail(i, c, s)
    pages = inv.offers_nested(d, page_size=1).collect()
    assert sorted((p.vendedor_id, p.page) for p in pages) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert sum(len(p.inventario) for p in pages) == 4
    assert {p.vendedor.nombre for p in pages} == {"Ana P", "Bo Q"}


def test_offers_by_card_total_is_numbered_not_counted_again(spark):
    """cards below, at and over a page; the listing is read once."""
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 9}
    detail = spark.createDataFrame(
        [(c, f"card{c}", c * 100 + k, 1, "n", None, None, None, None if k % 4 == 3 else float(k % 3), "M", "E")
         for c, n in sizes.items() for k in range(n)],
        "card_id long, card_name string, inventario_id long, vendedor_id long, vendedor_nombre string, konami_id string, "
        "whatsapp string, instagram string, precio double, condicion string, idioma string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    got = inv.offers_by_card(detail.mapInArrow(counted, detail.schema), page_size=3).collect()
    once = reads.value
    assert {(r.card_id, r.page): (r.carta.total, len(r.ofertas)) for r in got} == {
        (c, p): (n, min(3, n - 3 * p)) for c, n in sizes.items() for p in range(-(-n // 3))}
    lines = [x for r in sorted(got, key=lambda r: (r.card_id, r.page)) for x in r.ofertas if r.card_id == 5]
    assert [x.line_no for x in lines] == list(range(1, 10))
    # range bounds are sampled in a pass of their own
    assert once <= 2 * sum(sizes.values())


def test_change_lines_are_made_after_the_shuffle(spark, scratch_dir):
    """stored rows are shuffled once, by id and seller; a line holds their values twice."""
    from marketframe.schemas import DRIVER
    from marketframe.sources import bindings as b
    rows = [(o, 10 + o % 3, 1 + o % 2, k, float(k), 5.0 * o, 0.05, 0.01 * (k % 2), "A", "O", T0 + dt.timedelta(days=k))
            for o in range(1, 9) for k in (1, 2)]
    spark.createDataFrame(rows, DRIVER["lineitem"]).write.parquet(f"{scratch_dir}/lineitem.parquet")
    got = b.inventario(spark, scratch_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "struct(" not in plan[plan.index("Exchange "):]
    assert {(r.vendedor_id, r.card_id): r.cantidad for r in got.collect()} == {
        (v, c): sum(r[3] for r in rows if r[2] == v and r[1] == c) for v, c in {(r[2], r[1]) for r in rows}}


def test_offers_by_card_moves_pages_no_more(spark):
    """the listing's lines are dealt once; of the result only pages of keys cut by a chunk are grouped again."""
    detail = spark.createDataFrame(
        [(c, f"card{c}", c * 100 + k, 1, "n", None, None, None, float(k), "M", "E") for c in range(40) for k in range(5)],
        "card_id long, card_name string, inventario_id long, vendedor_id long, vendedor_nombre string, konami_id string, "
        "whatsapp string, instagram string, precio double, condicion string, idioma string")
    got = inv.offers_by_card(detail, page_size=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    branch = plan[plan.index("Union"):plan.index("+- ", plan.index("Union") + plan[plan.index("Union"):].index("FileScan"))]
    assert "Exchange" not in branch and "Join" not in branch
    assert {(r.card_id, r.page): (r.carta.total, len(r.ofertas)) for r in got.collect()} == {
        (c, p): (5, 2 if p < 2 else 1) for c in range(40) for p in range(3)}
