import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketframe.operators import changes as ch
from marketframe.schemas import INVENTARIO
import replay

NOW = dt.datetime(2024, 5, 1, 12, 0)
LINE_SCHEMA = ("seq long, vendedor_id long, card_id long, cantidad int, precio decimal(12,2), "
               "condicion string, idioma string, edicion string, notas string")


def _lines(spark, rows):
    return spark.createDataFrame(rows, LINE_SCHEMA)


def _state(df):
    return {(r.vendedor_id, r.card_id): r.asDict() for r in df.collect()}


def _random_lines(rng, n, keys=4):
    out = []
    for seq in range(n):
        out.append((seq, rng.randint(1, 2), rng.choice([0, None] + list(range(1, keys))),
                    rng.choice([None, 0, 1, 2, 5]),
                    rng.choice([None, Decimal("0.00"), Decimal("1.50"), Decimal("9.99")]),
                    rng.choice([None, "", "Mint", "Played"]), rng.choice([None, "", "ES"]),
                    rng.choice([None, "", "1st"]), rng.choice([None, "nota"])))
    return out


def _as_dicts(rows):
    cols = ["seq", "vendedor_id", "card_id", "cantidad", "precio", "condicion", "idioma",
            "edicion", "notas"]
    return [dict(zip(cols, r)) for r in rows]


def _base(spark, rows):
    return spark.createDataFrame(rows, INVENTARIO)


BASE_ROWS = [
    (1_000_000_001, 1, 1, 5, Decimal("3.00"), "Mint", "EN", "old", None, NOW - dt.timedelta(days=9),
     NOW - dt.timedelta(days=9)),
    (2_000_000_002, 2, 2, None, None, "Mint", "EN", None, "keep", NOW - dt.timedelta(days=5),
     NOW - dt.timedelta(days=5)),
]


def _replay_base():
    t = {}
    for r in BASE_ROWS:
        t[(r[1], r[2])] = dict(zip(["cantidad", "precio", "condicion", "idioma", "edicion", "notas",
                                    "created_at", "updated_at"], r[3:]))
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_additive_equals_sequential_replay(spark, seed):
    rng = random.Random(seed)
    rows = _random_lines(rng, 40)
    res = ch.upsert_additive(_base(spark, BASE_ROWS), _lines(spark, rows), now=NOW)
    got = _state(res.new_state)
    want = replay.single_add(_replay_base(), _as_dicts(rows), NOW)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        for c in ("cantidad", "precio", "condicion", "idioma", "edicion", "notas", "created_at",
                  "updated_at"):
            assert g[c] == w[c], (k, c, g[c], w[c])
    assert res.rejected.count() == sum(1 for r in rows if not r[2])


@pytest.mark.parametrize("seed", [4, 5])
def test_bulk_upsert_and_running_rows_equal_replay(spark, seed):
    rng = random.Random(seed)
    rows = _random_lines(rng, 50)
    base = _base(spark, BASE_ROWS)
    res = ch.bulk_upsert(base, _lines(spark, rows), now=NOW)
    want, returned = replay.bulk_add(_replay_base(), _as_dicts(rows), NOW)
    got = _state(res.new_state)
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("cantidad", "precio", "condicion", "idioma", "edicion", "notas", "updated_at"):
            assert got[k][c] == w[c], (k, c)
    run = ch.bulk_running_quantities(base, _lines(spark, rows))
    got_run = sorted((r.vendedor_id, r.card_id, r.line_no, r.cantidad) for r in run.collect())
    counters, want_run = {}, []
    for key, qty in returned:
        counters[key] = counters.get(key, 0) + 1
        want_run.append((*key, counters[key], qty))
    assert got_run == sorted(want_run)


def test_bulk_upsert_split_batches_equal_one_batch(spark):
    """Property: applying a batch at once equals applying an ordered split."""
    rng = random.Random(9)
    rows = _random_lines(rng, 60)
    base = _base(spark, BASE_ROWS)
    whole = _state(ch.bulk_upsert(base, _lines(spark, rows), now=NOW).new_state)
    state = base
    for part in (rows[:17], rows[17:41], rows[41:]):
        state = ch.bulk_upsert(state, _lines(spark, part), now=NOW).new_state
    assert _state(state) == whole


def test_upsert_additive_checks_cards(spark):
    cards = spark.createDataFrame([(1,)], "id long")
    rows = [(1, 1, 1, 2, None, None, None, None, None), (2, 1, 7, 1, None, None, None, None, None)]
    res = ch.upsert_additive(_base(spark, BASE_ROWS), _lines(spark, rows), now=NOW, cards=cards)
    assert [r.reason for r in res.rejected.collect()] == ["unknown card"]
    assert _state(res.new_state)[(1, 1)]["cantidad"] == 7


def test_upsert_partial_keeps_and_overwrites(spark):
    base = spark.createDataFrame([(1, "a", "T", 10, 1), (2, "b", "T", 20, 2)],
                                 "id long, name string, type string, atk int, level int")
    batch = spark.createDataFrame([(1, "A", "X", None, 5), (3, "c", "Y", 30, 3)],
                                  "id long, name string, type string, atk int, level int")
    res = ch.upsert_columns(base, batch, ["id"], ["name", "atk", "level"])
    got = {r.id: tuple(r) for r in res.new_state.collect()}
    assert got == {1: (1, "A", "T", None, 5), 2: (2, "b", "T", 20, 2), 3: (3, "c", "Y", 30, 3)}
    assert sorted((r.id, r.was_update) for r in res.affected.collect()) == [(1, True), (3, False)]


def test_batch_duplicates_report(spark):
    batch = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert [tuple(r) for r in ch.check_unique(batch, ["id"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        ch.assert_unique(batch, ["id"])


def test_insert_ignore_keeps_first_and_existing(spark):
    base = spark.createDataFrame([(1, "Effect")], "card_id long, type_name string")
    batch = spark.createDataFrame([(1, "Effect"), (1, "Normal"), (1, "Normal"), (2, "Spell")],
                                  "card_id long, type_name string")
    res = ch.insert_ignore(base, batch, ["card_id", "type_name"])
    assert sorted(tuple(r) for r in res.new_state.collect()) == [
        (1, "Effect"), (1, "Normal"), (2, "Spell")]


def test_replace_children(spark):
    base = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s3")], "card_id long, set_name string")
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    new = spark.createDataFrame([(1, "n1"), (3, "n3")], "card_id long, set_name string")
    res = ch.replace_children(base, ids, new)
    assert sorted(tuple(r) for r in res.new_state.collect()) == [(1, "n1"), (2, "s3"), (3, "n3")]


def test_coalesce_update_empty_string_and_zero_replace(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, s string, n int")
    upd = spark.createDataFrame([(1, "", None), (2, None, 0), (9, "x", 1)], "k long, s string, n int")
    res = ch.coalesce_update(base, upd, ["k"], ["s", "n"])
    assert sorted(tuple(r) for r in res.new_state.collect()) == [(1, "", 5), (2, "b", 0)]
    assert res.affected.count() == 2


def test_coalesce_update_folds_by_seq(spark):
    base = spark.createDataFrame([(1, "a", 5)], "k long, s string, n int")
    upd = spark.createDataFrame([(1, 1, "x", 7), (1, 2, None, 8), (1, 3, "z", None)],
                                "k long, seq long, s string, n int")
    res = ch.coalesce_update(base, upd, ["k"], ["s", "n"], seq="seq")
    assert [tuple(r) for r in res.new_state.collect()] == [(1, "z", 8)]


def test_guarded_update_and_delete(spark):
    base = spark.createDataFrame([(10, 1, 5), (11, 2, 6)], "inventario_id long, vendedor_id long, cantidad int")
    upd = spark.createDataFrame([(10, 1, 9), (11, 1, 9)], "inventario_id long, vendedor_id long, cantidad int")
    res = ch.guarded_update(base, upd, "inventario_id", "vendedor_id", ["cantidad"])
    assert sorted(tuple(r) for r in res.new_state.collect()) == [(10, 1, 9), (11, 2, 6)]
    assert [tuple(r) for r in res.rejected.collect()] == [(11, 1, 9)]
    dels = spark.createDataFrame([(10, 1), (11, 1)], "inventario_id long, vendedor_id long")
    d = ch.guarded_delete(base, dels, "inventario_id", "vendedor_id")
    assert [tuple(r) for r in d.new_state.collect()] == [(11, 2, 6)]
    assert [tuple(r) for r in d.affected.collect()] == [(10, 1, 5)]
    assert [tuple(r) for r in d.rejected.collect()] == [(11, 1)]


def test_set_columns_null_overwrites_every_matching_row(spark):
    players = spark.createDataFrame([("a", "K1", 1, 1), ("b", "K1", 1, 2), ("c", "K2", 1, 3)],
                                    "name string, konamiid string, idtournament long, victory int")
    res = ch.set_columns(players, spark.createDataFrame([("K1", 1, None)], "konamiid string, idtournament long, victory int"),
                         ["konamiid", "idtournament"], ["victory"])
    assert sorted(tuple(r) for r in res.new_state.collect()) == [
        ("a", "K1", 1, None), ("b", "K1", 1, None), ("c", "K2", 1, 3)]


def test_touch_rows(spark):
    users = spark.createDataFrame([(1, None), (2, None)], "id long, updated_at timestamp_ntz")
    res = ch.touch_rows(users, spark.createDataFrame([(2,)], "id long"), "id", now=NOW)
    assert sorted(tuple(r) for r in res.new_state.collect()) == [(1, None), (2, NOW)]


def test_explode_bulk_requests(spark):
    item = "struct<card_id:long, cantidad:int, precio:decimal(12,2), condicion:string, idioma:string, edicion:string, notas:string>"
    reqs = spark.createDataFrame(
        [(1, 1, [(1, 2, None, None, None, None, None), (None, 5, None, None, None, None, None),
                 (1, None, None, "Mint", None, None, None)]),
         (2, 1, []), (3, 2, None)],
        f"seq long, vendedor_id long, cartas array<{item}>")
    lines, rejected = ch.explode_bulk_requests(reqs)
    assert sorted(r.seq for r in rejected.collect()) == [2, 3]
    res = ch.bulk_upsert(_base(spark, []), lines, now=NOW)
    got = {(r.vendedor_id, r.card_id): (r.cantidad, r.condicion) for r in res.new_state.collect()}
    assert got == {(1, 1): (3, "Near Mint")}     # first line's columns, key-less line skipped
    assert res.rejected.count() == 1


def test_guarded_update_stays_within_the_owner_and_applies_in_turn(spark):
    """Two sellers whose rows share an id; several changes to one row."""
    base = spark.createDataFrame([(2_000_000_005, 1, 10), (2_000_000_005, 2, 20)],
                                 "inventario_id long, vendedor_id long, cantidad long")
    upd = spark.createDataFrame([(1, 2_000_000_005, 2, 8), (2, 2_000_000_005, 2, 9), (3, 2_000_000_005, 3, 7)],
                                "seq long, inventario_id long, vendedor_id long, cantidad long")
    res = ch.guarded_update(base, upd, "inventario_id", "vendedor_id", ["cantidad"], seq="seq")
    assert sorted(map(tuple, res.new_state.collect())) == [(2_000_000_005, 1, 10), (2_000_000_005, 2, 9)]
    assert [r.vendedor_id for r in res.rejected.collect()] == [3]


def test_set_columns_keeps_the_last_of_repeated_keys(spark):
    base = spark.createDataFrame([("K1", 1, 0), ("K2", 1, 0)], "k string, t long, v int")
    new = spark.createDataFrame([(1, "K1", 1, 5), (2, "K1", 1, None)], "seq long, k string, t long, v int")
    res = ch.set_columns(base, new, ["k", "t"], ["v"], seq="seq")
    assert sorted(map(tuple, res.new_state.collect()), key=str) == [("K1", 1, None), ("K2", 1, 0)]


def test_insert_ignore_keeps_the_first_row(spark):
    base = spark.createDataFrame([(1, "a", 0)], "k long, v string, seq long")
    batch = spark.createDataFrame([(2, "late", 9), (2, "early", 3), (1, "x", 1)], "k long, v string, seq long")
    res = ch.insert_ignore(base, batch, ["k"], seq="seq")
    assert [tuple(r) for r in res.affected.collect()] == [(2, "early", 3)]
