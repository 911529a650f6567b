"""Plan properties the scale design relies on (read with explain)."""
import contextlib
import io

from testdata import SF_SMOKE


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_topk_plans(spark):
    import __spark_entry__ as e
    q = e.queries()
    per_card = _plan(q["q_best_offers_per_card"](spark, SF_SMOKE))
    assert per_card.count("WindowGroupLimit") >= 2          # before and after the shuffle
    assert "TakeOrderedAndProject" in _plan(q["q_name_offers_topk"](spark, SF_SMOKE))


def test_scan_pruning_and_pushdown(spark):
    import __spark_entry__ as e
    q = e.queries()
    plan = _plan(q["q_validate_users"](spark, SF_SMOKE))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan
    # the stored side's time filter reaches the Parquet reader (the change batch
    # is read back from its checkpoint)
    plan = _plan(q["q_bulk_upsert"](spark, SF_SMOKE))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan


def test_small_batch_merge_streams_the_stored_side(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["q_upsert_partial"](spark, SF_SMOKE))
    assert "BroadcastHashJoin LeftOuter" in plan and "FullOuter" not in plan


def test_lines_of_the_inventory_are_shuffled_once(spark):
    """the fold deals the lines by id and seller, as the guarded changes
    need the stored rows, so that side has no exchange of its own."""
    import __spark_entry__ as e
    q = e.queries()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_guarded_delete", "q_guarded_update"):
            plan = _plan(q[name](spark, SF_SMOKE))
            tree = plan[:plan.index("\n\n")]
            dealt = [x for x in plan.split("\n\n") if ") Exchange" in x.split("\n")[0] and "hashpartitioning(" in x]
            # two folds and the side of the changes; the rest spreads the scans
            assert sum("hashpartitioning(inventario_id" in x for x in dealt) == 3, tree
            assert not any("hashpartitioning(vendedor_id" in x for x in dealt), tree
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
