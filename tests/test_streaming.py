import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from marketframe.operators import changes as ch
from marketframe.operators import lockout as lk
from marketframe.schemas import INVENTARIO, INVENTORY_LINES
from marketframe.streaming import inventory_stream as ist
from marketframe.streaming.lockout_stream import ROCKSDB, lockout_stream

NOW = dt.datetime(2024, 6, 1)


def test_bulk_stream_equals_batch(spark, scratch_dir):
    rng = random.Random(5)
    base = spark.createDataFrame([(1_000_000_001, 1, 1, 5, Decimal("1.00"), "Mint", "EN", None, None,
                                   NOW, NOW)], INVENTARIO)
    rows = [(s, rng.randint(1, 2), rng.choice([0, 1, 2, 3]), rng.choice([None, 0, 2]),
             None, None, None, None, None) for s in range(30)]
    src = f"{scratch_dir}/src"
    for i, part in enumerate((rows[:10], rows[10:20], rows[20:])):
        spark.createDataFrame(part, INVENTORY_LINES).coalesce(1).write.parquet(f"{src}/f{i}")
    q = ist.start_bulk_stream(spark, f"{src}/*", base, f"{scratch_dir}/inv",
                              f"{scratch_dir}/ckpt", now_fn=lambda b: NOW, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = ist.read_inventory(spark, f"{scratch_dir}/inv")
    want = ch.bulk_upsert(base, spark.createDataFrame(rows, INVENTORY_LINES), now=NOW).new_state
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a replayed micro-batch (same id) changes nothing
    before = ist.inventory_log(spark, f"{scratch_dir}/inv").commits()
    ist.apply_bulk_batches(ist.inventory_log(spark, f"{scratch_dir}/inv"), lambda b: NOW)(
        spark.createDataFrame(rows[:10], INVENTORY_LINES), 0)
    again = ist.read_inventory(spark, f"{scratch_dir}/inv")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(ist.inventory_log(spark, f"{scratch_dir}/inv").commits()) == sorted(before)


def _lines(spark, rows):
    return spark.createDataFrame([(k, s, c, q, None, None, None, None, None) for k, (s, c, q) in enumerate(rows)],
                                 INVENTORY_LINES)


def test_log_writes_what_a_batch_touches_and_survives_a_lost_commit(spark, scratch_dir):
    base = spark.range(4000).selectExpr(
        "1000000000 + id AS inventario_id", "1L AS vendedor_id", "id AS card_id", "5L AS cantidad",
        "CAST(1 AS DECIMAL(12,2)) AS precio", "'Mint' AS condicion", "'EN' AS idioma", "CAST(NULL AS STRING) AS edicion",
        "CAST(NULL AS STRING) AS notas", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at").selectExpr(*[
            f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in INVENTARIO.fields])
    root = f"{scratch_dir}/log"
    log = ist.inventory_log(spark, root)
    log.create(base)
    log.create(base.limit(0))                   # there is a base already
    run = ist.apply_bulk_batches(log, lambda b: NOW)
    batches = [_lines(spark, [(1, 7, 2), (1, 9, 1), (2, 7, 4), (1, 7, 1), (1, 0, 3)]), _lines(spark, [(1, 7, 1)])]
    run(batches[0], 0)
    # data written by a writer that died before its commit is not seen, and is overwritten
    base.limit(50).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{root}/data/kind=delta/version=1")
    got = {(r.vendedor_id, r.card_id): r.cantidad for r in log.read().where("card_id IN (7, 9)").collect()}
    assert got == {(1, 7): 8, (1, 9): 6, (2, 7): 4}
    run(batches[1], 1)
    assert {(c.kind, c.version, c.rows) for c in log.commits()} == {
        ("base", -1, 4000), ("delta", 0, 3), ("delta", 1, 1)}
    want = ch.bulk_upsert(ch.bulk_upsert(base, batches[0], now=NOW).new_state, batches[1], now=NOW).new_state
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, want.collect()))
    # a batch of one key opens one bucket
    named = [r[0] for r in batches[1].select(log._bucket()).collect()]
    assert log._versions(None, named).select(F.input_file_name()).distinct().count() <= 3
    assert log.spark.read.parquet(f"{root}/data").select(F.input_file_name()).distinct().count() > 60
    assert log.compact() is False and log.compact(always=True) is True
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, want.collect()))
    assert log.read(before=1).where("vendedor_id = 1 AND card_id = 7").first().cantidad == 8
    run(batches[0], 2)
    assert log.read().where("vendedor_id = 1 AND card_id = 7").first().cantidad == 12


def test_log_compacts_by_rows(spark, scratch_dir):
    root = f"{scratch_dir}/small"
    log = ist.inventory_log(spark, root)
    log.create(spark.createDataFrame([], INVENTARIO))
    run = ist.apply_bulk_batches(log, lambda b: NOW)
    for k in range(4):
        run(_lines(spark, [(1, c, 1) for c in range(1, 6 + k)]), k)
    run(_lines(spark, []), 4)
    kinds = [c.kind for c in log.commits()]
    assert kinds.count("base") >= 3 and kinds.count("delta") == 5
    assert {r.card_id: r.cantidad for r in log.read().collect()} == {
        c: sum(c < 6 + k for k in range(4)) for c in range(1, 9)}


def test_log_moves_no_stored_row(spark, scratch_dir):
    """Stored rows lie as their key is hashed: reading them and meeting a change
    set that is dealt alike shuffles nothing of theirs."""
    base = spark.createDataFrame([(1_000_000_000 * v + c, v, c, 5, Decimal("1.00"), "Mint", "EN", None, None, NOW, NOW)
                                  for v in range(4) for c in range(50)], INVENTARIO)
    log = ist.inventory_log(spark, f"{scratch_dir}/still", 4)
    log.create(base)
    run = ist.apply_bulk_batches(log, lambda b: NOW)
    batches = [_lines(spark, [(v, c, 1) for v in range(5) for c in range(k, 50, 9)] * 2) for k in (3, 5)]
    for k, batch in enumerate(batches):
        run(batch, k)
    plan = log.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = base
    for batch in batches:
        want = ch.bulk_upsert(want, batch, now=NOW).new_state
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, want.collect()))
    # another reader of the same folder, whatever its own settings
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = ist.inventory_log(spark, f"{scratch_dir}/still", 7)
        assert (again.buckets, again.parts) == (4, 8)
        assert sorted(map(tuple, again.read().collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lockout_stream_equals_batch(spark, scratch_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    sellers = spark.createDataFrame(
        [(1, True, 0, None, None), (2, True, 3, None, None), (3, False, 0, None, None)],
        "vendedor_id long, activo boolean, intentos_fallidos int, bloqueado_hasta timestamp_ntz, "
        "ultimo_login timestamp_ntz")
    attempts, t = [], t0
    for _ in range(120):
        t += dt.timedelta(seconds=rng.randint(1, 300))
        attempts.append((rng.choice([1, 1, 2, 3, 7]), t, rng.random() < 0.4))
    # a final attempt of an unknown account far later moves the watermark past every other attempt
    sentinel = (99, t + dt.timedelta(days=2), True)
    src = f"{scratch_dir}/att"
    schema = "account_id long, at timestamp_ntz, password_ok boolean"
    shuffled = attempts[:]
    rng.shuffle(shuffled)                           # out-of-order arrival inside the delay
    chunks = [sorted(attempts[:40], key=lambda r: rng.random()), attempts[40:80], attempts[80:], [sentinel]]
    for i, part in enumerate(chunks):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = lockout_stream(stream, sellers, lock=dt.timedelta(minutes=15), delay="1 day")
    q = (out.writeStream.format("memory").queryName("lockout_out").outputMode("append")
            .option("checkpointLocation", f"{scratch_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.account_id, r.at, r.outcome) for r in spark.table("lockout_out").collect()
                 if r.account_id != 99)
    batch, _ = lk.login_lockout(spark.createDataFrame(attempts, schema), sellers,
                                lock=dt.timedelta(minutes=15))
    want = sorted((r.account_id, r.at, r.outcome) for r in batch.collect())
    assert got == want


def test_lockout_stream_reports_late_attempts(spark, scratch_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    t0 = dt.datetime(2024, 1, 1)
    sellers = spark.createDataFrame(
        [(1, True, 0, None, None)],
        "vendedor_id long, activo boolean, intentos_fallidos int, bloqueado_hasta timestamp_ntz, "
        "ultimo_login timestamp_ntz")
    schema = "account_id long, at timestamp_ntz, password_ok boolean"
    src = f"{scratch_dir}/late"
    batches = [[(1, t0, False), (1, t0 + dt.timedelta(hours=5), False)],
               [(1, t0 + dt.timedelta(hours=10), True)],
               [(1, t0 - dt.timedelta(minutes=1), True)],   # before an applied attempt
               [(1, t0 + dt.timedelta(days=3), True)]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = lockout_stream(stream, sellers, delay="1 hour")
    q = (out.writeStream.format("memory").queryName("late_out").outputMode("append")
            .option("checkpointLocation", f"{scratch_dir}/ck2").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.at, r.outcome) for r in spark.table("late_out").collect())
    late_at = t0 - dt.timedelta(minutes=1)
    # every attempt has one row, but the last one, which is pending
    assert got == [(late_at, "late"), (t0, "failed"), (t0 + dt.timedelta(hours=5), "failed"),
                   (t0 + dt.timedelta(hours=10), "ok")]
    dropped = sum(op.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped == 0
