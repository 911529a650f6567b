import json
import os
import random
import re

import pyarrow as pa
import pytest

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketframe.functions import semantics as sem
from marketframe.operators.ordered import _local_pages, paged_lists, running_totals
from marketframe.session import drop_written, written, written_shuffles
from marketframe.sources.tables import read_feed_lines


@pytest.mark.parametrize("batch_rows", [10000, 37])
def test_running_totals_hot_key_across_chunks(spark, batch_rows):
    # a small Arrow batch size makes key runs continue across batch borders
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}"), i, rng.randint(-5, 9))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    out = running_totals(df, ["k"], ["o"], sums={"run": "v"}, rank_name="rn", num_chunks=16)
    got = {(r.k, r.o): (r.rn, r.run) for r in out.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want, acc = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n, s = acc.get(k, (0, 0))
        acc[k] = (n + 1, s + v)
        want[(k, o)] = acc[k]
    assert got == want


def test_read_feed_lines(spark, scratch_dir):
    path = f"{scratch_dir}/cards.jsonl"
    with open(path, "w") as f:
        f.write(json.dumps({"id": 7, "name": "x", "typeline": ["A"], "atk": 0}) + "\n")
        f.write(json.dumps({"id": 8, "name": "y", "card_sets": []}) + "\n")
    df = read_feed_lines(spark, path)
    assert sorted((r.id, r.atk, r.typeline) for r in df.collect()) == [(7, 0, ["A"]), (8, None, None)]


JS_FLOAT = re.compile(r"^[ \t\n\r\f\v]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)")


def _js_parse_float(text):
    m = JS_FLOAT.match(text)
    return float(m.group(1)) if m else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,eE+- abc", max_size=8), min_size=1, max_size=20))
def test_parse_float_matches_reference(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(sem.parse_float("x")).collect()]
    assert got == [_js_parse_float(t) for t in texts]


def test_null_keys_and_values(spark):
    """A NULL key is a run of its own; a NULL value adds nothing."""
    from marketframe.operators.ordered import running_totals
    rows = [(None if i % 2 else "a", i, None if i % 5 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): (r.rn, r.s) for r in running_totals(df, ["k"], ["o"], {"s": "v"}, "rn", 6).collect()}
    want, state = {}, {}
    for k, o, v in rows:
        rn, s = state.get(k, (0, None))
        s = s if v is None else (s or 0) + v
        state[k] = (rn + 1, s)
        want[k, o] = state[k]
    assert got == want


def _paged(rows, page_size):
    """(key, page) -> (total, [(line_no, o), ...]) of rows (key, o)."""
    want = {}
    for k in {k for k, _ in rows if k is not None}:
        mine = sorted(o for x, o in rows if x == k)
        for i, o in enumerate(mine):
            want.setdefault((k, i // page_size), (len(mine), []))[1].append((i + 1, o))
    return want


@pytest.mark.parametrize("chunks,held,batch_rows", [(1, 20000, 10000), (5, 20000, 37), (16, 20, 7), (40, 1, 10000)])
def test_paged_lists_hot_key_null_key_and_borders(spark, chunks, held, batch_rows):
    """one key over many chunks, keys cut by a chunk or an Arrow batch, keys of over ``held`` lines."""
    rng = random.Random(5)
    rows = [((None if rng.random() < 0.1 else 7 if rng.random() < 0.4 else rng.randint(0, 60)), i) for i in range(1500)]
    df = spark.createDataFrame([(k, o, f"n{k}", o * 2) for k, o in rows], "k long, o long, name string, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        got = paged_lists(df, "k", ["o"], "name", ["o", "v"], 4, num_chunks=chunks, held=held).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {(r.k, r.page): (r.total, [(x.line_no, x.o) for x in r.lines]) for r in got} == _paged(rows, 4)
    assert len(got) == len(_paged(rows, 4))
    assert all(r.name == f"n{r.k}" and all(x.v == 2 * x.o for x in r.lines) for r in got)


def test_paged_lists_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "x")], "k long, o long, name string")
    assert paged_lists(df, "k", ["o"], "name", ["o"], 4).collect() == []


def test_keys_inside_a_chunk_are_nested_there(spark):
    """only the first and the last key of a chunk, and long ones, are left to be grouped again."""
    schema = to_arrow_schema(T.StructType.fromDDL(
        "k bigint, name string, _chunk int, page bigint, total bigint, lines array<struct<line_no: bigint, o: bigint>>"))
    keys = [1] * 5 + [2] * 3 + [3] * 4 + [4] * 9 + [5] * 2
    table = pa.table({"k": keys, "name": [f"n{k}" for k in keys], "o": list(range(len(keys))),
                      "_chunk": pa.array([0] * len(keys), pa.int32())})
    for size in (1, 4, 100):
        out = [r for b in _local_pages("k", "name", ["o"], 3, schema, 6)(iter(table.to_batches(size))) for r in b.to_pylist()]
        done = {(r["k"], r["page"]): (r["total"], len(r["lines"])) for r in out if r["total"] is not None}
        assert {k: v for k, v in done.items() if k[0] != 4} == {(2, 0): (3, 3), (3, 0): (4, 3), (3, 1): (4, 1)}
        assert {r["k"] for r in out if r["total"] is None} <= {1, 4, 5}
        assert sorted(x["o"] for r in out for x in r["lines"]) == list(range(len(keys)))


def test_written_tables_set_shuffles_and_restore_them(spark):
    """shuffle files go with the write; the session's settings stay."""
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n, None) for n in names]
    with written_shuffles(spark.range(9)):
        assert spark.conf.get(names[2]) == "true" and int(spark.conf.get(names[0])) >= int(before[3])
        assert spark.conf.get(names[1]) == str(16 << 20)
    assert [spark.conf.get(n, None) for n in names] == before
    df, folder = written(spark.range(9), "t")
    assert df.count() == 9
    drop_written(spark, folder)
    assert not os.path.exists(folder.removeprefix("file://").removeprefix("file:"))
