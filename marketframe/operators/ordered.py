"""Ordered logic that stays correct and balanced when one key is hot.

``running_totals`` is a per-key prefix sum / row number in arrival order.
A plain ``Window.partitionBy(key)`` would send every row of a key to one
task, so a key holding a third of the data would make a third of the job
one straggler.  Instead:

1. range-partition on (key, order) and sort within partitions: Spark
   samples bounds, so a hot key is cut into many contiguous chunks (one per
   partition) in different tasks;
2. each partition computes the local running values of its (chunk, key)
   runs in one vectorised pass (``mapInPandas``; pandas ``cumsum`` /
   ``cumcount`` per run) - no second shuffle;
3. per (chunk, key) totals are summed over the earlier chunks of the same
   key.  Only keys that span more than one chunk need an offset, and there
   are at most two such (chunk, key) pairs per chunk boundary, so the
   offset table is bounded by twice the number of partitions and is joined
   with a broadcast whose size is proven by construction.

The local result is written once to the shared checkpoint folder, as Parquet,
so later branches read the columns they need: range bounds are sampled anew each
time an exchange re-runs, so every later branch (and any recomputation
after a lost executor) must read the same chunks.

``paged_lists`` nests the rows of each key in numbered pages on the same
chunks.  A key that begins and ends inside a chunk is numbered, counted and
nested there and moves no more; only the first and the last key of a chunk may
go on in another one, and only their rows are numbered and grouped again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketframe.session import checkpoint_dir, drop_written, written

# Rows of a chunk of ``paged_lists``; lines of one key that a task holds at most.
CHUNK_ROWS = 500_000
HELD_LINES = 20_000

_SUMMABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sum_type(t: T.DataType) -> T.DataType:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(t, _SUMMABLE):
        return T.LongType()
    raise TypeError(f"running sums support integral and floating columns, not {t}")


def _local_prefix(keys: list[str], sums: dict[str, str]):
    """``mapInPandas`` body: rows are sorted by (key, order) within the
    partition; adds the 1-based position and running sums of each key run.
    The run of the last key of a batch continues into the next batch."""

    def run(batches):
        carry_key, carry_vals = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            g = pdf.groupby(keys, sort=False, dropna=False)
            pdf["_lrank"] = g.cumcount() + 1
            for name, src in sums.items():
                # as in SQL: a NULL adds nothing, the sum is NULL before any value
                total = pdf[src].fillna(0).groupby([pdf[k] for k in keys], sort=False, dropna=False).cumsum()
                seen = pdf[src].notna().groupby([pdf[k] for k in keys], sort=False, dropna=False).cumsum()
                pdf[f"_l_{name}"] = total.astype("float64" if total.dtype.kind == "f" else "Int64").where(seen > 0)
            first_key = tuple(pdf.iloc[0][k] for k in keys)
            if carry_key is not None and _same_key(first_key, carry_key):
                same = pd.Series(True, index=pdf.index)
                for k, v in zip(keys, carry_key):
                    same &= pdf[k].isna() if pd.isna(v) else pdf[k] == v
                pdf.loc[same, "_lrank"] += carry_vals[0]
                for i, name in enumerate(sums):
                    if not pd.isna(carry_vals[i + 1]):
                        pdf.loc[same, f"_l_{name}"] = pdf.loc[same, f"_l_{name}"].fillna(0) + carry_vals[i + 1]
            last = pdf.iloc[-1]
            carry_key = tuple(last[k] for k in keys)
            carry_vals = [last["_lrank"]] + [last[f"_l_{n}"] for n in sums]
            yield pdf
    return run


def _same_key(a: tuple, b: tuple) -> bool:
    """Equal keys; NULLs are equal to each other."""
    return all((pd.isna(x) and pd.isna(y)) or (not pd.isna(x) and not pd.isna(y) and x == y)
               for x, y in zip(a, b))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   sums: dict[str, str] | None = None, rank_name: str | None = None,
                   num_chunks: int | None = None) -> DataFrame:
    """Add, per key in ``order``, a 1-based row number (``rank_name``) and
    running sums (``{output_name: input_column}``) including the current row.

    ``order`` must be a total order within a key (ties make numbering
    arbitrary, exactly as for ``row_number``).  NULL keys form their own run;
    a NULL value adds nothing, and a sum is NULL before its first value."""
    sums = dict(sums or {})
    keys = list(keys)
    order_c = _order_cols(order)
    spark = df.sparkSession
    n = num_chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    fields = list(df.schema.fields)
    out_schema = T.StructType(
        fields + [T.StructField("_chunk", T.IntegerType()), T.StructField("_lrank", T.LongType())]
        + [T.StructField(f"_l_{name}", _sum_type(df.schema[src].dataType))
           for name, src in sums.items()])
    ranged = (df.repartitionByRange(n, *[F.col(k) for k in keys], *order_c)
                .sortWithinPartitions(*[F.col(k) for k in keys], *order_c)
                .withColumn("_chunk", F.spark_partition_id()))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    ranged.mapInPandas(_local_prefix(keys, sums), out_schema).write.parquet(folder)
    local = spark.read.schema(out_schema).parquet(folder)

    totals = local.groupBy("_chunk", *keys).agg(
        F.max("_lrank").alias("_trank"),
        *[F.sum(src).alias(f"_t_{name}") for name, src in sums.items()])
    span = Window.partitionBy(*keys)
    before = (Window.partitionBy(*keys).orderBy("_chunk")
                    .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (totals.withColumn("_nchunks", F.count(F.lit(1)).over(span))
                     .where(F.col("_nchunks") > 1)
                     .select("_chunk", *keys,
                             F.coalesce(F.sum("_trank").over(before), F.lit(0)).alias("_orank"),
                             *[F.sum(f"_t_{name}").over(before).alias(f"_o_{name}")
                               for name in sums]))
    # Bounded by 2 x number of chunks (see module doc): safe to broadcast.
    offsets = offsets.select(F.col("_chunk").alias("_ochunk"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                             "_orank", *[f"_o_{name}" for name in sums])
    same = F.col("_chunk") == F.col("_ochunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(F.broadcast(offsets), same, "left")
    extra = []
    if rank_name:
        extra.append((F.col("_lrank") + F.coalesce(F.col("_orank"), F.lit(0))).alias(rank_name))
    for name in sums:
        extra.append(F.coalesce(F.col(f"_l_{name}") + F.col(f"_o_{name}"), F.col(f"_l_{name}"),
                                F.col(f"_o_{name}")).alias(name))
    return out.select(*[f.name for f in fields], *extra)


def _local_pages(key: str, head: str, lines: list[str], page_size: int, schema: pa.Schema, held: int):
    """``mapInArrow`` body of ``paged_lists``: rows are sorted by (key, order)
    within the partition.  Keys that begin and end inside it give finished pages
    with ``total``; the others, and keys of over ``held`` lines, pages without
    it, numbered from the chunk's first line of the key."""
    line_type = schema.field("lines").type.value_type

    def pages(rows: pa.RecordBatch, starts: np.ndarray, done: int, open_first: bool, open_last: bool):
        """Runs that begin at ``starts``; ``done`` lines of the first one are out already."""
        n = rows.num_rows
        ends = np.append(starts[1:], n)
        number = np.arange(n) - np.repeat(starts, ends - starts) + 1
        number[:ends[0]] += done
        total, known = ends - starts, np.ones(len(starts), bool)
        known[0] &= not open_first
        known[-1] &= not open_last
        first = (number - 1) % page_size == 0
        first[starts] = True
        at = np.flatnonzero(first)
        run = np.searchsorted(starts, at, "right") - 1
        struct = pa.StructArray.from_arrays(
            [pa.array(number, pa.int64()), *(rows.column(c).cast(line_type.field(c).type) for c in lines)],
            fields=[line_type.field(i) for i in range(line_type.num_fields)])
        heads = rows.select([key, head, "_chunk"]).take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [*(heads.column(i).cast(schema.field(i).type) for i in range(3)), pa.array((number[at] - 1) // page_size, pa.int64()),
             pa.array(total[run], pa.int64(), mask=~known[run]),
             pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), struct, type=schema.field("lines").type)],
            schema=schema)

    def run(batches):
        rest, done, open_first = None, 0, True      # rows of the run that may go on, its lines that are out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            keys = rows.column(key)
            cut = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1]).astype(np.int64)
            last = int(starts[-1])
            if last:
                yield pages(rows.slice(0, last), starts[:-1], done, open_first, False)
                done, open_first = 0, False
            rest = rows.slice(last)
            if rest.num_rows > held:      # one row stays, to be compared with the next key
                yield pages(rest.slice(0, rest.num_rows - 1), np.zeros(1, np.int64), done, True, True)
                done, open_first = done + rest.num_rows - 1, True
                rest = rest.slice(rest.num_rows - 1)
        if rest is not None:
            yield pages(rest, np.zeros(1, np.int64), done, True, True)
    return run


def paged_lists(df: DataFrame, key: str, order: Sequence[str | Column], head: str, lines: Sequence[str],
                page_size: int, num_chunks: int | None = None, held: int = HELD_LINES) -> DataFrame:
    """Per ``key`` the rows in ``order``, nested in pages of at most
    ``page_size``: ``(key, page, head, total, lines)``, where ``lines`` are
    structs of ``line_no`` (1-based in the key) and the named columns, ``head``
    is of a row of the page and ``total`` counts the key's rows.  NULL keys are
    dropped.  ``order`` must be a total order within a key."""
    spark = df.sparkSession
    order_c = _order_cols(order)
    df = df.where(F.col(key).isNotNull()).select(key, head, *lines)
    # the shuffles that made the rows go before theirs begins; the footers count them
    rows, folder = written(df, "rows")
    n = num_chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHUNK_ROWS))
    line_type = T.StructType([T.StructField("line_no", T.LongType())] + [rows.schema[c] for c in lines])
    schema = T.StructType([rows.schema[key], rows.schema[head], T.StructField("_chunk", T.IntegerType()),
                           T.StructField("page", T.LongType()), T.StructField("total", T.LongType()),
                           T.StructField("lines", T.ArrayType(line_type))])
    ranged = (rows.repartitionByRange(n, F.col(key), *order_c).sortWithinPartitions(F.col(key), *order_c)
                  .withColumn("_chunk", F.spark_partition_id()))
    pieces, _ = written(ranged.mapInArrow(
        _local_pages(key, head, list(lines), page_size, to_arrow_schema(schema), held), schema), "pages")
    drop_written(spark, folder)

    opened = pieces.where(F.col("total").isNull())
    counts = opened.groupBy(key, "_chunk").agg(F.sum(F.size("lines")).alias("_n"))
    span = Window.partitionBy(key)
    before = span.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # at most two open keys a chunk, besides those of over ``held`` lines: safe to broadcast
    counts = counts.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.sum("_n").over(span).alias("_total"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    again = (opened.join(F.broadcast(counts), (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_c")))
             .select(key, head, "_total", "_before", F.inline("lines"))
             .withColumn("line_no", F.col("line_no") + F.col("_before")))
    again = again.groupBy(key, F.floor((F.col("line_no") - 1) / page_size).cast("long").alias("page")).agg(
        F.first(head).alias(head), F.first("_total").alias("total"),
        F.array_sort(F.collect_list(F.struct("line_no", *lines))).alias("lines"))
    columns = [key, "page", head, "total", "lines"]
    return pieces.where(F.col("total").isNotNull()).select(*columns).unionByName(again.select(*columns))
