"""Exact top-k search by inner product on a bit-sliced index.

1. *Index.*  Rows are laid in blocks of about ``BLOCK``.  In a block each component
   less its least value, without its lowest bits, is an attribute of ``BITS``
   bits; slice ``j`` of an attribute is a bitmap of the rows whose bit ``j`` is
   set.  The whole numbers stay beside the slices.
2. *Adding.*  For a query, the slices weighted by its components are added with
   bitmap arithmetic: three bitmaps of one weight become a sum and a carry (a
   negative component takes the complement).  The result is the slices of a
   quantised score of all rows of the block.
3. *Selecting.*  From the most significant slice downward the rows that can be
   among the first ``k`` are counted, which gives the k-th largest quantised
   score.  All rows within the error that quantising can make below it are the
   boundary rows; only theirs are resolved with exact whole numbers, so results
   are exact whatever the bits.
4. *Merging.*  Each block gives ``k`` rows for a query; a ranking window takes
   the first of all blocks.

Queries are packed in groups of ``GROUP``; a group meets every block once, as an
equi-join on (group, lane) with blocks dealt over lanes.  No pair of rows is
ever formed outside a block, and nothing passes the driver.

Defined results: see ``vectors``.  A query's own row is left out; other rows that
repeat its id or vector are candidates.  Ties go to the smaller id, null ids
last.  Rows without an id are candidates, not queries.  With fewer rows than
``k``, all come.  No vectors or no queries give no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import materialise
from marketframe.llm.vectors import dimension, matrix, whole_vectors

K = 5
#: Rows of a block, queries of a group, bits of an attribute and of a weight.
BLOCK, GROUP, BITS, WEIGHT_BITS = 16384, 2048, 6, 8
#: Stands for a null id in the packed ids; sorts behind all others.
_NO_ID = (1 << 63) - 1


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (uint64 words) of the last axis."""
    n = bits.shape[-1]
    raw = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*bits.shape[:-1], -(-n // 64) * 8), np.uint8)
    out[..., :raw.shape[-1]] = raw
    return out.view(np.uint64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """A block of vectors and its slices, as packed bytes or from values."""

    def __init__(self, values: np.ndarray, slices: bytes | None = None, shift: int = 0):
        self.values, self.shift, self.top = values, shift, (1 << BITS) - 1
        n, dim = values.shape
        self.all = _packed(np.ones(n, bool))
        if slices is not None:
            self.slices = np.frombuffer(slices, np.uint64).reshape(dim, BITS, len(self.all))
            return
        low = values.min(axis=0)
        spread = int((values.max(axis=0) - low).max()) if dim else 0
        self.shift = max(0, spread.bit_length() - BITS)
        coarse = (values - low) >> self.shift
        self.slices = np.stack([_packed(((coarse >> j) & 1).astype(bool).T) for j in range(BITS)], axis=1)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the quantised score, least significant first; how far
        below another row's quantised score a row with a better true score
        can lie)."""
        size = np.abs(query)
        drop = max(0, int(size.max(initial=0)).bit_length() - WEIGHT_BITS)
        weight = (size + (1 << drop >> 1)) >> drop
        error = int(np.abs(size - (weight << drop)).sum()) * self.top << self.shift
        error += int(size.sum()) * ((1 << self.shift) - 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(WEIGHT_BITS + BITS + 1)]
        for i in range(WEIGHT_BITS + 1):
            for negative in (False, True):
                dims = np.flatnonzero(((weight >> i) & 1 == 1) & ((query < 0) == negative))
                if len(dims):
                    for j in range(BITS):
                        taken = self.slices[dims, j]
                        columns[i + j].append(~taken if negative else taken)
        return _added(columns, len(self.all)), error >> (self.shift + drop)

    def best(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of all rows, ``own`` left out, that score at
        least as much as the k-th best."""
        among = self.all.copy()
        if own >= 0:
            among[own >> 6] &= ~np.uint64(1 << (own & 63))
        n = len(self.values) - (own >= 0)
        if n > k:
            score, slack = self.score_slices(query)
            among &= at_least(score, kth_largest(score, among, k) - slack)
        rows = _rows(among)
        exact = self.values[rows] @ query
        if len(rows) > k:
            keep = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            rows, exact = rows[keep], exact[keep]
        return rows, exact


def _added(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight, as slices: full adders take three bitmaps of
    a weight to one of it and one of the next."""
    out, carried = [], []
    for parts in itertools.chain(columns, itertools.repeat([])):
        parts = parts + carried
        if not parts and len(out) >= len(columns):
            return out
        bits = np.concatenate(parts) if parts else np.zeros((1, words), np.uint64)
        carried = []
        while len(bits) > 2:
            m = len(bits) // 3
            x, y, z = bits[:m], bits[m:2 * m], bits[2 * m:3 * m]
            half = x ^ y
            carried.append((x & y) | (half & z))
            bits = np.concatenate((half ^ z, bits[3 * m:]))
        if len(bits) == 2:
            carried.append(bits[:1] & bits[1:])
            bits = bits[:1] ^ bits[1:]
        out.append(bits[0])
    return out


def kth_largest(score: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """k-th largest value of the rows ``among``, from the top slice down."""
    above, equal, value = 0, among, 0
    for j in range(len(score) - 1, -1, -1):
        ones = equal & score[j]
        count = int(np.bitwise_count(ones).sum())
        if above + count >= k:
            equal, value = ones, value | (1 << j)
        else:
            above, equal = above + count, equal & ~score[j]
    return value


def at_least(score: list[np.ndarray], bound: int) -> np.ndarray:
    """Rows whose value is ``bound`` or more."""
    equal = np.full(len(score[0]), np.iinfo(np.uint64).max, np.uint64)
    if bound <= 0:
        return equal
    more = np.zeros_like(equal)
    for j in range(len(score) - 1, -1, -1):
        if bound >> j & 1:
            equal = equal & score[j]
        else:
            more |= equal & score[j]
            equal = equal & ~score[j]
    return more | equal


def _pack(rows: DataFrame, dim: int, size: int, sliced: bool = False) -> tuple[DataFrame, int]:
    """Rows dealt evenly to packs of about ``size``, one a partition and
    numbered like it: ids, rows and values as bytes, with their slices if
    asked for; and the count of the numbers."""
    def run(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        ids = table.column("vec_id").fill_null(_NO_ID).to_numpy()
        values = matrix(table.column("whole").combine_chunks(), dim)
        index = Block(values) if sliced else None
        yield pa.RecordBatch.from_pydict({
            "number": pa.array([TaskContext.get().partitionId()], pa.int64()),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
            "rows": pa.array([table.column("row").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([values.astype(np.int32).tobytes()], pa.binary()),
            "slices": pa.array([index.slices.tobytes() if index else None], pa.binary()),
            "shift": pa.array([index.shift if index else 0], pa.int64())})
    rows = rows.select("row", "vec_id", "whole")
    packs = max(1, -(-rows.count() // size))
    return materialise(rows.repartition(packs).mapInArrow(
        run, "number long, ids binary, rows binary, vectors binary, slices binary, shift long")), packs


def nearest(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best rows of every
    query; ``is_query`` is a condition on ``vec_id``."""
    whole = whole_vectors(rows, id_col, vec_col)
    dim = dimension(whole)
    blocks, n_blocks = _pack(whole, dim, BLOCK, sliced=True)
    queries, n_groups = _pack(whole.where(is_query), dim, GROUP)
    lanes = max(1, min(n_blocks, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // n_groups)))

    def numbers(n):
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = blocks.select((F.col("number") % lanes).alias("lane"),
                         *[F.col(c).alias(f"block_{c}") for c in ("ids", "rows", "vectors", "slices", "shift")],
                         F.explode(numbers(n_groups)).alias("number"))
    right = queries.select("number", F.explode(numbers(lanes)).alias("lane"),
                           "ids", "rows", "vectors")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, own, asked, names = (np.frombuffer(row[c], np.int64) for c in (
                    "block_ids", "block_rows", "ids", "rows"))
                values, wanted = (np.frombuffer(row[c], np.int32).astype(np.int64).reshape(-1, dim) if dim else
                                  np.zeros((len(n), 0), np.int64) for c, n in (("block_vectors", ids), ("vectors", asked)))
                block = Block(values, row["block_slices"], row["block_shift"])
                order = np.argsort(own)
                at = np.minimum(np.searchsorted(own, names, sorter=order), len(own) - 1)
                here = np.where(own[order[at]] == names, order[at], -1)
                found = []
                for q in range(len(asked)):
                    hit, score = block.best(wanted[q], k, int(here[q]))
                    by = np.lexsort((own[hit], ids[hit], -score))[:k]
                    found.append((np.full(len(by), asked[q]), np.full(len(by), names[q]),
                                  ids[hit[by]], own[hit[by]], score[by]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 names=["query_id", "query_row", "vec_id", "row", "score"])
    met = left.join(right, ["number", "lane"]).drop("number", "lane").mapInArrow(
        run, "query_id long, query_row long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return (met.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"),
                    F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score"))
