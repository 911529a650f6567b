"""Packing by cutting-stock column generation.

Texts become token ids plus an end id.  Whole sequences are cut off first;
what is left of a text is one piece.  Piece lengths are classed by ``grain``
(rounded up), and the histogram over classes, the only thing the driver sees
(``capacity / grain`` counts), is the demand of a cutting-stock problem:

* the linear program over patterns (how many pieces of each class share a
  sequence) is solved by column generation; dynamic programming over the
  knapsack prices the next pattern from the dual values; it ends when Farley's
  lower bound is within ``TOLERANCE`` of the program's value;
* the patterns' uses are rounded down and the few pieces left over are placed
  best-fit, longest first, so every piece has a slot;
* pieces are ranked within their class (task, then order within the task), and
  a rank's place in the list of uses names its sequence; offsets are running
  sums within the sequence, so sequences have no gaps.

Ranks need no sort: tasks count their own pieces by class, and each task's
first rank is a running sum over tasks.  A class that holds a third of all
pieces is therefore never gathered.

Defined results: null text is empty and has the end id alone; rows with the
same doc_id are texts of their own; an empty table has no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import materialise
from marketframe.llm.tokens import ByteLevelTokenizer

CAPACITY = 1024
#: Tokens by which piece lengths are rounded up in the plan.
GRAIN = 4
TOLERANCE = 0.0005
END_ID = 0


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for item values: unbounded knapsack over sizes 1..n."""
    n = len(values)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        top = min(n, c)
        gain = best[c - top:c][::-1] + values[:top]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(n, int), capacity
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, uses) of the linear program over all patterns.
    ``demand[i]`` pieces of size i + 1 are wanted."""
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, len(demand)), int), np.zeros(0)
    wanted = demand[sizes - 1].astype(float)
    basis = np.diag(capacity // sizes).astype(float)  # columns: patterns over present sizes
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ wanted
    values = np.zeros(len(demand))
    while True:
        duals = inverse.sum(axis=0)
        values[sizes - 1] = np.maximum(duals, 0)
        worth, pattern = price(values, capacity)
        column = pattern[sizes - 1].astype(float)
        if worth <= 1 + tolerance or duals @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        leave = rows[np.argmin(uses[rows] / step[rows])]
        amount = uses[leave] / step[leave]
        uses = np.maximum(uses - amount * step, 0)
        uses[leave] = amount
        basis[:, leave] = column
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
    patterns = np.zeros((m, len(demand)), int)
    patterns[:, sizes - 1] = np.rint(basis.T).astype(int)
    return patterns, uses


def plan(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for every piece: (size, first rank, end rank, pieces of this size
    in a sequence, first sequence)."""
    patterns, uses = solve(demand, capacity)
    left, sequence, runs = demand.astype(int).copy(), 0, []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for i in np.flatnonzero(pattern):
            taken = int(demand[i] - left[i])
            n = int(min(left[i], pattern[i] * times))
            if n:
                runs.append((int(i) + 1, taken, taken + n, int(pattern[i]), sequence))
                left[i] -= n
        sequence += times
    order = np.argsort(-uses, kind="stable")
    for j in order:
        if times := int(uses[j] + 1e-6):
            use(patterns[j], times)
    for j in order:  # a fractional use, as far as its pieces are still there
        if patterns[j].any() and (patterns[j] <= left).all():
            use(patterns[j], 1)
    while left.any():  # best fit, longest first
        pattern, room = np.zeros(len(demand), int), capacity
        while room:
            fits = np.flatnonzero(left[:room] - pattern[:room] > 0)
            if not len(fits):
                break
            pattern[fits[-1]] += 1
            room -= fits[-1] + 1
        use(pattern, max(1, int(np.min(left[pattern > 0] // pattern[pattern > 0]))))
    return runs


def pieces(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (32-bit little
    endian), its class ``size`` (in grains), and its ``rank`` within the class
    among the pieces of the task ``part``."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "size", "rank"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        tokenizer = ByteLevelTokenizer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(-(-capacity // grain) + 1, np.int64)
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), map(tokenizer.encode, batch.column(1).to_pylist())):
                ids = np.append(found, END_ID).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at:at + capacity]
                    size = -(-len(piece) // grain)
                    out.append((doc, at, len(piece), len(ids), piece.tobytes(), part, size, int(seen[size])))
                    seen[size] += 1
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary, part long, size long, rank long")


def pack(documents: DataFrame, path: str, carry: dict[str, Column] | None = None, id_col: str = "doc_id",
         text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces with sequence_id and offset.  ``carry`` names what is kept of a
    piece's ids (expressions over the column ids); by default the ids."""
    spark = documents.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = materialise(pieces(documents, path, id_col, text_col, capacity, grain).select(
        "doc_id", "start", "length", "doc_tokens", "part", "size", "rank", *[e.alias(n) for n, e in carry.items()]))
    small = cut.select("doc_id", "start", "length", "doc_tokens", "part", "size", "rank")
    counted = cut.groupBy("part", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    units = -(-capacity // grain)
    demand = np.zeros(units, int)
    for r in cut.groupBy("size").count().collect():  # at most capacity / grain rows
        demand[r["size"] - 1] = r["count"]
    runs = spark.createDataFrame(plan(demand, units), "run_size long, lo long, hi long, per long, first long")
    ranked = small.join(firsts, ["part", "size"]).withColumn("place", F.col("rank") + F.col("base"))
    # at most (capacity / grain) ^ 2 runs
    placed = ranked.join(F.broadcast(runs), (F.col("size") == F.col("run_size"))
                         & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    sequence = F.col("first") + F.floor((F.col("place") - F.col("lo")) / F.col("per")).cast("long")
    order = Window.partitionBy("sequence_id").orderBy("size", "place").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.withColumn("sequence_id", sequence).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "part", "size", "rank")
    return (slots.join(cut.select("part", "size", "rank", *carry), ["part", "size", "rank"])
            .select("doc_id", "start", "length", *carry, "doc_tokens", "sequence_id", "offset"))
