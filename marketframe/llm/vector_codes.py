"""Vector code compression: every part of a vector becomes the index of its
nearest codebook entry.

Vectors are cut into ``parts`` equal consecutive parts.  A part position's
codebook starts as that part of the first vectors; each round assigns every
part and moves each entry to the floored mean of its parts.

Distances go through a trie: a task sorts the distinct parts of a run of
vectors lexicographically, with counts.  A depth-first walk adds one dimension a
level to the distances from the prefix to all entries, so parts with a common
prefix share them; a leaf takes the least (ties: lower index) and adds its part
to the entry's sum, weighted by its count.  Subtrees of at most ``LEAVES`` parts
are walked a level at a time, so memory stays bounded whatever a run holds.

Assignment is narrow: vectors are never shuffled, a vector that fills a third of
all rows is a few counted leaves, and only sums of (position, entry) combine
before they meet.  The codebooks, parts x entries x part length numbers, are all
the driver sees.

Defined results: see ``vectors``; vectors whose length is no multiple of
``parts`` count as followed by zeros; rows that repeat an id are vectors of
their own; null ids come last when the first entries are chosen; with fewer
vectors than entries the codebooks are shorter; no vectors give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import materialise
from marketframe.llm.vectors import dimension, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of one trie at most; leaves of a subtree walked a level at a time.
RUN, LEAVES = 32768, 8192


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, their counts, leaf of each row)."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ranked = parts[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    leaf = np.empty(len(parts), np.int64)
    leaf[order] = np.cumsum(new) - 1
    return ranked[new], np.bincount(leaf), leaf


def nearest_entries(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each of the
    lexicographically sorted distinct parts, depth first."""
    code = np.empty(len(leaves), np.int64)
    least = np.empty(len(leaves), np.int64)
    depth = leaves.shape[1]

    def subtree(lo: int, hi: int, level: int, gathered: np.ndarray):
        if hi - lo > LEAVES and level < depth:
            values, first = np.unique(leaves[lo:hi, level], return_index=True)
            for value, a, b in zip(values, first, np.append(first[1:], hi - lo)):
                subtree(lo + int(a), lo + int(b), level + 1, gathered + (value - book[:, level]) ** 2)
            return
        mine = leaves[lo:hi]
        distances, node = gathered[None, :], np.zeros(hi - lo, np.int64)
        new = np.zeros(hi - lo, bool)
        new[:1] = True
        for d in range(level, depth):
            new[1:] |= mine[1:, d] != mine[:-1, d]
            first = np.flatnonzero(new)
            distances = distances[node[first]] + (mine[first, d, None] - book[None, :, d]) ** 2
            node = np.cumsum(new) - 1
        best = distances.argmin(axis=1)
        code[lo:hi] = best[node]
        least[lo:hi] = distances[np.arange(len(best)), best][node]
    if len(leaves):
        subtree(0, len(leaves), 0, np.zeros(len(book), np.int64))
    return code, least


def _runs(batches, dim: int):
    """(batches, matrix of their vectors) of at most about RUN vectors."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            yield held, np.concatenate([matrix(b.column("whole"), dim) for b in held])
            held, size = [], 0
    if size:
        yield held, np.concatenate([matrix(b.column("whole"), dim) for b in held])


def codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, part length) whole numbers after ``rounds`` rounds."""
    dim = -(-dimension(whole) // parts) * parts
    length = dim // parts
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "whole", "row").limit(entries).select("whole").collect()
    books = np.zeros((parts, len(first), length), np.int64)
    for e, (vector,) in enumerate(first):
        padded = np.zeros(dim, np.int64)
        padded[:len(vector)] = vector
        books[:, e] = padded.reshape(parts, length)

    def sums(now):
        def run(batches):
            for _, vectors in _runs(batches, dim):
                for p in range(parts):
                    leaves, count, _ = distinct_parts(vectors[:, p * length:(p + 1) * length])
                    code, _ = nearest_entries(leaves, now[p])
                    total = np.zeros((len(now[p]), length + 1), np.int64)
                    np.add.at(total, code, np.concatenate((count[:, None], leaves * count[:, None]), axis=1))
                    used = np.flatnonzero(total[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used) * (length + 1), p)),
                         pa.array(np.repeat(used, length + 1)),
                         pa.array(np.tile(np.arange(length + 1), len(used))),
                         pa.array(total[used].ravel())], names=["part", "entry", "place", "total"])
        return run
    for _ in range(rounds if len(first) else 0):
        met = (whole.select("whole").mapInArrow(sums(books), "part long, entry long, place long, total long")
               .groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
        # at most parts x entries x (length + 1) numbers
        total = {(r.part, r.entry, r.place): int(r.total) for r in met.collect()}
        books = books.copy()
        for (p, e, place), count in total.items():
            if place == 0:
                books[p, e] = [total[p, e, d + 1] // count for d in range(length)]
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """``whole`` with ``code`` (two hex digits a part) and ``error``."""
    parts, _, length = books.shape
    names = [c for c in whole.columns if c != "whole"]
    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in names) + ", code string, error long"

    def run(batches):
        for held, vectors in _runs(batches, parts * length):
            codes = np.empty((len(vectors), parts), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            for p in range(parts):
                leaves, _, leaf = distinct_parts(vectors[:, p * length:(p + 1) * length])
                code, least = nearest_entries(leaves, books[p])
                codes[:, p] = code[leaf]
                error += least[leaf]
            table = pa.Table.from_batches(held).select(names)
            text = [row.tobytes().hex() for row in codes]
            columns = [table.column(c).combine_chunks() for c in names] + [pa.array(text, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "code", "error"])
    return whole.select("whole", *names).mapInArrow(run, schema)


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    whole = whole_vectors(rows, id_col, vec_col, label_col)
    books = codebooks(whole, parts, entries, rounds)
    return encode(whole, books).select("vec_id", "label", "code", "error"), books


def digest(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes with the error summed over equal labels and the codebooks' hash."""
    coded = materialise(coded)
    by_label = materialise(coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    by_label = by_label.select(F.col("label").alias("_label"), "label_error")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
