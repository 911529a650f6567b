"""Helpers shared by the operators of this package: slicing of text batches,
vectorised word and shingle hashes, a cached chunk tokenizer, lineage cuts
in the shared checkpoint folder and connected components."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketframe.session import checkpoint_dir

#: Bytes of text handled by one numpy pass (a longer single text is one pass).
SLICE_BYTES = 1 << 20
#: Name under which a worker process keeps its power tables.
_TABLES = "marketframe_power_tables"


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    a lineage cut that survives the loss of executors.  The declared schema
    is kept, so an empty table reads back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def runtime_filter(spark: SparkSession):
    """Within the block, Spark may build a Bloom filter of the small side of a
    shuffled join and apply it to the scan of the other side before the
    shuffle, whatever that side's size.  Spark itself drops the filter where
    the small side is over its own size limit; results never depend on it."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """Within the block, Spark removes the shuffle files of a query when it
    ends, not when the driver happens to collect its garbage: a table that is
    written is read from its files afterwards, never from the shuffle."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def selected(df: DataFrame, key: str) -> DataFrame:
    """Non-null rows of ``df``, stated as a range of the long ``key``: the
    planner builds runtime filters from sides that have such a predicate."""
    return df.where(F.col(key) >= F.lit(-(1 << 63)).cast("long"))


def slices(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in slices of about ``limit``
    bytes; null texts count as empty."""
    first, held, size, i = 0, [], 0, -1
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, ``n`` at least.  One pair
    lives in the worker process, whatever task asks: functions arrive with
    modules of their own, which would each hold another."""
    held = sys.modules.setdefault(_TABLES, types.ModuleType(_TABLES)).__dict__
    if "tables" not in held or len(held["tables"][0]) < n:
        size, base = 1 << max(16, int(n).bit_length()), 0x9E3779B97F4A7C15
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held["tables"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return held["tables"]


_BYTE_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(
    1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, found on the bytes.

    ``doc``: index of each word's text within the slice; ``start``/``end``:
    byte range in ``buf``; ``begin``: first byte of each text in ``buf``."""

    def __init__(self, raws: list[bytes], lower: bool):
        joined = b" ".join(raws)
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        lens = np.fromiter(map(len, raws), np.int64, len(raws))
        self.begin = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
        self.lens = lens
        self.buf = buf
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.n_docs = len(raws)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE_TABLE[self.buf] * up[:len(self.buf)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


def windows(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words that stays inside one text:
    (hashes, index of the window's first word)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[k - 1:])
    h = np.zeros(len(first), np.uint64)
    factor = 1
    for j in range(k):
        h += words[first + j] * np.uint64(factor)
        factor = factor * 0x9FB21C651E98DF25 % (1 << 64)
    return mix(h), first


def shingle_sets(raws: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice.  A text with
    fewer than ``k`` words has one shingle, its whole word sequence; a text
    without words has none."""
    w = Words(raws, lower=True)
    words = w.hashes()
    h, first = windows(words, w.doc, k)
    doc = w.doc[first] if len(first) else np.zeros(0, np.int64)
    count = np.bincount(w.doc, minlength=w.n_docs) if len(w.doc) else np.zeros(w.n_docs, int)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        extra = []
        for d in short:
            mine, factor, total = words[at[d]:at[d + 1]], 1, 0
            for x in mine.tolist():
                total = (total + x * factor) % (1 << 64)
                factor = factor * 0x9FB21C651E98DF25 % (1 << 64)
            extra.append((total + len(mine)) % (1 << 64))
        h = np.concatenate((h, mix(np.array(extra, np.uint64))))
        doc = np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return [h[cut[i]:cut[i + 1]] for i in range(w.n_docs)]


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the undirected ``edges`` (a, b):
    component is the smallest id reachable.

    Alternating large-star / small-star steps: every round is two grouped
    minima (combined before the shuffle), so no neighbourhood is ever
    gathered in one place; the number of rounds grows with the logarithm of
    the component size.  Each round is written to the checkpoint folder."""
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())
    before = None
    while True:
        # large star: neighbours above u link to the smallest neighbour of u
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        pairs = materialise(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = state


def map_texts(df: DataFrame, make, results: str, text_col: str = "text", drop: bool = False) -> DataFrame:
    """``df`` with result columns computed from its text column, all others
    untouched (also nulls; columns named like a result are replaced).

    ``make()`` runs once in a task and returns a function from a list of
    texts (None for null) to a list of row tuples in the order of the DDL
    ``results``.  ``drop`` leaves the text column out."""
    added = T._parse_datatype_string(results)
    names = set(added.names) | ({text_col} if drop else set())
    keep = [f.name for f in df.schema.fields if f.name not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + added.fields)
    if text_col in added.names:
        raise ValueError(f"the text column {text_col} is named like a result")
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            rows = work(batch.column(text_col).to_pylist())
            columns = [batch.column(n) for n in keep]
            for i, f in enumerate(added.fields):
                columns.append(pa.array([r[i] for r in rows], arrow.field(f.name).type))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return df.select(*keep, *([text_col] if text_col not in keep else [])).mapInArrow(run, schema)
