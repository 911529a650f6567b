"""Token-id files coded by a static range asymmetric numeral system (rANS).

Texts are range-partitioned by doc_id and sorted; each task encodes its texts
and cuts the id stream into segments.  A segment has one frequency table
(sums to 2^PRECISION) shared by its blocks.  Each block is coded on its own
with ``LANES`` interleaved states, so a block decodes without its neighbours
and all its lanes step together; a checkpoint (states and place in the words)
halfway lets two readers share a block, and a CRC-32 guards every block.

A file is a Parquet folder that Spark writes and reads, one row per segment:
``part`` and ``segment`` give the order, ``data`` holds the bytes below, all
little endian.

    magic "RSG1", u32 n_ids, n_docs, n_symbols, n_blocks
    n_docs x i64 doc_id, n_docs x u32 ids of the doc in this segment
    n_symbols x u32 symbol, n_symbols x u32 frequency - 1
    n_blocks x u32 (ids, words, crc32, words before the checkpoint, step of it)
    n_blocks x LANES x u64 first states, n_blocks x LANES x u64 checkpoint states
    the blocks' 32-bit words, joined

A segment ends before the text that would take it over ``SEGMENT`` ids, so no
text is split; a longer text has a segment of its own.

Defined results: null text is empty and has the end id alone; rows with one
doc_id are ordered by text and told apart by their place; rows without a
doc_id come first; an empty table writes no segment.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.tokens import cached_tokenizer
from marketframe.session import checkpoint_dir

END_ID = 2
PRECISION = 20
LANES = 256
#: Ids of a block and of a segment.
BLOCK, SEGMENT = 1 << 16, 1 << 20
#: Ids below this are counted and placed by tables as long as the largest of them.
_TABLE_IDS = 1 << 22
_LOW = np.uint64(1 << 31)
_NO_ID = -(1 << 63)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies >= 1 that sum to 2^PRECISION) of the ids."""
    if len(ids) and ids.max() < _TABLE_IDS:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << PRECISION
    if len(symbols) > total:
        raise ValueError("more symbols than the table can hold")
    freq = 1 + counts * (total - len(symbols)) // counts.sum()
    freq[counts.argmax()] += total - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint64)


def _code_blocks(index: np.ndarray, freq: np.ndarray, start: np.ndarray, n: int):
    """Codes blocks of ``n`` ids (rows of ``index``, table places) together:
    (first states, checkpoint states, checkpoint words, step, words per block)."""
    blocks = len(index)
    steps = -(-n // LANES)
    half = steps // 2
    state = np.full((blocks, LANES), _LOW, np.uint64)
    emitted, owner = [], []
    check, after = state, np.zeros(blocks, np.int64)
    for t in range(steps - 1, -1, -1):
        width = min(LANES, n - t * LANES)
        s = np.ascontiguousarray(index[:, t * LANES:t * LANES + width])
        f, x = freq.take(s), state[:, :width]
        full = x >> np.uint64(63 - PRECISION) >= f
        emitted.append(x[full].astype("<u4"))  # the low half
        owner.append(np.nonzero(full)[0])
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:, :width] = (q << np.uint64(PRECISION)) + (x - q * f) + start.take(s)
        if t == half:
            check = state.copy()
            after = np.bincount(np.concatenate(owner), minlength=blocks)
    words, of = np.concatenate(emitted[::-1]), np.concatenate(owner[::-1])
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(blocks + 1))
    words = [words[order[cut[i]:cut[i + 1]]] for i in range(blocks)]
    before = [len(w) - int(a) for w, a in zip(words, after)]
    return state, check, before, half, words


def encode_segment(docs: list[tuple[int, int]], ids: np.ndarray) -> bytes:
    """``docs``: (doc_id, ids of it here); ``ids``: all of them, joined."""
    symbols, freq = frequencies(ids)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    if symbols[-1] < _TABLE_IDS:
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        index = place[ids]
    else:
        index = np.searchsorted(symbols, ids)
    entries, firsts, checks, payload = [], [], [], []
    whole = len(ids) // BLOCK
    groups = [(index[:whole * BLOCK].reshape(whole, BLOCK), BLOCK)] if whole else []
    if len(ids) % BLOCK:
        groups.append((index[whole * BLOCK:][None], len(ids) - whole * BLOCK))
    for rows, n in groups:
        state, check, before, half, words = _code_blocks(rows, freq, start, n)
        for b in range(len(rows)):
            raw = words[b].tobytes()
            entries.append((n, len(words[b]), zlib.crc32(raw), before[b], half))
            firsts.append(state[b].astype("<u8").tobytes())
            checks.append(check[b].astype("<u8").tobytes())
            payload.append(raw)
    head = struct.pack("<4s4I", b"RSG1", len(ids), len(docs), len(symbols), len(entries))
    return b"".join([
        head, np.array([d for d, _ in docs], "<i8").tobytes(), np.array([n for _, n in docs], "<u4").tobytes(),
        symbols.astype("<u4").tobytes(), (freq - np.uint64(1)).astype("<u4").tobytes(),
        np.array(entries, "<u4").tobytes(), *firsts, *checks, *payload])


class Segment:
    """A segment's header; blocks decode on demand."""

    def __init__(self, data: bytes):
        magic, self.n_ids, n_docs, n_symbols, n_blocks = struct.unpack_from("<4s4I", data)
        if magic != b"RSG1":
            raise ValueError("not a token segment")
        at = struct.calcsize("<4s4I")

        def take(kind, *shape):
            nonlocal at
            out = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
            at += out.nbytes
            return out
        self.doc_ids, self.doc_lens = take("<i8", n_docs), take("<u4", n_docs)
        self.symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64) + np.uint64(1)
        self.entries = take("<u4", n_blocks, 5)
        self.firsts, self.checks = take("<u8", n_blocks, LANES), take("<u8", n_blocks, LANES)
        self.words = take("<u4", int(self.entries[:, 1].sum()))
        self.bounds = np.concatenate(([0], np.cumsum(self.entries[:, 1].astype(np.int64))))
        self.freq = freq.astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(n_symbols, dtype=np.uint32), self.freq)

    def _run(self, blocks: np.ndarray, n: int, state: np.ndarray, place: np.ndarray, first: int) -> np.ndarray:
        steps = -(-n // LANES)
        out = np.empty((len(blocks), n - first * LANES), np.uint32)
        # states are below 2^63
        state, place = state.astype(np.int64), place.copy()
        for t in range(first, steps):
            width = min(LANES, n - t * LANES)
            x = state[:, :width]
            low = x & ((1 << PRECISION) - 1)
            s = self.slot.take(low)
            out[:, (t - first) * LANES:(t - first) * LANES + width] = s
            x = self.freq.take(s) * (x >> PRECISION) + low - self.start.take(s)
            empty = x < int(_LOW)
            count = empty.sum(axis=1)
            ends = np.cumsum(count)
            if ends[-1]:
                at = np.arange(ends[-1]) + np.repeat(place - ends + count, count)
                x[empty] = x[empty] << 32 | self.words.take(at)
                place += count
            state[:, :width] = x
        return self.symbols.take(out)

    def verify(self) -> None:
        for b in range(len(self.entries)):
            if zlib.crc32(self.words[self.bounds[b]:self.bounds[b + 1]].tobytes()) != self.entries[b, 2]:
                raise ValueError(f"block {b}: checksum differs")

    def block(self, b: int, from_checkpoint: bool = False) -> np.ndarray:
        """Ids of one block, or of its half after the checkpoint."""
        n, _, _, before, half = (int(v) for v in self.entries[b])
        state, place, first = (self.checks, before, half) if from_checkpoint else (self.firsts, 0, 0)
        return self._run(np.array([b]), n, state[b][None], np.array([self.bounds[b] + place]), first)[0]

    def ids(self) -> np.ndarray:
        """All ids; blocks of one length step together."""
        self.verify()
        lens = self.entries[:, 0].astype(int)
        out = []
        for n in dict.fromkeys(lens.tolist()):
            blocks = np.flatnonzero(lens == n)
            out.append(self._run(blocks, n, self.firsts[blocks], self.bounds[blocks], 0).ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _writer(path: str):
    def run(batches):
        tokenizer = cached_tokenizer(path)
        part, segment = TaskContext.get().partitionId(), 0
        docs: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = encode_segment(docs, np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([data], pa.binary())], names=["part", "segment", "n_ids", "data"])
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), tokenizer.encode_column(batch.column(1))):
                ids = np.append(found, END_ID).astype(np.uint32)
                if size and size + len(ids) > SEGMENT:
                    yield close()
                    docs, held, size, segment = [], [], 0, segment + 1
                docs.append((_NO_ID if doc is None else doc, len(ids)))
                held.append(ids)
                size += len(ids)
        if size:
            yield close()
    return run


FILE_SCHEMA = "part long, segment long, n_ids long, data binary"


def write_ids(documents: DataFrame, tokenizer: str, path: str, partitions: int | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Ids of all texts in ascending order of ``id_col``, as files in ``path``."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_writer(tokenizer), FILE_SCHEMA).write.parquet(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every text, decoded from the files of
    ``path``; start counts the ids of all texts before it."""
    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Segment(data.as_py())
                lens = s.doc_lens.astype(np.int64)
                ids, ends = s.ids().astype("<u4"), np.cumsum(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == _NO_ID else d for d in s.doc_ids.tolist()], pa.int64()),
                     pa.array(base + ends - lens, pa.int64()), pa.array(lens, pa.int64()),
                     pa.array([p.tobytes() for p in np.split(ids, ends[:-1])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row for each task, and one for each segment of a task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    base = (files.select("part", "segment", inside.alias("inside")).join(parts, "part")
            .select("part", "segment", (F.col("inside") + F.col("before")).alias("base")))
    return files.join(base, ["part", "segment"]).select("base", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into the shared checkpoint folder and reads them."""
    spark = documents.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(documents, tokenizer, path, None, id_col, text_col)
    return read_ids(spark, path)
