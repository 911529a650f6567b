"""Repeated byte strings found by suffix sorting in two stages.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else in the corpus is marked.

1. *Anchors.*  Of every window of ``LENGTH`` bytes the k-gram of least hash is
   an anchor (its place depends on the window alone), so equal strings have
   equal anchors at equal places.  Only anchors whose hash occurs in different
   texts, or twice in one, go on; the grouped counts combine before the shuffle.
2. *Contexts.*  Around such an anchor lie all strings that contain it.  Equal
   contexts are one row with a count (a context that occurs twice is covered
   whole); copies of a text are one text throughout.
3. *Suffix sorting.*  Different contexts of the same anchor are laid end to end
   in blocks of bounded size.  Suffixes smaller than their successors are
   sorted directly; all others are induced by scanning the buckets of first
   bytes in order.  Adjacent suffixes with a common prefix of ``LENGTH`` bytes
   mark their strings, unless both are the same place of the corpus.
4. Contexts are dealt once, by anchor; a task counts equal ones and sorts the
   others.  Only anchors with more than ``GROUP`` contexts are counted over the
   cluster.  With more than ``GROUP`` different ones they are not gathered:
   each of their strings is counted by a 128-bit hash instead, which is exact
   up to hash collisions and combines before the shuffle.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes have
no such string; rows that repeat a text, an id or both, also null ids, are texts
of their own, so each copy's bytes are marked; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import _BYTE_TABLE, _power_tables, materialise, mix, runtime_filter, selected, short_shuffles, slices

LENGTH, GRAM = 200, 64
_SIDE = LENGTH - GRAM
#: Contexts of one anchor that are sorted in one task; bytes of a sorted block.
GROUP, BLOCK_BYTES = 5000, 1 << 18
_INDEX_BITS = 24
#: Stands for a null doc_id in joins.
_NO_ID = -(1 << 63)


def _rolling(buf: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` bytes of ``buf``."""
    n = len(buf) - length + 1
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_TABLE[buf] * up[:len(buf)], out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours: running minima from both ends of
    blocks of ``w``."""
    n = len(a)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = a
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of a slice of texts."""
    buf = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    empty = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return empty, empty, np.zeros(0, np.uint64)
    h = _rolling(buf, GRAM)
    begin = ends - np.array([len(r) for r in raws])
    shift = np.uint64(_INDEX_BITS)
    if len(buf) >> _INDEX_BITS:  # one very long text: hash order, ties by place in turn
        shift = np.uint64(int(len(buf)).bit_length())
    index = np.arange(len(h), dtype=np.uint64)
    low = _sliding_min((h >> shift << shift) | index, LENGTH - GRAM + 1)
    # windows that stay inside one text
    inside = np.zeros(len(low) + LENGTH, bool)
    for b, e in zip(begin.tolist(), ends.tolist()):
        if e - b >= LENGTH:
            inside[b:e - LENGTH + 1] = True
    low = low[inside[:len(low)]]
    place = np.unique(low & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(ends, place, "right")
    return text, place - begin[text], h[place]


def two_stage_order(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix order of ``text`` (0 ends a string and sorts first), right for
    the first ``LENGTH`` bytes at least; of the ``wanted`` suffixes (and the
    few that they are induced from) if a mask is given.

    Type B suffixes are smaller than their successors and sorted directly;
    type A suffixes are induced: their successors stand earlier, so a scan of
    the buckets in order meets each of them in its order."""
    n = len(text)
    nxt = np.concatenate((text[1:], [0]))
    differs = np.flatnonzero(text != nxt)
    at = np.searchsorted(differs, np.arange(n))
    at = np.minimum(at, len(differs) - 1)
    type_a = text[differs[at]] > nxt[differs[at]]
    type_a &= text > 0
    if wanted is None:
        need = np.ones(n, bool)
    else:  # a wanted run, and what follows it up to the next type B suffix
        following = np.minimum.accumulate(np.where(type_a, n - 1, np.arange(n))[::-1])[::-1]
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        edge = np.zeros(n + 1, int)
        np.add.at(edge, last + 1, 1)
        np.add.at(edge, np.maximum(following[last], last) + 1, -1)
        need = wanted | (np.cumsum(edge[:n]) > 0)
    type_a &= need
    direct = np.flatnonzero(~type_a & need & (text > 0))
    padded = np.concatenate((text, np.zeros(LENGTH, np.uint8)))
    strings = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[direct]
    keys = np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    firsts = text[direct]
    cut = np.searchsorted(firsts, np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero((text == 0) & need)
        else:
            induced = pending[c]
            frontier = np.concatenate(induced) if induced else np.zeros(0, np.int64)
            parts = []
            while len(frontier):
                parts.append(frontier)
                before = frontier[frontier > 0] - 1
                frontier = before[type_a[before] & (text[before] == c)]
            bucket = np.concatenate([*parts, direct[cut[c]:cut[c + 1]]]) if parts or cut[c] < cut[c + 1] else None
        if bucket is None or not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[type_a[before] & (text[before] > c)]
        if len(before):
            symbols = text[before]
            by = np.argsort(symbols, kind="stable")
            values, starts = np.unique(symbols[by], return_index=True)
            for v, part in zip(values.tolist(), np.split(before[by], starts[1:])):
                pending[v].append(part)
    return np.concatenate(order)


def repeated_starts(contexts: list[bytes], many: np.ndarray, place: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each context the starts of its strings of ``LENGTH`` bytes that
    start elsewhere too.  ``many``: the context occurs at several places;
    ``owner``, ``place``: text and first byte of a context that does not."""
    lens = np.array([len(c) for c in contexts])
    # bytes plus one (UTF-8 has no 0xFF), a zero after each context
    joined = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    room = np.repeat(begin + lens, lens + 1) - np.arange(len(joined))
    order = two_stage_order(joined, room >= LENGTH)
    of = np.searchsorted(begin, order, "right") - 1
    inner = order - begin[of]
    valid = inner + LENGTH <= lens[of]
    order, of, inner = order[valid], of[valid], inner[valid]
    out = [np.zeros(0, np.int64)] * len(contexts)
    if len(order) < 2:
        return out
    code = _rolling(joined, LENGTH)[order]
    near = np.flatnonzero(code[1:] == code[:-1])
    view = np.lib.stride_tricks.sliding_window_view(joined, LENGTH)
    # common prefix of neighbours, verified on the bytes
    same = np.zeros(len(order), bool)
    for lo in range(0, len(near), 4096):
        part = near[lo:lo + 4096]
        same[part + 1] = (view[order[part]] == view[order[part + 1]]).all(axis=1)
    run = np.cumsum(~same)
    # a run repeats when it holds two places of the corpus
    where = np.stack([owner[of], place[of] + inner], axis=1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
    head = np.repeat(first, np.diff(np.append(first, len(run))))
    twice = (where != where[head]).any(axis=1) | many[of]
    repeats = np.logical_or.reduceat(twice, first)[run - run[0]]
    of, inner = of[repeats], inner[repeats]
    by = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[by], np.arange(len(contexts) + 1))
    return [np.sort(inner[by[cut[i]:cut[i + 1]]]) for i in range(len(contexts))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings at ``starts`` (sorted)."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(starts, new)]


def _facts(batches):
    """doc_id, ta, tb, n_bytes, and the digest of the whole text."""
    for batch in batches:
        for first, raws in slices(batch.column(3).to_pylist()):
            n = len(raws)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, n) for c in range(3)), pa.array([len(r) for r in raws], pa.int64()),
                 pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())],
                names=["doc_id", "ta", "tb", "n_bytes", "sha256"])


def _emit(batches):
    for batch in batches:
        for first, raws in slices(batch.column(2).to_pylist()):
            ta, tb = (batch.column(c).to_numpy()[first:first + len(raws)] for c in (0, 1))
            text, place, h = anchors(raws)
            order = np.lexsort((h, text))
            same = np.zeros(len(h), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[same]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ta[text]), pa.array(tb[text]), pa.array(place), pa.array(twice)],
                names=["anchor", "ta", "tb", "place", "twice"])


def _contexts(batches):
    """One row per shared anchor; equal contexts of a task are sent once
    (``context`` is null for the others)."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for ta, tb, text, places, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            for p, h in zip(places, hashes):
                lo = max(0, p - _SIDE)
                context = raw[lo:p + LENGTH]
                digest = hashlib.blake2b(context + bytes([p - lo]), digest_size=16).digest()
                rows.append((h, digest, ta, tb, lo, len(context), None if digest in seen else context))
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(digest)
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["anchor", "digest", "ta", "tb", "start", "length", "context"])


def _sort_groups(batches):
    """Spans to remove from rows (anchor, digest, n, ta, tb, start, length,
    context) sorted by anchor and digest.  A context with several rows, or
    standing for ``n`` > 1, is covered whole; different contexts of an anchor,
    one of them without a copy, are sorted: whole anchors fill a block."""
    held: list[list] = []
    group: list[list] = []  # [many, owner, start, context] of each digest of an anchor
    whole: list[tuple] = []
    size, last = 0, (None, None)

    def done():
        found = list(whole)
        if held:
            many, owner, start, contexts = zip(*held)
            texts: dict[tuple[int, int], int] = {}
            places = np.array([texts.setdefault(o, len(texts)) for o in owner], np.int64)
            starts = repeated_starts(list(contexts), np.array(many), np.array(start, np.int64), places)
            for m, o, lo, at in zip(many, owner, start, starts):
                if not m:
                    found += [(*o, lo + x, lo + y) for x, y in _runs(at)]
        cols = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ta", "tb", "start", "end"])

    def close():
        """Bytes of the anchor's contexts, if they are to be sorted."""
        if len(group) < 2 or all(g[0] for g in group):
            return 0
        held.extend(group)
        return sum(len(g[3]) for g in group)
    for batch in batches:
        for anchor, digest, n, ta, tb, start, length, context in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != last[0]:
                size += close()
                group = []
                if size >= BLOCK_BYTES or len(whole) >= 100_000:
                    yield done()
                    held, whole, size = [], [], 0
            if (anchor, digest) != last:
                group.append([n > 1, (ta, tb), start, context])
                first, last = (ta, tb, start, start + length), (anchor, digest)
                if n > 1 and length >= LENGTH:
                    whole.append(first)
                continue
            same = group[-1]
            if length >= LENGTH:
                whole += [(ta, tb, start, start + length)] if same[0] else [first, (ta, tb, start, start + length)]
            same[0] = True
            same[3] = context if same[3] is None else same[3]
    close()
    yield done()


def _strings(batches):
    """Both hashes of every string of a context, with its place."""
    for batch in batches:
        for ta, tb, start, context in zip(*(c.to_pylist() for c in batch.columns)):
            buf = np.frombuffer(context, np.uint8)
            if len(buf) < LENGTH:
                continue
            a = _rolling(buf, LENGTH)
            b = _rolling(buf[::-1], LENGTH)[::-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64)),
                 pa.array(np.full(len(a), ta)), pa.array(np.full(len(a), tb)), pa.array(start + np.arange(len(a)))],
                names=["a", "b", "ta", "tb", "start"])


#: The 128-bit name of a text, as two columns.
_TEXT = ["ta", "tb"]


def _named(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a stand-in for null), ta, tb, text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID).cast("long")).alias("doc_id"),
                            F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(7), text).alias("tb"), text.alias("text"))


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, ta, tb, ...) with their texts: both the id and the text
    must be the ones meant, whatever ids repeat or are null."""
    meant = selected(rows.withColumnsRenamed({"doc_id": "_id", "ta": "_ta", "tb": "_tb"}), "_id")
    same = (F.col("doc_id") == F.col("_id")) & (F.col("ta") == F.col("_ta")) & (F.col("tb") == F.col("_tb"))
    return docs.join(meant, same).drop("_id", "_ta", "_tb")


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(facts, spans): ``facts`` has doc_id, ta, tb, n_bytes, sha256 and
    ``copies`` for each row; ``spans`` has (ta, tb, start, end) of bytes to
    remove, overlapping; a text with copies goes whole and is not listed."""
    spark = documents.sparkSession
    docs = _named(documents, id_col, text_col)
    facts = materialise(docs.mapInArrow(_facts, "doc_id long, ta long, tb long, n_bytes long, sha256 string"))
    copies = materialise(facts.groupBy(*_TEXT).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")))
    found = docs.select(*_TEXT, "text").mapInArrow(_emit, "anchor long, ta long, tb long, place long, twice boolean")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in _TEXT for f in (F.min, F.max)]
    shared = materialise(found.groupBy("anchor").agg(*ends, F.max("twice").alias("twice"))
                         .where("min_ta <> max_ta or min_tb <> max_tb or twice").select("anchor"))
    places = materialise(found.select("anchor", *_TEXT, "place").join(shared, "anchor", "left_semi")
                         .groupBy(*_TEXT).agg(F.collect_set(F.struct("place", "anchor")).alias("at")))
    with runtime_filter(spark):
        one = materialise(copies.join(places.select(*_TEXT), _TEXT, "left_semi"))
        # the places go to the texts, by the key that the texts were fetched by: texts move once
        placed = places.join(one.select("doc_id", *_TEXT), _TEXT)
        texts = _texts_of(docs, one).join(placed, ["doc_id", *_TEXT]).select(*_TEXT, "text", "at", "copies")
        # several rows may hold the id and the text of a copied one: any of them does
        copied = texts.where("copies > 1").groupBy(*_TEXT).agg(F.first("text").alias("text"), F.first("at").alias("at"))
        texts = texts.where("copies = 1").select(*_TEXT, "text", "at").unionByName(copied)
        texts = texts.select(*_TEXT, "text", "at.place", "at.anchor")
        contexts = materialise(texts.mapInArrow(
            _contexts, "anchor long, digest binary, ta long, tb long, start long, length long, context binary"))
    # only anchors of many contexts are counted over the cluster; the others' rows move once
    busy = materialise(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("anchor"))
    crowd = contexts.join(busy, "anchor", "left_semi")
    ways = crowd.groupBy("anchor", "digest").agg(F.count("*").alias("n"))
    ways = materialise(ways.join(ways.groupBy("anchor").agg(F.count("*").alias("ways"), F.min("n").alias("least")), "anchor"))
    # a row without bytes repeats one of its task; only the others need to be looked up
    sent, long = F.col("context").isNotNull(), F.col("length") >= LENGTH
    whole = (crowd.where(long & sent).join(ways.where("n > 1"), ["anchor", "digest"], "left_semi").select(*_TEXT, "start", "length")
             .unionByName(crowd.where(long & ~sent).select(*_TEXT, "start", "length"))
             .select(*_TEXT, "start", (F.col("start") + F.col("length")).alias("end")))
    todo = crowd.where(sent).join(ways.where("ways > 1 and least = 1"), ["anchor", "digest"])
    row = ["anchor", "digest", "n", *_TEXT, "start", "length", "context"]
    small = (contexts.join(busy, "anchor", "left_anti").withColumn("n", F.lit(1).cast("long")).select(*row)
             .unionByName(todo.where(F.col("ways") <= GROUP).select(*row))
             .repartition("anchor").sortWithinPartitions("anchor", "digest")
             .mapInArrow(_sort_groups, "ta long, tb long, start long, end long"))
    strings = "a long, b long, ta long, tb long, start long"
    large = todo.where(F.col("ways") > GROUP)
    open_ = large.where("n = 1").select(*_TEXT, "start", "context").mapInArrow(_strings, strings)
    large = large.select(*_TEXT, "start", "context").mapInArrow(_strings, strings)
    twice = (large.groupBy("a", "b").agg(F.min(F.struct(*_TEXT, "start")).alias("lo"),
                                         F.max(F.struct(*_TEXT, "start")).alias("hi")).where("lo <> hi"))
    large = open_.join(twice, ["a", "b"], "left_semi").select(
        *_TEXT, "start", (F.col("start") + LENGTH).alias("end"))
    spans = materialise(whole.unionByName(small).unionByName(large).distinct())
    return facts.join(copies.select(*_TEXT, "copies"), _TEXT), spans


def merged(spans: DataFrame) -> DataFrame:
    """ta, tb and the maximal removed runs, sorted."""
    runs = F.array_sort(F.collect_list(F.struct("start", "end")))
    first = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc, s):
        last = F.element_at(acc["out"], -1)
        joins = (F.size(acc["out"]) > 0) & (s["start"] <= acc["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"))
        out = F.when(joins, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(grown))).otherwise(
            F.concat(acc["out"], F.array(s)))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), out.alias("out"))
    return spans.groupBy(*_TEXT).agg(F.aggregate(runs, first, step)["out"].alias("runs"))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, runs (removed bytes, maximal), kept_sha256."""
    with short_shuffles(documents.sparkSession):
        return _removed(documents, id_col, text_col)


def _removed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    facts, spans = repeated_spans(documents, id_col, text_col)
    runs = materialise(merged(spans))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<struct<start:long,end:long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    listed = materialise(facts.join(runs, _TEXT, "left"))
    plain = listed.where(whole | F.col("runs").isNull()).select(
        "doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(none).alias("runs"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha256")).alias("kept_sha256"))
    cut = materialise(listed.where(~whole & F.col("runs").isNotNull()).select("doc_id", *_TEXT, "n_bytes", "runs"))

    def digest(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                raw, h, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                for r in runs:
                    h.update(raw[at:r["start"]])
                    at = r["end"]
                h.update(raw[at:])
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.string())],
                                             names=["doc_id", "n_bytes", "runs", "kept_sha256"])
    with runtime_filter(documents.sparkSession):
        edited = materialise(
            _texts_of(_named(documents, id_col, text_col), cut).select("doc_id", "text", "n_bytes", "runs")
            .mapInArrow(digest, "doc_id long, n_bytes long, runs array<struct<start:long,end:long>>, kept_sha256 string"))
    return plain.unionByName(edited).withColumn(
        "doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
