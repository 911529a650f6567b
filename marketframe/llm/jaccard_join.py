"""N-gram Jaccard join: exact near-duplicate links by a metric-space join.

Jaccard distance ``d = 1 - |A n B| / |A u B|`` of word-shingle sets is a
metric.  Two documents link when ``d <= radius`` (0.2).

1. *Candidates.*  With ``J >= 0.8`` at most ``a - ceil(0.8 a)`` shingles of a
   set of ``a`` are missing from its partner.  Each set emits its smallest
   shingles in one global (hash) order, that many plus ``l`` more; a linked
   pair then shares at least ``min(l_A, l_B)`` emitted shingles.  A set that
   has too few emitted shingles in common with other sets has no partner and
   leaves exactly (this removes nearly all texts after one grouped minimum
   and maximum, which combine before the shuffle).
2. *Rare first.*  Of the common shingles of a set only the rarest ones are
   kept, as many as still hold one of the shingles common to any partner.
   Passages that many unlike documents share are common shingles and drop
   out without comparing their documents.
3. *First pivots.*  Every kept shingle names a region; a document lies in all
   regions of its kept shingles.  The document of lowest priority in a region is
   its pivot.  Exact distances to it are worked out once for each (document,
   pivot) pair; a region with a third of all rows is dealt over many tasks.
   ``|d(x,p) - d(z,p)| <= d(x,z)``: a document linked to the pivot can only link
   to an unlinked one whose distance lies within ``radius`` of its own.  Linked
   documents outside every such window are done; the others stay open.
4. *Coverage.*  An open document whose shingles are not to four fifths in other
   open documents has no open partner and leaves; open regions that still overlap
   are one cell.
5. *Voronoi cells.*  A cell of more than ``CELL_BYTES`` is split around several
   pivots: each document goes home to its nearest pivot and is copied into every
   cell whose pivot is at most ``2 * radius`` further, so the home cell of either
   document of a link holds both.  Cells split recursively.
6. *Joining.*  A cell's home documents are indexed in a task, by blocks of at most
   ``CELL_BYTES``, and all documents of the cell pass by: shingles in order of
   rarity, prefixes looked up, sizes of the intersections verified.  Blocks also
   finish cells that copies keep from shrinking.
7. Links become component ids by large-star / small-star rounds.

Equal sets are one class from the start; only class representatives are
joined and every copy gets the class's component.

Defined results: null or wordless text has no shingles and links with
nothing; rows that repeat a ``doc_id`` are one document, linked by any of its
texts; rows without a doc_id link with nothing and come back without a
component; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import (components, intersection_size, materialise, runtime_filter, selected,
                                     shingle_sets, slices)

#: Similarity 0.8 as an exact fraction: link when DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
#: Share of a set that its prefix is longer than the least that would do.
SLACK = 0.08
#: Documents of a region that one task compares with the region's pivot.
REGION_SPLIT = 2000
#: Bytes of shingle sets (8 a shingle) that a task holds of a cell at once.
CELL_BYTES = 8 << 20
#: Most pivots that split a cell.
PIVOTS = 32
RADIUS = 1 - NUM / DEN
_EPS = 1e-9


def _missing(a: int) -> int:
    """Most shingles of a set of ``a`` that a linked partner can lack."""
    return a - -(-a * NUM // DEN)


def _extra(a: int) -> int:
    return max(1, int(np.ceil(SLACK * a)))


def _needed(a: int) -> int:
    """Emitted shingles that any partner shares at least: the partner has
    0.8 a shingles or more, so min(l_A, l_B) >= extra(ceil(0.8 a))."""
    return _extra(-(-a * NUM // DEN))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _named(sets: list[np.ndarray]) -> list[np.ndarray]:
    """128-bit names of sets, as two columns."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return list(np.frombuffer(raw, np.int64).reshape(-1, 2).T)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(arrays)), pa.int64()))


def _sketch(k: int, shown: str):
    """Arrow batches (doc_id, text) to doc_id, size and name of the set, with
    the emitted shingles or the whole set if asked for."""
    def run(batches):
        for batch in batches:
            for first, raws in slices(batch.column(1).to_pylist()):
                sets = shingle_sets(raws, k)
                s1, s2 = _named(sets)
                columns = {"doc_id": batch.column(0).slice(first, len(sets)),
                           "n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(s1), "s2": pa.array(s2)}
                if shown == "prefix":
                    columns["prefix"] = _lists([s[:_missing(len(s)) + _extra(len(s))] for s in sets])
                elif shown == "shingles":
                    columns["shingles"] = _lists(sets)
                yield pa.RecordBatch.from_pydict(columns)
    return run


_SKETCH = "doc_id long, n long, s1 long, s2 long"


def _distances(batches):
    """Rows sorted so that the pivot's own row opens each (pivot, part)."""
    pivot, base = None, None
    for pdf in batches:
        out = []
        for p, part, doc, raw in zip(pdf["pivot"], pdf["part"], pdf["doc"], pdf["shingles"]):
            s = np.asarray(raw).view(np.uint64)
            if (p, part) != pivot:
                pivot, base = (p, part), s
                continue
            common = intersection_size(base, s)
            union = len(base) + len(s) - common
            out.append((p, doc, 1.0 - common / union, DEN * common >= NUM * union))
        yield pd.DataFrame(out, columns=["pivot", "doc", "dist", "linked"])


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distance of every (doc, pivot) pair, doc <> pivot."""
    size = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(REGION_SPLIT)).cast("int").alias("parts"))
    dealt = pairs.join(size, "pivot").select(
        "pivot", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc", F.lit(1).alias("own"))
    heads = size.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                        F.col("pivot").alias("doc"), F.lit(0).alias("own"))
    rows = dealt.unionByName(heads).join(sets, "doc")
    return (rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "own")
            .select("pivot", "part", "doc", "shingles")
            .mapInPandas(_distances, "pivot long, doc long, dist double, linked boolean"))


class Block:
    """Shingle sets indexed by the prefixes of a rare-first order."""

    def __init__(self, docs: list[int], sets: list[np.ndarray]):
        self.docs, self.sets = docs, sets
        self.size = np.array([len(s) for s in sets])
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.keys, self.places, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((self.keys, df))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        prefixes = [np.sort(self.rank[self.places[a:a + n]])[:_missing(n) + 1]
                    for a, n in zip(self.start.tolist(), self.size.tolist())]
        owner = np.repeat(np.arange(len(docs)), [len(p) for p in prefixes])
        flat = np.concatenate(prefixes)
        by = np.argsort(flat, kind="stable")
        self.posted, self.post_start = owner[by], np.searchsorted(flat[by], np.arange(len(order) + 1))
        self.comp = np.arange(len(docs))

    def common(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``s`` with every set."""
        held = np.zeros(len(self.keys) + 1, bool)
        at = np.searchsorted(self.keys, s)
        held[at[self.keys[np.minimum(at, len(self.keys) - 1)] == s]] = True
        return np.add.reduceat(held[self.places], self.start)

    def linked(self, s: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of ``rows`` that link with ``s``."""
        small, large = np.minimum(self.size[rows], len(s)), np.maximum(self.size[rows], len(s))
        rows = rows[DEN * small >= NUM * large]
        if len(rows) > 200:
            both = self.common(s)[rows]
        else:
            both = np.array([intersection_size(s, self.sets[r]) for r in rows.tolist()], np.int64)
        return rows[DEN * both >= NUM * (self.size[rows] + len(s) - both)]

    def candidates(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        known = self.keys[at] == s
        # shingles that the block does not hold are the rarest
        ranks = np.sort(self.rank[at[known]])[:max(0, _missing(len(s)) + 1 - int((~known).sum()))]
        lists = [self.posted[a:b] for a, b in zip(self.post_start[ranks].tolist(), self.post_start[ranks + 1].tolist())]
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)

    def _tie(self, i: int, rows: np.ndarray, out: list):
        for j in rows.tolist():
            if self.comp[j] != self.comp[i]:
                out.append((self.docs[i], self.docs[j]))
                self.comp[self.comp == self.comp[j]] = self.comp[i]

    def own_links(self) -> list[tuple[int, int]]:
        """Links between the block's sets, enough that linked ones are
        connected: a few leaders meet all sets first, which joins large groups
        of copies; sets outside the largest group then look up all others."""
        out: list[tuple[int, int]] = []
        everyone = np.arange(len(self.docs))
        for i in everyone[np.linspace(0, len(self.docs) - 1, min(16, len(self.docs))).astype(int)].tolist():
            self._tie(i, self.linked(self.sets[i], everyone), out)
        largest = np.bincount(self.comp).argmax()
        for i in np.flatnonzero(self.comp != largest).tolist():
            rows = self.candidates(self.sets[i])
            rows = rows[self.comp[rows] != self.comp[i]]
            if len(rows):
                self._tie(i, self.linked(self.sets[i], rows), out)
        return out

    def links_to(self, doc: int, s: np.ndarray) -> list[tuple[int, int]]:
        """A link to one set of each group that the passing set links with."""
        rows = self.candidates(s)
        rows = self.linked(s, rows) if len(rows) else rows
        _, first = np.unique(self.comp[rows], return_index=True)
        return [(doc, self.docs[r]) for r in rows[first].tolist()]


def _blocks_joined(batches):
    """Links of blocks: rows (cell, block, passing, doc, shingles), sorted, the
    block's own documents before the passing ones."""
    name, held, block = None, [], None

    def built():
        nonlocal block
        if block is None and held:
            block = Block([d for d, _ in held], [s for _, s in held])
            return block.own_links()
        return []
    for pdf in batches:
        out = []
        for cell, part, passing, doc, raw in zip(*(pdf[c] for c in ("cell", "block", "passing", "doc", "shingles"))):
            if (cell, part) != name:
                out += built()
                name, held, block = (cell, part), [], None
            s = np.asarray(raw).view(np.uint64)
            if not passing:
                held.append((doc, s))
                continue
            out += built()
            if block is not None:
                out += block.links_to(doc, s)
        yield pd.DataFrame(out, columns=["a", "b"])
    yield pd.DataFrame(built(), columns=["a", "b"])


def _homes(batches):
    """Cells of the next level: rows (cell, part, own, doc, home, shingles),
    sorted, the pivots of a cell (own = 0) before its documents."""
    name, pivots = None, []
    for pdf in batches:
        out = []
        for cell, part, own, doc, home, raw in zip(*(pdf[c] for c in ("cell", "part", "own", "doc", "home", "shingles"))):
            if (cell, part) != name:
                name, pivots = (cell, part), []
            s = np.asarray(raw).view(np.uint64)
            if not own:
                pivots.append(s)
                continue
            both = np.array([intersection_size(p, s) for p in pivots])
            away = 1.0 - both / (np.array([len(p) for p in pivots]) + len(s) - both)
            near = int(away.argmin())
            for k in np.flatnonzero(away <= away[near] + 2 * RADIUS + _EPS).tolist():
                out.append((cell, k, doc, bool(home) and k == near))
        yield pd.DataFrame(out, columns=["cell", "child", "doc", "home"])


def _split(cells: DataFrame, big: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Members (parent, cell, doc, home, n) of the ``big`` cells (cell, bytes)
    dealt to the cells around several pivots each."""
    rows = cells.join(big, "cell")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc", F.lit(level)), "doc")
    many = F.least(F.lit(PIVOTS), 2 * F.ceil(F.col("bytes") / CELL_BYTES))
    pivots = (rows.where("home").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
              .where(F.col("place") <= many).select("cell", "doc", "place", "bytes"))
    parts = F.ceil(F.col("bytes") / CELL_BYTES).cast("int")
    dealt = rows.select("cell", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"), F.lit(1).alias("own"),
                        F.lit(0).alias("place"), "doc", "home")
    heads = pivots.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("own"),
                          "place", "doc", F.lit(True).alias("home"))
    met = (dealt.unionByName(heads).join(sets, "doc").repartition("cell", "part")
           .sortWithinPartitions("cell", "part", "own", "place")
           .select("cell", "part", "own", "doc", "home", "shingles")
           .mapInPandas(_homes, "cell long, child long, doc long, home boolean"))
    return (met.join(rows.select("cell", "doc", "n"), ["cell", "doc"])
            .select(F.col("cell").alias("parent"), F.xxhash64("cell", "child", F.lit(level)).alias("cell"), "doc", "home", "n"))


def _work(cells: DataFrame, name: str) -> DataFrame:
    """(name, work): bytes that pass blocks if no cell of ``name`` is split."""
    own = F.sum(F.when(F.col("home"), F.col("n") * 8).otherwise(0))
    each = cells.select("cell", F.col(name).alias("of"), "home", "n").groupBy("cell", "of").agg(
        (F.ceil(own / CELL_BYTES) * F.sum(F.col("n") * 8)).alias("work"))
    return each.groupBy(F.col("of").alias(name)).agg(F.sum("work").alias("work"))


def _cell_links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between documents of the same cell; ``cells`` has cell, doc, n."""
    todo = materialise(cells.select("cell", "doc", F.lit(True).alias("home"), "n"))
    done, held, level = [], F.sum(F.col("n") * 8), 0
    while True:
        size = todo.groupBy("cell").agg(held.alias("bytes"), F.count_if("home").alias("homes"))
        big = materialise(size.where((F.col("bytes") > CELL_BYTES) & (F.col("homes") > 1)).select("cell", "bytes"))
        if big.isEmpty():
            break
        parted = materialise(_split(todo, big, sets, level))
        # a split that does not halve the work is not made: blocks finish the cell
        before = _work(todo.join(big, "cell", "left_semi"), "cell").withColumnRenamed("work", "before")
        good = materialise(before.join(_work(parted, "parent").withColumnRenamed("parent", "cell"), "cell")
                           .where("2 * work <= before").select("cell"))
        done.append(todo.join(good, "cell", "left_anti"))
        todo = materialise(parted.join(good.withColumnRenamed("cell", "parent"), "parent", "left_semi").drop("parent"))
        level += 1
    cells = functools.reduce(DataFrame.unionByName, [*done, todo])
    blocks = cells.where("home").groupBy("cell").agg(F.ceil(held / CELL_BYTES).cast("int").alias("blocks"))
    rows = cells.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    met = rows.select("cell", "doc", "own", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # of two own blocks the later one passes by the earlier
    met = met.where(~F.col("home") | (F.col("own") >= F.col("block")))
    passing = (~F.col("home") | (F.col("own") != F.col("block"))).alias("passing")
    return (met.select("cell", "block", passing, "doc").join(sets, "doc").repartition("cell", "block")
            .sortWithinPartitions("cell", "block", "passing").select("cell", "block", "passing", "doc", "shingles")
            .mapInPandas(_blocks_joined, "a long, b long"))


def _cells(rows: DataFrame) -> DataFrame:
    """(doc, cell): documents whose open regions overlap, in turn."""
    low = rows.groupBy("key").agg(F.min("doc").alias("b"))
    comp = components(rows.join(low, "key").select(F.col("doc").alias("a"), "b"))
    return comp.select(F.col("id").alias("doc"), F.col("component").alias("cell"))


def _covered(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Open rows (key, doc) of documents that have enough of their shingles in
    other open documents."""
    for _ in range(2):
        each = materialise(sets.join(open_.select("doc").distinct(), "doc", "left_semi")
                           .select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
        shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1").select("shingle")
        stay = (each.join(shared, "shingle", "left_semi").groupBy("doc", "n").agg(F.count("*").alias("m"))
                .where(F.col("m") * DEN >= F.col("n") * NUM).select("doc"))
        open_ = materialise(open_.join(stay, "doc", "left_semi"))
    return open_


def _frequent_enough(rows: DataFrame) -> DataFrame:
    """Rows (key, doc, n) whose key has another document, of documents that
    keep at least the number of such keys that a partner would share."""
    shared = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(shared, "key")
    least = F.greatest(F.lit(1), F.ceil(F.lit(SLACK) * F.ceil(F.col("n") * NUM / DEN)).cast("long"))
    have = rows.groupBy("doc").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= least)
    return rows.join(have.select("doc", "m"), "doc")


def jaccard_links(documents: DataFrame, k: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links): ``classes`` has doc_id, n_shingles, rep (smallest id
    with an equal set); ``links`` has (a, b) between ids, enough of them that
    linked documents are connected."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = materialise(docs.mapInArrow(_sketch(k, "none"), _SKETCH))
    docs = docs.where("doc_id is not null")
    sketched = docs.mapInArrow(_sketch(k, "prefix"), _SKETCH + ", prefix array<long>")
    reps = materialise(plain.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")))
    reps = materialise(reps.withColumn("cls", F.monotonically_increasing_id()))
    # only copied sets need their representative looked up
    copied = reps.where("rows > 1").select("s1", "s2", "rep")
    wordy = plain.where("n > 0 and doc_id is not null").join(copied, ["s1", "s2"], "left")
    bare = plain.where("n = 0 or doc_id is null").withColumn("rep", F.col("doc_id"))
    classes = materialise(wordy.unionByName(bare).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")))
    # rows that repeat an id with other texts are one document
    several = classes.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    one_id = classes.join(several.select("doc_id"), "doc_id", "left_semi").where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # 1. documents with enough emitted shingles that another set emits too
    emitted = sketched.select("s1", F.explode("prefix").alias("key"))
    common = materialise(emitted.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"))
                         .where("lo <> hi").select("key"))
    rows = sketched.select("doc_id", "s1", "s2", F.explode("prefix").alias("key"))
    with runtime_filter(spark):
        found = materialise(rows.join(selected(common, "key"), "key", "left_semi"))
    # one row for each key and class, of documents that have enough of them
    own = reps.select("s1", "s2", F.col("rep").alias("doc_id"), "n", F.col("cls").alias("doc"))
    rows = found.join(own, ["s1", "s2", "doc_id"]).select("doc", "n", "key").distinct()
    rows = materialise(_frequent_enough(materialise(_frequent_enough(rows).select("doc", "n", "key")))
                       .select("doc", "n", "key", "df", "m"))

    # 2. the rarest keys that still hold one in common with any partner
    least = F.greatest(F.lit(1), F.ceil(F.lit(SLACK) * F.ceil(F.col("n") * NUM / DEN)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("df", "key"))
    regions = materialise(rows.withColumn("rank", rank).where(F.col("rank") <= F.col("m") - least + 1)
                          .select("key", "doc"))

    # sets of the documents that are left
    members = materialise(own.join(regions.select("doc").distinct(), "doc", "left_semi"))
    ids = materialise(members.select(F.col("doc_id").alias("_id")).distinct())
    with runtime_filter(spark):
        texts = docs.join(selected(ids, "_id"), F.col("doc_id") == F.col("_id"), "left_semi")
        sets = texts.mapInArrow(_sketch(k, "shingles"), _SKETCH + ", shingles array<long>")
        sets = materialise(sets.join(members.select("doc_id", "s1", "s2", "doc"), ["doc_id", "s1", "s2"])
                           .select("doc", "shingles").dropDuplicates(["doc"]))

    # 3. regions around their first pivots
    priority = Window.partitionBy("key").orderBy(F.xxhash64("doc"), "doc")
    pivots = (regions.withColumn("place", F.row_number().over(priority)).where(F.col("place") == 1)
              .select("key", F.col("doc").alias("pivot")))
    placed = regions.join(pivots, "key").where("doc <> pivot")
    measured = materialise(_measure(placed.select("doc", "pivot").distinct(), sets))
    found = measured.where("linked").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    around = placed.join(measured, ["doc", "pivot"])
    ring = around.where("not linked").groupBy("key").agg(F.min("dist").alias("ring"))
    # only regions with an unlinked document can hold an open link
    open_ = materialise(around.join(ring, "key").where(
        F.expr("not linked") | (F.col("dist") + RADIUS + _EPS >= F.col("ring"))).select("key", "doc"))

    # 4 to 6. what the windows leave open, in cells
    open_ = _covered(open_, sets)
    apart = open_.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi")
    open_ = materialise(open_.join(apart.select("key"), "key", "left_semi"))
    cells = _cells(open_).join(members.select("doc", "n"), "doc")
    found = materialise(found.unionByName(_cell_links(cells, sets)))
    named = members.select(F.col("doc").alias("a"), F.col("doc_id").alias("rep_a"))
    links = (found.join(named, "a").join(named.select(F.col("a").alias("b"), F.col("rep_a").alias("rep_b")), "b")
             .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    return classes, links.unionByName(one_id)


def jaccard_components(documents: DataFrame, k: int = 5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by
    links) of every row of ``documents``."""
    classes, links = jaccard_links(documents, k, id_col, text_col)
    comp = components(links)
    return classes.join(comp, classes["rep"] == comp["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
