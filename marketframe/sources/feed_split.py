"""S1 for large landings: a catalog feed ``{"data": [card, ...]}`` read by many
tasks, however few documents hold it.

Spark reads a multi-line JSON document in one task.  Here the file is read as
text with ``}`` as record separator, which splits anywhere, and the cards are
cut out of the stream:

1. the records of a task are packed into *pieces*, in file order, and each piece
   is summarised as a transition: does it flip "inside a string", how far does it
   move the nesting depth, and how many objects does it close at each relative
   depth - once for each of the two states it may start in;
2. prefix sums over the summaries (``ordered.running_totals``, so one file may hold
   everything) give every piece its true start state and the number of cards that
   ended before it;
3. the records of each piece, told apart again, are cut at its card ends, a batch of
   records at a time, so a task's memory does not grow with its pieces.  Whole cards
   stay in their task; only the head and tail of such a run of records are shuffled,
   to be joined with their neighbours.

Pieces are written once to the shared checkpoint folder: all three passes see the
same cuts, also after a lost executor or when the cluster changes its size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.ordered import running_totals
from marketframe.schemas import FEED_CARD
from marketframe.session import checkpoint_dir

CARD_DEPTH = 2   # nesting around a card: the document and its array
# Text before a card (the document's head or a comma) and after the last one.
BEFORE_CARD = r'^\s*(?:\{\s*"data"\s*:\s*\[|,)\s*(?=\{)'
DOCUMENT_END = r'^\s*(?:\{\s*"data"\s*:\s*(?:\[|null))?\s*\]?\s*\}[\s}]*$'

_PIECE = ("file string, block long, piece long, text string, flips int, out_moves int, out_depths array<int>, "
          "out_ends array<int>, in_moves int, in_depths array<int>, in_ends array<int>")
_CUT = "file string, block long, piece long, first long, card long, whole boolean, text string"


def _marks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quotes and brackets of a text that starts outside an escape, and their places."""
    a = np.frombuffer(raw.replace(b"\\\\", b"  ").replace(b'\\"', b"  "), np.uint8)
    at = np.flatnonzero((a == 0x22) | (a == 0x7B) | (a == 0x7D) | (a == 0x5B) | (a == 0x5D))
    return a[at], at


def _depths(marks: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray]:
    """Relative depth after each mark, and which marks close an object; brackets
    inside strings do neither."""
    outside = (np.cumsum(marks == 0x22) + in_string) % 2 == 0
    opens, closes = (marks == 0x7B) | (marks == 0x5B), (marks == 0x7D) | (marks == 0x5D)
    depth = np.cumsum(np.where(outside, opens.astype(np.int64) - closes, 0))
    return depth, (marks == 0x7D) & outside


def _summary(text: str) -> tuple:
    marks, _ = _marks(text.encode())
    out = [int((marks == 0x22).sum() % 2)]
    for in_string in (0, 1):
        depth, ends = _depths(marks, in_string)
        depths, counts = np.unique(depth[ends], return_counts=True)
        out += [int(depth[-1]) if len(depth) else 0, depths.tolist(), counts.tolist()]
    return tuple(out)


def _pieces(batches):
    """Consecutive records of one file split become one piece per batch."""
    block, piece = None, 0
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    for pdf in batches:
        if pdf.empty:
            continue
        turn = ((pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())).cumsum()
        rows = []
        for _, run in pdf.groupby(turn, sort=False):
            here = (run["file"].iloc[0], int(run["block"].iloc[0]))
            block, piece = (block, piece + 1) if here == block else (here, 0)
            text = "}".join(run["value"]) + "}"
            rows.append((*here, piece, text, *_summary(text)))
        yield pd.DataFrame(rows, columns=columns)


def _cut(batches):
    """Records of pieces, in order within a piece, cut behind every card's closing
    brace.  ``in_string``, ``depth`` and ``card`` are those at the piece's start; they
    are carried on from one batch to the next."""
    columns = [c.split()[0] for c in _CUT.split(", ")]
    last, after = None, None
    for pdf in batches:
        if pdf.empty:
            continue
        rows = []
        turn = (pdf[["file", "block", "piece"]] != pdf[["file", "block", "piece"]].shift()).any(axis=1).cumsum()
        for _, run in pdf.groupby(turn, sort=False):
            head = run.iloc[0]
            here = (head["file"], int(head["block"]), int(head["piece"]))
            in_string, depth, card = after if here == last else (
                int(head["in_string"]), int(head["depth"]), int(head["card"]))
            raw = ("}".join(run["record"]) + "}").encode()
            marks, at = _marks(raw)
            moved, ends = _depths(marks, in_string)
            cuts = at[ends & (moved + depth == CARD_DEPTH)] + 1
            start, first = 0, int(head["at"])
            for i, end in enumerate(cuts.tolist()):
                rows.append((*here, first, card + i, i > 0, raw[start:end].decode()))
                start = end
            if start < len(raw):
                rows.append((*here, first, card + len(cuts), False, raw[start:].decode()))
            last = here
            after = ((in_string + int((marks == 0x22).sum())) % 2, depth + (int(moved[-1]) if len(moved) else 0),
                     card + len(cuts))
        yield pd.DataFrame(rows, columns=columns)


def _start_states(pieces: DataFrame) -> DataFrame:
    """Per piece: inside a string or not, the depth, and the cards ended before it."""
    def before(name: str, own: str):
        return F.coalesce(F.col(name), F.lit(0)) - F.col(own)

    place = ["block", "piece"]
    s = running_totals(pieces.drop("text"), ["file"], place, sums={"_q": "flips"})
    s = s.withColumn("in_string", (before("_q", "flips") % 2).cast("int"))
    inside = F.col("in_string") == 1
    s = s.select("file", *place, "in_string",
                 *[F.when(inside, F.col(f"in_{c}")).otherwise(F.col(f"out_{c}")).alias(c)
                   for c in ("moves", "depths", "ends")])
    s = running_totals(s, ["file"], place, sums={"_d": "moves"}).withColumn("depth", before("_d", "moves"))
    at = F.array_position("depths", (F.lit(CARD_DEPTH) - F.col("depth")).cast("int"))
    cards = F.when(at > 0, F.get("ends", (at - 1).cast("int"))).otherwise(0)
    s = s.select("file", *place, "in_string", "depth", cards.alias("n"))
    s = running_totals(s, ["file"], place, sums={"_n": "n"})
    return s.select("file", *place, "in_string", "depth", before("_n", "n").alias("card"))


def read_feed_split(spark: SparkSession, path: str) -> DataFrame:
    """The cards of all documents ``{"data": [card, ...]}`` under ``path`` (UTF-8),
    one row per card, as ``read_feed`` gives them; one document is read by as many
    tasks as it has splits.

    ``data`` must be the document's only member; an empty array, ``null`` and an
    empty file give no cards.  Anything else around or between the cards and a card
    that is no JSON object fail the job instead of being skipped; a document cut off
    right behind a card gives the cards it holds."""
    text = (spark.read.option("lineSep", "}").text(path)
                 .select(F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block"), "value"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/feed-pieces-{uuid.uuid4().hex}"
    text.mapInPandas(_pieces, _PIECE).write.parquet(folder)
    pieces = spark.read.schema(_PIECE).parquet(folder)
    states = _start_states(pieces)
    place = ["file", "block", "piece"]
    # small rows, so a batch for Python is small too; a piece ends with the separator
    records = pieces.select(*place, "text").join(states, place).select(
        *place, "in_string", "depth", "card", F.posexplode(F.split(F.expr("left(text, length(text) - 1)"), "[}]", -1))
        .alias("at", "record"))
    cut = records.mapInPandas(_cut, _CUT)
    whole = cut.where("whole").select("text")
    joined = (cut.where(~F.col("whole")).groupBy("file", "card")   # the pieces of one card
                 .agg(F.array_sort(F.collect_list(F.struct("block", "piece", "first", "text"))).alias("parts"))
                 .select(F.array_join(F.col("parts.text"), "").alias("text")))
    found = whole.unionByName(joined).where(~F.col("text").rlike(DOCUMENT_END) & (F.trim("text") != ""))
    card = (F.when(F.col("text").rlike(BEFORE_CARD), F.regexp_replace("text", BEFORE_CARD, ""))
             .otherwise(F.raise_error(F.concat(F.lit("not a card of the feed: "), F.substring("text", 1, 80)))))
    return found.select(F.from_json(card, FEED_CARD, {"mode": "FAILFAST"}).alias("c")).select("c.*")
