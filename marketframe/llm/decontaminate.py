"""Benchmark decontamination: BM25 with block maxima over the test items.

The terms of the index are word 5-grams.  The test items, cut into *pieces* of at
most ``PIECE`` 5-grams in a row, are the indexed collection, and every passage of
every training text is a query.  A piece is no longer than the overlap of passages,
so one that a text holds verbatim lies in one passage, however long its item is.  A
piece's postings hold BM25 impacts divided by the piece's own score, so a score is
the weighted share of the piece that a passage covers, and one threshold serves all
pieces.

For each passage (overlapping windows of words) the sum of its terms' largest
impacts bounds every score; passages below the threshold stop there.  For the
others block maxima are summed block by block; blocks that cannot reach the
threshold are skipped with all their postings, the rest is scored, so all pieces at
or above it are retrieved.

Only retrieved (text, item) pairs are verified, on the 5-grams of the whole text:
the shares found of the item's question (all lines but the last) and of its answer
(the last line; an item of one line is all question).  A text is contaminated when
half of the item's 5-grams occur in it, or nearly all of the question's.  The
threshold is far below these shares: what it misses are items scattered so thinly
that no passage holds a twentieth of any piece, or whose matching 5-grams are
common to nearly all pieces.

Document frequencies and lengths are counted in Spark over all pieces.  The
index is cut into shards of about ``SHARD_POSTINGS`` postings, each sent to
the tasks in turn, so what a task holds is bounded however many items there
are.

Defined results: null and empty texts match nothing; items with fewer than
five words (null included) hold no 5-gram and are not searched; repeated items
are each reported, with the best values where their texts differ; repeated
rows of a doc_id are reported together, with their best values; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import Words, materialise, slices, windows

K1, B = 1.2, 0.75
#: Least BM25 share of a piece that a passage must cover to be retrieved.
THRESHOLD = 0.05
GRAM = 5
#: Words of a passage and between starts of passages; any ``PASSAGE - STRIDE``
#: words in a row lie in one passage, so pieces are no longer than that.
PASSAGE, STRIDE = 128, 64
PIECE = PASSAGE - STRIDE - GRAM + 1
#: Least shares of 5-grams: of the item, or of its question alone.
OVERLAP, QUESTION = 0.5, 0.9
BLOCK = 16
SHARD_POSTINGS = 1_000_000
#: (passage, block) rows laid out at once; a single passage's rows are one lot.
LOT = 1 << 20


def _lower(text: str | None) -> str | None:
    return text.lower() if isinstance(text, str) else None


def _hashes(text: str) -> np.ndarray:
    return Words([_lower(text).encode("utf-8", "surrogatepass")], lower=False).hashes()


def _grams(h: np.ndarray) -> np.ndarray:
    """The 5-grams of some words, in order."""
    return windows(h, np.zeros(len(h), np.int64), GRAM)[0]


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and of its answer."""
    text = text.strip("\n")
    question, _, answer = text.rpartition("\n")
    return (_hashes(question), _hashes(answer)) if question else (_hashes(text), np.zeros(0, np.uint64))


def _pieces(text: str) -> list[np.ndarray]:
    """5-grams of the pieces of an item; none if it is too short for one."""
    grams = _grams(np.concatenate(_parts(text)))
    return np.array_split(grams, -(-len(grams) // PIECE)) if len(grams) else []


def _item_terms(batches):
    for pdf in batches:
        out = []
        for entry, text in zip(pdf["entry"], pdf["text"]):
            for k, grams in enumerate(_pieces(text)):
                terms, tf = np.unique(grams.view(np.int64), return_counts=True)
                out.append(pd.DataFrame({"entry": entry, "piece": k, "term": terms, "tf": tf, "length": len(grams)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start:end``, joined."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Shard:
    """Postings of some items' pieces, grouped by term (sorted), pieces in blocks;
    and the items' 5-grams to verify with."""
    terms: np.ndarray      # sorted term hashes
    top: np.ndarray        # largest impact of a term
    block_at: np.ndarray   # blocks of term t: block_at[t]:block_at[t + 1]
    block: np.ndarray
    block_top: np.ndarray  # largest impact of a term in a block
    at: np.ndarray         # postings of a term's block b: at[b]:at[b + 1]
    piece: np.ndarray      # piece number within the shard
    impact: np.ndarray
    item_of: np.ndarray    # item number of a piece
    ids: np.ndarray        # item_id of an item number
    grams: list            # distinct 5-grams of each item, its question, its answer

    @classmethod
    def build(cls, rows: list, items: dict[int, tuple[int, str]], n_pieces: int, mean: float) -> Shard:
        entries = np.array(sorted(items), np.int64)
        entry, number = (np.array([r[c] for r in rows], np.int64) for c in ("entry", "piece"))
        pieces, piece = np.unique(np.stack([np.searchsorted(entries, entry), number]), axis=1, return_inverse=True)
        piece = piece.reshape(-1)
        term = np.array([r["term"] for r in rows], np.int64)
        tf, length, df = (np.array([r[c] for r in rows], float) for c in ("tf", "length", "df"))
        weight = np.log(1 + (n_pieces - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (
            tf + K1 * (1 - B + B * length / mean))
        weight /= np.bincount(piece, weight)[piece]
        order = np.lexsort((piece, term))
        term, piece, weight = term[order], piece[order], weight[order]
        terms, first = np.unique(term, return_index=True)
        block = piece // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        grams = []
        for i in entries.tolist():
            question, answer = _parts(items[i][1])
            grams.append([np.unique(_grams(h)) for h in (np.concatenate([question, answer]), question, answer)])
        return cls(terms, np.maximum.reduceat(weight, first), np.append(np.searchsorted(at, first), len(at)), block[at],
                   np.maximum.reduceat(weight, at), np.append(at, len(term)), piece, weight, pieces[0],
                   np.array([items[i][0] for i in entries.tolist()], np.int64), grams)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float):
        """(passage, item, score) of all pieces at or above ``threshold``; the
        passages' distinct terms come in order of the passages."""
        rows = np.concatenate(([0], np.cumsum(self.block_at[term + 1] - self.block_at[term])))
        ends = np.append(np.flatnonzero(passage[1:] != passage[:-1]) + 1, len(passage)) if len(passage) else passage
        start = 0
        while start < len(passage):  # whole passages, about LOT rows at once
            fit = ends[(ends > start) & (rows[ends] <= rows[start] + LOT)]
            end = int(fit[-1] if len(fit) else ends[np.searchsorted(ends, start, "right")])
            mine = term[start:end]
            b = _spans(self.block_at[mine], self.block_at[mine + 1])
            p = np.repeat(passage[start:end], self.block_at[mine + 1] - self.block_at[mine])
            _, group = np.unique(p * (len(self.item_of) // BLOCK + 1) + self.block[b], return_inverse=True)
            alive = np.bincount(group, self.block_top[b])[group] >= threshold
            b, p = b[alive], p[alive]
            at, p = _spans(self.at[b], self.at[b + 1]), np.repeat(p, self.at[b + 1] - self.at[b])
            pairs, group = np.unique(p * len(self.item_of) + self.piece[at], return_inverse=True)
            score = np.bincount(group, self.impact[at], len(pairs))
            good = score >= threshold
            p, piece = np.divmod(pairs[good], len(self.item_of))
            yield from zip(p.tolist(), self.item_of[piece].tolist(), score[good].tolist())
            start = end

    def verify(self, item: int, text: np.ndarray) -> list[float] | None:
        """Shares of the 5-grams of an item, its question and its answer among a
        text's; None below the bounds."""
        shares = [float(np.isin(g, text).sum() / max(1, len(g))) for g in self.grams[item]]
        return shares if shares[0] >= OVERLAP or shares[1] >= QUESTION else None


def _search(shard: Shard, threshold: float):
    def run(batches):
        for pdf in batches:
            out = []
            for start, raws in slices(map(_lower, pdf["text"])):
                w = Words(raws, lower=False)
                gram, first = windows(w.hashes(), w.doc, GRAM)
                t = np.searchsorted(shard.terms, gram.view(np.int64))
                t[t == len(shard.terms)] = 0
                known = shard.terms[t] == gram.view(np.int64)
                t, first, gram = t[known], first[known], gram[known]   # in order of the words
                if not len(t):
                    continue
                total = np.concatenate(([0.0], np.cumsum(shard.top[t])))
                # passages of all texts at once: starts every STRIDE words
                at = np.searchsorted(w.doc, np.arange(len(raws) + 1))
                n = np.diff(at)
                count = np.where(n > 0, 1 + np.maximum(0, -(-(n - PASSAGE) // STRIDE)), 0)
                doc = np.repeat(np.arange(len(raws)), count)
                lo = at[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
                hi = np.minimum(lo + PASSAGE, at[doc + 1])
                lo, hi = np.searchsorted(first, lo), np.searchsorted(first, hi - GRAM, "right")
                hi = np.maximum(lo, hi)
                asked = np.flatnonzero((hi > lo) & (total[hi] - total[lo] >= threshold))
                p, term = np.divmod(np.unique(np.repeat(asked, (hi - lo)[asked]) * len(shard.terms)
                                              + t[_spans(lo[asked], hi[asked])]), len(shard.terms))
                best: dict[tuple[int, int], float] = {}
                for k, item, score in shard.retrieve(p, term, threshold):
                    pair = int(doc[k]), item
                    best[pair] = max(score, best.get(pair, 0.0))
                ends = np.searchsorted(w.doc[first], np.arange(len(raws) + 1))
                mine, text = -1, None
                for (d, item), score in sorted(best.items()):
                    if d != mine:
                        mine, text = d, np.unique(gram[ends[d]:ends[d + 1]])
                    shares = shard.verify(item, text)
                    if shares:
                        out.append((pdf["doc_id"].iat[start + d], int(shard.ids[item]), score, *shares))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "overlap", "question", "answer"])
    return run


def contaminated(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                 shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(doc_id, item_id, score, overlap, question, answer) of every text that
    holds a test item; ``documents`` has doc_id and text, ``items`` item_id
    and text."""
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    items = items.withColumn("entry", F.xxhash64("item_id", "text"))
    postings = materialise(items.mapInPandas(_item_terms, "entry long, piece long, term long, tf long, length long"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    pieces = postings.select("entry", "piece", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    shards = max(1, -(-postings.count() // shard_postings))
    found = None
    for k in range(shards):
        mine = F.pmod(F.xxhash64("entry"), F.lit(shards)) == k
        rows = postings.where(mine).join(df, "term").collect()  # about shard_postings rows
        searched = {r["entry"] for r in rows}
        texts = {r["entry"]: (r["item_id"], r["text"]) for r in items.where(mine).collect() if r["entry"] in searched}
        if not texts:
            continue
        shard = Shard.build(rows, texts, pieces["n"], pieces["mean"])
        part = documents.select("doc_id", "text").mapInPandas(
            _search(shard, threshold),
            "doc_id long, item_id long, score double, overlap double, question double, answer double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, score double, overlap double, question double, answer double")
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "overlap", "question", "answer")])
