"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of words with smallest period ``q``, at least
``max(LEAST_LENGTH, EXPONENT * q)`` words long, that no neighbouring word
extends keeping that period.

1. *Grammar.*  The word ids of a slice of texts become one sequence in which
   no pair crosses a text's border.  Re-Pair in rounds: every pair that stands
   twice and is more frequent than the pairs it overlaps becomes a nonterminal
   (the most frequent pair of all always does), until no pair stands twice.
   What is left of each text is paired up as a balanced tree, so every text has
   one root.
2. *Boundaries, once a nonterminal.*  A run of four periods or more that crosses
   the border between the two children has two periods on one side of it.  Such
   squares at the border are found by comparing words, then hashes of whole
   blocks; common extensions to both sides give the run inside the nonterminal.
3. *Translation.*  Runs of a nonterminal are put at all places of its derivation.
4. *Merging.*  Intervals of one period that share a period or more are one; each
   result is compared word by word before it is reported, so hash collisions
   cannot change it.

Every run crosses the border of the lowest node that holds all of it, so none
is lost.  Texts are independent and the job is one narrow pass: no text is ever
cut, and the work per word grows with the logarithm of the text's length.

Defined results: null and empty texts have no words and no runs; a null id stays
null; rows that repeat an id or a text are texts of their own; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from marketframe.llm.common import _power_tables, mix, slices

EXPONENT, LEAST_LENGTH = 4, 6
#: Border tests of one numpy pass.
TESTS = 1 << 20
#: Rounds of pairing at most; pairs left then go to the balanced tree.
ROUNDS = 64

_RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Binary rules over ``ids`` (negative: border of a text).

    Rule ``k`` is symbol ``base + k`` and stands for words ``begin[k]`` to
    ``end[k]`` of its first place, its children meeting at ``middle[k]``;
    ``symbols`` at ``places`` is what is left of the sequence."""

    def __init__(self, ids: np.ndarray):
        self.base = len(ids)
        symbols, places = ids.astype(np.int64), np.arange(len(ids))
        length = np.ones(len(ids), np.int64)
        left, right, begin, middle, end, self.rounds = [], [], [], [], [], [0]
        top, fresh = self.base, np.ones(max(len(ids) - 1, 0), bool)
        for _ in range(ROUNDS):
            # every other pair within a stretch of one symbol
            a, b = symbols[:-1], symbols[1:]
            same = (a == b) & (a >= 0)
            index = np.arange(len(a))
            first = np.maximum.accumulate(np.where(same, 0, index + 1)) if len(a) else index
            able = fresh & (a >= 0) & (b >= 0) & ~(same & ((index - first) % 2 == 1))
            at = np.flatnonzero(able)
            if not len(at):
                break
            _, inverse, count = np.unique(a[at] * np.int64(top) + b[at], return_inverse=True, return_counts=True)
            # by frequency; ties in an order that has nothing to do with places
            rank = np.empty(len(count), np.int64)
            rank[np.lexsort((mix(np.arange(len(count), dtype=np.uint64)), count))] = np.arange(1, len(count) + 1)
            weight = np.zeros(len(a) + 2, np.int64)
            twice = count[inverse] > 1
            weight[at[twice] + 1] = rank[inverse[twice]]
            picked = (weight[1:-1] > weight[:-2]) & (weight[1:-1] > weight[2:])
            kind = np.full(len(a), -1, np.int64)
            kind[at] = inverse
            chosen = np.flatnonzero(picked)
            often = np.bincount(kind[chosen], minlength=len(count)) > 1
            chosen = chosen[often[kind[chosen]]]
            # a pair that stands once can never stand twice again
            fresh[at[~twice]] = False
            if not len(chosen):
                break
            _, where, name = np.unique(kind[chosen], return_index=True, return_inverse=True)
            rep = chosen[where]
            left.append(a[rep])
            right.append(b[rep])
            begin.append(places[rep])
            middle.append(places[rep] + length[rep])
            end.append(places[rep] + length[rep] + length[rep + 1])
            symbols[chosen] = top + name
            length[chosen] += length[chosen + 1]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            new = np.zeros(len(symbols), bool)
            new[chosen] = True
            fresh = np.append(fresh, False)[keep]
            symbols, places, length, new = symbols[keep], places[keep], length[keep], new[keep]
            fresh = (fresh[:-1] | new[:-1] | new[1:])
            top += len(rep)
            self.rounds.append(top - self.base)

        def joined(parts):
            return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.left, self.right, self.begin, self.middle, self.end = map(joined, (left, right, begin, middle, end))
        self.symbols, self.places, self.length = symbols, places, length

    def trees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, middle, end) of the nodes that pair up what is left of
        each text, level by level."""
        inside = self.symbols >= 0
        text = np.cumsum(~inside)[inside]
        low, high = self.places[inside], (self.places + self.length)[inside]
        nodes = []
        while len(text):
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            inner = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
            mate = np.flatnonzero((inner[1:] % 2 == 1) & (text[1:] == text[:-1]))
            if not len(mate):
                break
            nodes.append((low[mate], high[mate], high[mate + 1]))
            high = high.copy()
            high[mate] = high[mate + 1]
            keep = np.ones(len(text), bool)
            keep[mate + 1] = False
            text, low, high = text[keep], low[keep], high[keep]
        if not nodes:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*nodes))


class Sequence:
    """Words with hashes of all prefixes: equality of stretches in one step."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        up, self.down = _power_tables(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[:len(ids)], out=self.total[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ((self.total[a + n] - self.total[a]) * self.down[a]
                == (self.total[b + n] - self.total[b]) * self.down[b])

    def reach(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Length up to ``limit`` of the common words from ``a`` and ``b`` on,
        or ending before them."""
        lo, hi = np.zeros(len(a), np.int64), limit.copy()
        while (lo < hi).any():
            n = (lo + hi + 1) // 2
            same = self.equal(a - n, b - n, n) if back else self.equal(a, b, n)
            lo, hi = np.where(same, n, lo), np.where(same, hi, n - 1)
        return lo


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 1..count) of every item of groups of the given sizes."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(1, len(owner) + 1) - np.repeat(np.cumsum(count) - count, count)


def crossing_runs(seq: Sequence, begin: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """(node, start, end, period) of the runs inside each node that cross its
    middle; a run that touches the node's border may go on beyond it."""
    ids, found = seq.ids, []
    span = (end - begin) // EXPONENT
    span[end - begin < LEAST_LENGTH] = 0
    for back in (True, False):
        count = np.minimum(span, ((middle - begin) if back else (end - middle)) // 2)
        open_ = np.flatnonzero(count > 0)
        cut = np.searchsorted(np.cumsum(count[open_]), np.arange(TESTS, count.sum() + TESTS, TESTS), "left")
        for nodes in np.split(open_, np.unique(np.minimum(cut + 1, len(open_)))):
            if not len(nodes):
                continue
            owner, q = _ragged(count[nodes])
            m = middle[nodes][owner]
            sign = -q if back else q
            hit = np.flatnonzero((ids[m - 1] == ids[m - 1 + sign]) & (ids[m] == ids[m + sign]))
            node, q, m = nodes[owner[hit]], q[hit], m[hit]
            square = seq.equal(m - 2 * q, m - q, q) if back else seq.equal(m, m + q, q)
            node, q, m = node[square], q[square], m[square]
            other = m - q if back else m + q
            # words that repeat the one a period away, to both sides of the middle
            lower, upper = np.minimum(m, other), np.maximum(m, other)
            before = seq.reach(lower, upper, lower - begin[node], back=True)
            after = seq.reach(lower, upper, end[node] - upper)
            start, stop = lower - before, upper + after
            good = (stop - start >= np.maximum(EXPONENT * q, LEAST_LENGTH)) & (start < m) & (stop > m)
            found.append(np.stack((node, start, stop, q))[:, good])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return _least_period(*np.concatenate(found, axis=1))


def _least_period(node, start, stop, period):
    order = np.lexsort((period, stop, start, node))
    node, start, stop, period = node[order], start[order], stop[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[new], start[new], stop[new], period[new]


def translated(grammar: Grammar, node: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray):
    """Runs of rules at every place of their derivation: (start, stop, period)."""
    n = len(grammar.left)
    own = np.bincount(node, minlength=n) if len(node) else np.zeros(n, np.int64)
    marked = own > 0
    for lo, hi in itertools.pairwise(grammar.rounds):
        for child in (grammar.left[lo:hi], grammar.right[lo:hi]):
            inner = child >= grammar.base
            marked[lo:hi][inner] |= marked[child[inner] - grammar.base]
    first = np.cumsum(own) - own
    order = np.argsort(node, kind="stable")
    start, stop, period = start[order], stop[order], period[order]
    rule, place, out = grammar.symbols - grammar.base, grammar.places, []
    while len(rule):
        live = np.flatnonzero(rule >= 0)
        live = live[marked[rule[live]]]
        rule, place = rule[live], place[live]
        owner, k = _ragged(own[rule])
        run = first[rule[owner]] + k - 1
        shift = place[owner] - grammar.begin[rule[owner]]
        out.append(np.stack((start[run] + shift, stop[run] + shift, period[run])))
        rule, place = (np.concatenate((grammar.left[rule], grammar.right[rule])) - grammar.base,
                       np.concatenate((place, place + grammar.middle[rule] - grammar.begin[rule])))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def merge_runs(start: np.ndarray, stop: np.ndarray, period: np.ndarray):
    """Maximal intervals: those of one period that share a period or more."""
    if not len(start):
        return start, stop, period
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    # running end within a period: ends are lifted by the period's rank
    lift = (np.cumsum(np.concatenate(([0], np.diff(period) != 0)))) * (stop.max() + 1)
    furthest = np.maximum.accumulate(stop + lift) - lift
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > furthest[:-1] - period[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    zero = np.zeros(len(first), np.int64)
    _, start, stop, period = _least_period(zero, start[first], furthest[last], period[first])
    return start, stop, period


def compared_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) by comparing the words at every distance."""
    found = []
    for q in range(1, len(ids) // EXPONENT + 1):
        edge = np.diff(np.concatenate(([0], (ids[q:] == ids[:-q]).view(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b + q - a >= max(EXPONENT * q, LEAST_LENGTH):
                found.append((a, b + q, q))
    _, a, b, q = _least_period(np.zeros(len(found), np.int64), *np.array(found, np.int64).reshape(-1, 3).T)
    return list(zip(a.tolist(), b.tolist(), q.tolist()))


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, stop, period) of the runs of each array of word ids."""
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    ids = np.empty(begin[-1], np.int64)
    for k, (b, t) in enumerate(zip(begin.tolist(), texts)):
        ids[b:b + len(t)] = t
        ids[b + len(t)] = -k - 1
    grammar, seq = Grammar(ids), Sequence(ids)
    rules = translated(grammar, *crossing_runs(seq, grammar.begin, grammar.middle, grammar.end))
    _, *rest = crossing_runs(seq, *grammar.trees())
    start, stop, period = merge_runs(*np.concatenate((rules, np.stack(rest)), axis=1))
    # word by word
    owner, k = _ragged(stop - start - period)
    at = start[owner] + k - 1
    wrong = owner[ids[at] != ids[at + period[owner]]]
    text = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((period, start))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, a, b, q in zip(*(x[order].tolist() for x in (text, start, stop, period))):
        out[t].append((a - int(begin[t]), b - int(begin[t]), q))
    for t in set(text[wrong].tolist()):  # two stretches of one 64-bit hash
        out[t] = compared_runs(texts[t])
    return out


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the original words in a text whose words are taken in turns:
    ids whose CRC-32 ends in 0 repeat a stretch of ``p`` words from ``a`` on;
    None leaves the text as it is (also without an id)."""
    if doc_id is None or not n:
        return None
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """id, n_words, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``: the words that no run holds behind its first period, joined
    by one space.  ``order`` may name other places to take a text's words from."""
    added = _parse_datatype_string(_RESULT)
    schema = StructType([StructField(id_col, documents.schema[id_col].dataType)] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, raws in slices(batch.column(1).to_pylist()):
                # bytes are split at 0x20 and 0x09 to 0x0D; an id is a word's first place
                texts, table, counter = [], {}, itertools.count()
                for k, raw in enumerate(raws):
                    words = raw.split()
                    turn = order(names[first + k], len(words)) if order else None
                    if turn is not None:
                        words = [words[i] for i in turn.tolist()]
                    texts.append(words)
                ids = [np.fromiter(map(table.setdefault, w, counter), np.int64, len(w)) for w in texts]
                found, kept = runs_of(ids), []
                for words, runs in zip(texts, found):
                    if runs:
                        change = np.zeros(len(words) + 1, np.int64)
                        for a, b, q in runs:
                            change[a + q] += 1
                            change[b] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                rows = [[{"start": a, "length": b - a, "period": q} for a, b, q in runs] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(raws)), pa.array([len(w) for w in texts], pa.int64()),
                     pa.array(rows, arrow.field("runs").type), pa.array(kept, pa.string())], schema=arrow)
    return documents.select(id_col, text_col).mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One line per text: number of runs, the run of greatest exponent and
    hashes of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def longer(best, run):  # exact fractions; runs come by start, then period
        more = (run["length"].cast("decimal(38,0)") * best["period"]
                > best["length"].cast("decimal(38,0)") * run["period"])
        return F.when(best.isNull() | more, run).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in (
        "start", "length", "period")]), F.lit("\n")))
    best = F.aggregate("runs", none, longer)
    return found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        id_col, "n_runs", *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
