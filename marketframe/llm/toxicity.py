"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first (lower case, accents off, homoglyphs of other scripts
replaced by the letter they look like, digits and symbols within a word or at
its edge by the letter they stand for, ``!`` and ``|`` only within one,
everything else made a space).  The lexicon holds whole words
and word beginnings; it and its weights (log odds of a document being toxic
when it holds the entry) are learned from labelled rows.  One automaton pass
finds all entries of a text; for each word the longest entry counts, unless
the word stands in an exception phrase (a word pair that is common in clean
labelled texts although it holds a lexicon word).  The summed weight, alone
and divided by the number of words, goes through a logistic curve fitted on
the same rows.

Bounds: at most ``SAMPLE_ROWS`` labelled rows are learned from (the lowest
hashes of their ids) and at most ``LEXICON_SIZE`` entries kept, as many leaning
words and as many exception phrases, the strongest ones; both are parameters,
and they bound what reaches the driver.

Defined results: null and empty texts hold no entry and get the curve's
lowest score; without any toxic labelled row the lexicon is empty and every
score is 0; repeated rows are scored alike; labels that are null or have no
document are not learned from; other columns of the input pass through
``score`` untouched unless they are named like its results, which replace
them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import map_texts

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 20_000
#: Entries need this many toxic labelled texts, this share of them, and this
#: log odds.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 3, 0.01, 3.0
#: Least log odds after two standard errors: a word that a few toxic texts hold
#: by chance is no entry.
SURE = 0.5
#: Log odds from which a word leans to toxic texts, or a word pair to clean ones.
LEANING = 0.5
#: Lengths of word beginnings that may become entries.
STEMS = range(4, 8)

# Letters of other scripts that look like Latin ones, and the
# digits and symbols that stand for letters.
HOMOGLYPHS = dict(zip("абвгеёзіїјкмнорстухѕԁһӏαβεηικνορτυχω", "abbreeziijkmhopctyxsdhiabehikvoptuxw"))
SUBSTITUTES = dict(zip("0134579@$!|", "oieastgasii"))
#: l and i are one letter, as both are written for the other.
_ONE_LETTER = {"l": "i"}
HIDDEN = "­​‌‍⁠﻿"


class _Fold(dict):
    """Translation table that works out each code point once."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        if c in HIDDEN:
            out = ""
        else:
            base = unicodedata.normalize("NFKD", c)[0]
            base = HOMOGLYPHS.get(base, base)
            base = _ONE_LETTER.get(base, base)
            out = base if base.isalpha() or base in SUBSTITUTES else " "
        self[code] = out
        return out


_FOLD = _Fold()
_LETTER, _SIGNS = r"[^\W\d_]", "".join(SUBSTITUTES)
_INSIDE = re.compile(rf"(?<={_LETTER})[{_SIGNS}]+(?={_LETTER})")
#: ``!`` and ``|`` at a word's end are punctuation.
_EDGE = re.compile(rf"(?<={_LETTER})[{_SIGNS.strip('!|')}]+|[{_SIGNS.strip('!|')}]+(?={_LETTER})")
_LETTERS = str.maketrans(SUBSTITUTES)
_NO_LETTERS = str.maketrans(dict.fromkeys(_SIGNS, " "))


def fold(text: str | None) -> str:
    """The folded text: words with one space before and after each."""
    if not text:
        return ""
    out = text.translate(_FOLD)
    for at in (_INSIDE, _EDGE):
        out = at.sub(lambda m: m[0].translate(_LETTERS), out)
    return f" {' '.join(out.translate(_NO_LETTERS).split())} "


def _features(words: set[str]):
    for w in words:
        yield f" {w} "
        for n in STEMS:
            if len(w) > n:
                yield f" {w[:n]}"


def _kept(words: list[str], exceptions: frozenset[str]) -> set[str]:
    """Words that stand outside exception phrases at least once."""
    if not exceptions:
        return set(words)
    pairs = [f"{a} {b}" in exceptions for a, b in zip(words, words[1:])]
    return {w for w, left, right in zip(words, [False, *pairs], [*pairs, False]) if not (left or right)}


def _count(exceptions: frozenset[str]):
    """Toxic and clean texts of each possible entry."""
    def run(batches):
        total: dict[str, list[int]] = {}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for f in set(_features(_kept(fold(text).split(), exceptions))):
                    total.setdefault(f, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(f, t, c) for f, (c, t) in total.items()], columns=["entry", "t", "c"])
    return run


def _pair_rows(words: frozenset[str]):
    """Toxic and clean texts of each word pair that holds one of ``words``."""
    def run(batches):
        total: dict[str, list[int]] = {}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                own = fold(text).split()
                for p in {f"{a} {b}" for a, b in zip(own, own[1:]) if a in words or b in words}:
                    total.setdefault(p, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(f, t, c) for f, (c, t) in total.items()], columns=["entry", "t", "c"])
    return run


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry in self.weights:
            a.add_word(entry, entry)
        if self.weights:
            a.make_automaton()
        return a

    def matches(self, folded: str, automaton) -> list[tuple[int, str]]:
        """(place, longest entry) of every word that holds one."""
        best: dict[int, str] = {}
        for end, entry in automaton.iter(folded) if self.weights else ():
            at = end - len(entry) + 1
            if len(entry) > len(best.get(at, "")):
                best[at] = entry
        return sorted(best.items())

    def measure(self, text: str | None, automaton) -> tuple[float, int, int]:
        """Summed weight, entries found outside exception phrases, and words."""
        folded = fold(text)
        weight, n = 0.0, 0
        for at, entry in self.matches(folded, automaton):
            if not (self.exceptions and any(p in self.exceptions for p in _pairs(folded, at))):
                weight, n = weight + self.weights[entry], n + 1
        return weight, n, len(folded.split())

    def score(self, weight: float, words: int) -> float:
        if self.curve is None:
            return 0.0
        x = sum(a * b for a, b in zip(self.curve, _inputs(weight, words)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _pairs(folded: str, at: int) -> list[str]:
    """The word that starts after ``at`` with its left and its right neighbour."""
    end = folded.find(" ", at + 1)
    word = folded[at + 1:end]
    left = folded[folded.rfind(" ", 0, at) + 1:at] if at else ""
    right = folded[end + 1:folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
    return ([f"{left} {word}"] if left else []) + ([f"{word} {right}"] if right else [])


def _inputs(weight: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(100 * weight / max(1, words))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge.  More lexicon
    weight never makes a text less toxic: an input whose coefficient comes out
    negative is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        z = x[:, use]
        b = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            grad = z.T @ (y - p) - 0.1 * b
            hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(b))
            step = np.linalg.solve(hess, grad)
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        full = np.zeros(x.shape[1])
        full[use] = b
        if (full[1:] >= 0).all():
            return tuple(float(v) for v in full)
        use[1 + int(np.argmin(full[1:]))] = False


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          lexicon_size: int = LEXICON_SIZE) -> Lexicon:
    """Lexicon, weights, exceptions and curve from rows (doc_id, toxic) of
    ``labels``; the caller leaves out what is held out."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # bounded by sample_rows ids
    train = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    train = train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).persist()
    try:
        sizes = {int(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
        if not sizes.get(1):
            return Lexicon()
        clean, toxic = sizes.get(0, 0), sizes[1]
        least = max(LEAST_TEXTS, LEAST_SHARE * toxic)

        def odds_of(rows: DataFrame) -> DataFrame:
            odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
            error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
            return (rows.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                    .withColumn("odds", odds).withColumn("sure", F.col("odds") - 2 * error))

        def entries(exceptions: frozenset[str], odds: float, sure: float) -> dict[str, float]:
            counts = odds_of(train.mapInPandas(_count(exceptions), "entry string, t long, c long"))
            rows = (counts.where((F.col("t") >= least) & (F.col("odds") >= odds) & (F.col("sure") >= sure))
                    .orderBy(F.desc("odds"), F.desc("t"), "entry").limit(lexicon_size).collect())
            return {r["entry"]: r["odds"] for r in rows}
        # words that lean to toxic texts, and the pairs in which clean texts use them
        leaning = frozenset(e.strip() for e in entries(frozenset(), LEANING, 0.0) if e.endswith(" "))
        pairs = odds_of(train.mapInPandas(_pair_rows(leaning), "entry string, t long, c long"))
        pairs = (pairs.where((F.col("c") >= LEAST_TEXTS) & (F.col("odds") <= -LEANING))
                 .orderBy("odds", F.desc("c"), "entry").limit(lexicon_size).collect())
        exceptions = frozenset(r["entry"] for r in pairs)
        found = Lexicon(entries(exceptions, LEAST_ODDS, SURE), exceptions)
        measured = _measure(train, found).collect()  # bounded by sample_rows
        x = np.array([_inputs(r["weight"], r["words"]) for r in measured])
        found.curve = _fit(x, np.array([float(r["toxic"]) for r in measured]))
        return found
    finally:
        train.unpersist()


def _measure(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches):
        automaton = lexicon.automaton()
        for pdf in batches:
            out = [lexicon.measure(t, automaton) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "weight": [m[0] for m in out],
                                "words": [m[2] for m in out]})
    return train.mapInPandas(run, "toxic int, weight double, words long")


def score(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", texts: bool = True) -> DataFrame:
    """``documents`` with score, predicted, n_matches and weight.  With
    ``texts=False`` the text column itself is left out of the result."""
    def make():
        automaton = lexicon.automaton()

        def work(batch):
            out = []
            for t in batch:
                weight, n, words = lexicon.measure(t, automaton)
                s = lexicon.score(weight, words)
                out.append((s, int(s >= 0.5), n, weight))
            return out
        return work
    return map_texts(documents, make, "score double, predicted int, n_matches long, weight double",
                     text_col, drop=not texts)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
