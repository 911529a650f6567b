"""Quality rules by tokeniser fertility.

Public vocabularies read every whole text.  Measured are characters per token
of each vocabulary, the share of tokens that are byte fallbacks (pieces that
stand for single bytes because no piece covers the characters), and the
entropy of the text's tokens relative to the most its length allows.  Natural
text of a language lies in narrow bands of these; tables of symbols, encoded
data, repeated filler and garbled characters lie outside.

Bands are set for each language (or script, where the language is unknown)
and length class (powers of two of the tokens, as short texts scatter more)
from all texts that pass the base rules: the median, plus and minus ``REACH``
times the distance to the quartile on that side.  A class with fewer than
``LEAST_TEXTS`` such texts takes its language's bands.  The quantiles are
Spark's mergeable sketches, combined before the shuffle, so a language with a
third of all rows is one sketch a task.  Texts of fewer than ``SHORT`` tokens
share the lowest class, and their bands widen with ``SHORT`` over the tokens,
as the measures of short texts scatter more; no length is left unjudged.
``REACH`` is set on the labels outside the held-out rows (README has the kept
junk and the rejected good texts of both).

Base rules (fixed): a text fails with fewer than 10 words, or when more than
20 % of its words lie in 5-word windows that occur twice in it.

Defined results: null text has no words and fails; rows of one doc_id are
judged each; null languages are grouped by script; a language whose texts all
fail the base rules has no bands; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import Words, materialise, slices, windows
from marketframe.llm.tokens import ByteLevelTokenizer

# Fixed values of the base rules.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"
#: Bands widen below so many tokens.
SHORT = 128
#: Band width in distances of the median to the quartiles, each at least
#: MARGIN of the median; the byte share is never out of band below BYTE_SHARE.
REACH = {"chars_per_token": 4.5, "chars_per_piece": 5.5, "byte_share": 5.0, "entropy": 4.5}
MARGIN, BYTE_SHARE = 0.01, 0.1
LEAST_TEXTS = 50
#: Unknown languages are told apart by the script of most of their letters.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}",
           "hebrew": r"\p{IsHebrew}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]",
           "hangul": r"\p{IsHangul}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}"}
_BLANK = bytes(b" \t\n\x0b\x0c\r")


def base_measures(raws: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text."""
    w = Words(raws, lower=False)
    n = w.n_docs
    ends = w.begin + w.lens

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[w.begin]
    blank = (w.buf == 32) | ((w.buf >= 9) & (w.buf <= 13))
    chars = per_text(~blank & ((w.buf & 0xC0) != 0x80))
    symbols = per_text(np.isin(w.buf, np.frombuffer(SYMBOLS.encode(), np.uint8)))
    words = np.bincount(w.doc, minlength=n) if len(w.doc) else np.zeros(n, int)
    h, first = windows(w.hashes(), w.doc, WINDOW)
    repeat = np.zeros(n, int)
    if len(h):
        doc = w.doc[first]
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(w.doc) + 1, int)
        np.add.at(edge, first[twice], 1)
        np.add.at(edge, first[twice] + WINDOW, -1)
        repeat = np.bincount(w.doc, np.cumsum(edge[:-1]) > 0, n).astype(int)
    out = []
    for i, raw in enumerate(raws):
        lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
        out.append((int(words[i]), int(chars[i]), int(symbols[i]), len(lines) - len(set(lines)), int(repeat[i])))
    return out


def _entropy(ids: np.ndarray) -> float:
    """Entropy of the ids over the logarithm of their number."""
    if len(ids) < 2:
        return 1.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(len(ids)))


def measure(documents: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, group (language or script), the base measures, and n_tokens,
    chars_per_token (byte-level vocabulary), chars_per_piece, byte_share and
    entropy (piece vocabulary)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens",
             "chars_per_token", "chars_per_piece", "byte_share", "entropy"]
    kinds = [pa.int64()] * 6 + [pa.float64()] * 4

    def run(batches):
        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        tokens = ByteLevelTokenizer(byte_bpe)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            rows = []
            for first, raws in slices(texts):
                mine = texts[first:first + len(raws)]
                for base, text, ids in zip(base_measures(raws), mine, pieces.encode(mine, num_threads=1)):
                    ids = np.array(ids, np.int64)
                    n = len(tokens.encode(text))
                    rows.append((*base, n, len(text) / max(1, n), len(text) / max(1, len(ids)),
                                 float(is_byte[ids].mean()) if len(ids) else 0.0, _entropy(ids)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "group", *names])
    docs = documents.select(F.col(id_col).alias("doc_id"), group_of(F.col(lang_col), F.col(text_col)).alias("group"),
                            F.col(text_col).alias("text"))
    schema = "doc_id long, group string, " + ", ".join(f"{n} {'long' if k == pa.int64() else 'double'}"
                                                       for n, k in zip(names, kinds))
    return docs.mapInArrow(run, schema)


def group_of(lang: Column, text: Column) -> Column:
    """The language; without one, the first script that holds the text's
    letters for the most part, else latin."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    out = F.lit("script:latin")
    for name, letter in reversed(SCRIPTS.items()):
        own = F.length(F.regexp_replace(text, letter.replace("[", "[^") if letter[0] == "[" else f"[^{letter}]", ""))
        out = F.when(own * 2 > letters, f"script:{name}").otherwise(out)
    return F.when(lang.isNotNull() & (lang != ""), lang).otherwise(out)


MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")


def _edges(fair: DataFrame, *by: str) -> DataFrame:
    """Median of each measure, how far it may lie below and above, and the
    texts seen."""
    q = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(m) for m in MEASURES]
    edges = []
    for m in MEASURES:
        low, mid, high = (F.get(m, i) for i in range(3))
        edges += [mid.alias(f"{m}_mid"), (REACH[m] * F.greatest(mid - low, MARGIN * mid)).alias(f"{m}_below"),
                  (REACH[m] * F.greatest(high - mid, MARGIN * mid)).alias(f"{m}_above")]
    return fair.groupBy(*by).agg(F.count("*").alias("texts"), *q).select(*by, "texts", *edges)


def _outside(m: str) -> Column:
    """Whether a measure is out of its band, wider for a short text."""
    wide = F.greatest(F.lit(1.0), SHORT / F.greatest(F.lit(1), F.col("n_tokens")))
    mid = F.col(f"band.{m}_mid")
    top = mid + wide * F.col(f"band.{m}_above")
    if m == "byte_share":
        top = F.greatest(top, F.lit(BYTE_SHARE))
    return (F.col(m) < mid - wide * F.col(f"band.{m}_below")) | (F.col(m) > top)


def judge(documents: DataFrame, byte_bpe: str, piece_bpe: str, **columns: str) -> DataFrame:
    """Measures with base_failed, the measures out of band, and kept."""
    measured = measure(documents, byte_bpe, piece_bpe, **columns).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    names = measured.columns
    measured = materialise(measured.withColumn(
        "class", F.floor(F.log2(F.greatest(F.lit(SHORT), "n_tokens")))))
    fair = measured.where(~F.col("base_failed"))
    # one row for each language or script, and for each of its length classes
    own = _edges(fair, "group", "class").where(F.col("texts") >= LEAST_TEXTS).drop("texts")
    all_ = _edges(fair, "group").drop("texts")
    every = [f"{m}_{e}" for m in MEASURES for e in ("mid", "below", "above")]
    rows = (measured.join(own.select("group", "class", F.struct(*every).alias("own")), ["group", "class"], "left")
            .join(all_.select("group", F.struct(*every).alias("all")), "group", "left")
            .withColumn("band", F.coalesce("own", "all")))
    out_of_band = F.array_compact(F.array(*[F.when(_outside(m), F.lit(m)) for m in MEASURES]))
    return rows.withColumn("out_of_band", out_of_band).select(
        *names, "out_of_band", (~F.col("base_failed") & (F.size("out_of_band") == 0)).alias("kept"))
