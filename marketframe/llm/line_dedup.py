"""Line dedup: near-equal lines joined by deletion neighbourhoods, the
earliest kept.  DataFrame functions only.

A line is its words (lower case).  Lines of ``min_words`` words or more are
duplicates when at most one word was changed, added or left out (edit
distance 1 over words); shorter lines only when equal.  A line goes when a
line that comes earlier (by doc_id, then place) is its duplicate; blank lines
stay.

1. Equal lines collapse to their earliest place (a grouped minimum, combined
   before the shuffle, so a line on a third of all rows is one row a task).
2. One edit leaves the first or the second half of a line unchanged.  Only
   lines that have a half in common with a different line go on.
3. Each such line emits, for every place i, two keys: the hash of what comes
   before and after word i (word i deleted), and of what comes before and
   after the gap at i (nothing deleted), each with the length left.  Lines
   that share a key differ at one place at most, so the whole group of a key
   lies within the bound of its earliest line and no pairs are formed: each
   line is compared with the group's minimum only.
4. The edit distance of line and minimum is verified on the words.

Defined results: null text has no lines and comes back null; an empty text
comes back empty; several rows with one ``doc_id`` are ordered by the hash of
their text (fully equal rows are one document and come back alike); rows
without a doc_id come first and take part with their equal lines only, while
other rows' lines are compared as if those rows were not there, but for equal
ones; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import materialise, runtime_filter, selected

#: Lines with fewer words are duplicates only when equal.
MIN_WORDS = 8
_BLANKS = "\t\x0B\f\r"


def _lines(text: Column) -> Column:
    """Lines of a text, other white space made spaces where there is any."""
    odd = text.contains(_BLANKS[0])
    for c in _BLANKS[1:]:
        odd = odd | text.contains(c)
    return F.split(F.when(odd, F.translate(text, _BLANKS, " " * len(_BLANKS))).otherwise(text), "\n")


def _normal(line: Column) -> Column:
    """The words of a line in lower case with one space between them."""
    low = F.lower(line)
    uneven = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(uneven, F.trim(F.regexp_replace(low, " +", " "))).otherwise(low)


def _halves(line: Column, n: Column) -> Column:
    """Keys of the half of a normal line that one edit leaves unchanged, each
    with the places where the edit can then be.  ``h`` words from either end,
    ``h`` the largest power of two up to half the length; also with the ``h`` of
    a line one word shorter, so that partners agree."""
    def half(n):
        return F.pow(F.lit(2), F.floor(F.log2(n / 2))).cast("int")

    def pair(h):
        def end(count):
            return F.call_function("substring_index", line, F.lit(" "), count)
        return [F.struct(F.xxhash64(F.lit(0), h, end(h)).alias("half"),
                         h.alias("lo"), n.alias("hi")),
                F.struct(F.xxhash64(F.lit(1), h, end(-h)).alias("half"),
                         F.lit(0).alias("lo"), (n - h).alias("hi"))]
    long, short = half(n), half(n - 1)
    return F.when(long == short, F.array(*pair(long))).otherwise(F.array(*pair(long), *pair(short)))


#: Words of a block of running hashes.
_BLOCK = 16


def _heads(w: Column) -> Column:
    """Running hashes at the first word of every block of words."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / _BLOCK).cast("int")),
                         lambda j: F.xxhash64(F.slice(w, j * _BLOCK + 1, F.lit(_BLOCK))))
    seed = F.array(F.lit(0).cast("long"))
    return F.aggregate(blocks, seed, lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))


def _running(w: Column, heads: Column, places: Column) -> Column:
    """Hash of the words before each place: the block's running hash and the
    few words since, so the work is linear but for one entry a block."""
    def at(i):
        block = F.floor(i / _BLOCK).cast("int")
        return F.xxhash64(F.element_at(heads, block + 1), F.slice(w, block * _BLOCK + 1, i - block * _BLOCK))
    return F.transform(places, at)


def _variants(lo: Column, hi: Column) -> Column:
    """Hashed keys of the deletion neighbourhood for edits at places ``lo`` to
    ``hi``: one for each word left out and one for each gap, from the hashes of
    the words before a place and, in reverse, of those after it.  The columns
    ``words``, ``back`` (reversed), ``heads`` and ``tails`` are read."""
    n = F.size("words")
    before = _running(F.col("words"), F.col("heads"), F.sequence(lo, hi))
    after = _running(F.col("back"), F.col("tails"), F.sequence(n - lo, n - hi, F.lit(-1)))
    # (before, after) of each gap, zipped so that each hash is worked out once;
    # a word left out has the gap before it on one side, the next gap on the other
    gaps = F.zip_with(before, after, lambda b, a: F.xxhash64(b, a, n))
    gone = F.zip_with(F.slice(before, F.lit(1), hi - lo), F.slice(after, F.lit(2), hi - lo),
                      lambda b, a: F.xxhash64(b, a, n - 1))
    return F.concat(gone, gaps)


def _within_one(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays is at most 1."""
    n, m = F.size(a), F.size(b)
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)) <= 1
    def without(long, short):
        # the first differing place of the longer one left out
        at = F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        return F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.size(long))) == short
    return (F.when(n == m, changed).when(n == m + 1, without(a, b)).when(m == n + 1, without(b, a))
            .otherwise(F.lit(False)))


def _places(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with a word: where it is (``at``: doc_id, hash of the whole
    text, place), normalised, and its number of words."""
    line = (documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"),
                             F.posexplode(_lines(F.col(text_col))).alias("place", "raw"))
            # a condition on the normal line would normalise every line twice
            .where(F.trim("raw") != "")
            .select(F.struct("doc_id", "row", "place").alias("at"), _normal(F.col("raw")).alias("line")))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return line.withColumn("n_words", spaces + 1)


def _line_id(line: Column) -> list[Column]:
    """128-bit hash of a normalised line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]


def duplicate_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, row, place) of every line that goes."""
    places = _places(documents, id_col, text_col)
    long = F.col("n_words") >= min_words
    lines = materialise(places.select(
        "at", *_line_id(F.col("line")), "n_words", F.when(long, _halves(F.col("line"), F.col("n_words"))).alias("halves")))
    named = F.when(F.col("at.doc_id").isNotNull(), F.col("at"))
    first = materialise(lines.groupBy("a", "b").agg(F.min("at").alias("first"), F.min(named).alias("named"),
                                                    F.count("*").alias("n")))

    # lines that have a half in common with a different line
    halves = lines.where(long).select("a", "b", F.inline("halves"))
    common = materialise(halves.groupBy("half").agg(F.min("a").alias("least"), F.max("a").alias("most"))
                         .where("least <> most").select("half"))
    with runtime_filter(documents.sparkSession):
        similar = materialise(halves.join(common, "half", "left_semi").groupBy("a", "b")
                              .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        at_first = materialise(similar.join(first.where("named is not null").select("a", "b", F.col("named").alias("at")),
                                            ["a", "b"]))
        ids = materialise(at_first.select(F.col("at.doc_id").alias("doc_id")).distinct())
        docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        texts = docs.join(selected(ids, "doc_id").withColumnRenamed("doc_id", "_id"),
                          F.col("doc_id") == F.col("_id"), "left_semi")
        words = F.split("line", " ")
        # rows equal in id and text are one document
        left = materialise(_places(texts, "doc_id", "text").join(at_first, "at").dropDuplicates(["a", "b"])
                           .select("a", "b", "at", "lo", "hi", words.alias("words"), F.reverse(words).alias("back")))
        left = materialise(left.withColumn("heads", _heads(F.col("words"))).withColumn("tails", _heads(F.col("back"))))

    # variants that different lines share, then the earliest line of each; the
    # rest of its group lies within the bound
    keyed = materialise(left.select(F.explode(_variants(F.col("lo"), F.col("hi"))).alias("key"), "a"))
    shared = materialise(keyed.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most"))
                         .where("least <> most").select("key"))
    hits = materialise(keyed.join(shared, "key", "left_semi").join(left.select("a", "b", "at"), "a"))
    lowest = hits.groupBy("key").agg(F.min(F.struct("at", "a", "b")).alias("low"))
    found = (hits.join(lowest, "key").where(F.col("at") != F.col("low.at"))
             .select("a", "b", F.col("low.a").alias("a2"), F.col("low.b").alias("b2")).distinct())
    words = left.select("a", "b", "words")
    near = (found.join(words, ["a", "b"])
            .join(words.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("words2")),
                  ["a2", "b2"])
            .where(_within_one(F.col("words"), F.col("words2"))).select("a", "b").distinct())
    near = materialise(near.withColumn("near", F.lit(True)))
    gone = (first.join(near, ["a", "b"], "left").where("n > 1 or near")
            .select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near")))
    goes = (F.col("at") != F.col("first")) | (F.col("near") & F.col("at.doc_id").isNotNull())
    return lines.select("at", "a", "b").join(gone, ["a", "b"]).where(goes).select("at.*")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``documents`` with repeated lines taken out of the text, plus n_lines
    (lines of the input text) and n_removed."""
    gone = (duplicate_lines(documents, min_words, id_col, text_col)
            .groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
            .agg(F.collect_set("place").alias("_gone")))
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    # the row travels as one struct, so its columns cannot clash with others
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                            F.xxhash64(text_col).alias("_hash"), F.struct(*names).alias("doc"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names],
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                      F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
