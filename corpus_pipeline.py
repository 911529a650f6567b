"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.

1. toxicity: documents that the learned lexicon scores 0.5 or more go;
2. line_dedup: lines that repeat an earlier one (one word edited at most in
   lines of eight words or more) go; documents stay, also emptied ones;
3. jaccard: of each group of near copies (5-word shingles, Jaccard 0.8 or
   more) the document with the smallest id stays;
4. decontamination: documents that hold a benchmark item go;
5. packing: the rest, as token ids in sequences of 1024.

Rows that repeat a doc_id stay or go together.  Rows without a doc_id are
scored and line-deduplicated but never go as copies.  Null texts pass every
stage and are packed as an end id.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import toxicity as tox
from marketframe.llm.common import materialise, read_documents
from marketframe.llm.decontaminate import contaminated
from marketframe.llm.jaccard_join import jaccard_components
from marketframe.llm.line_dedup import dedup_lines
from marketframe.llm.packing import pack
from marketframe.llm.queries import tokenizer_path, toxicity_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity_lexicon(spark, docs.select("doc_id", "text"), sf_dir)
    # the row travels whole, so its columns cannot clash with the results
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return tox.score(rows, lexicon, texts=False).where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = dedup_lines(rows).select("row", "text")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contaminated(docs, read_documents(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard", jaccard),
          ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the shared
    checkpoint folder."""
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
