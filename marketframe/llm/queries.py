"""Registered queries of this package: one per operator, each over its whole
table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import read_documents

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def oracle_queries() -> dict[str, str]:
    from marketframe.llm.oracle import SQL
    return dict(SQL)


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.jaccard_join import jaccard_components
    return jaccard_components(read_documents(spark, sf_dir)).select(
        "doc_id", F.col("n_shingles").cast("long"), "component_id")


def toxicity_lexicon(spark: SparkSession, documents: DataFrame, sf_dir: str):
    """The lexicon learned from the labelled rows that are not held out."""
    from marketframe.llm import toxicity
    labels = read_documents(spark, sf_dir, "labels")
    return toxicity.learn(documents, labels.where(toxicity.remainder() != 0))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm import toxicity
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity_lexicon(spark, docs, sf_dir)
    return toxicity.score(docs, lexicon, texts=False).select(
        "doc_id", (toxicity.remainder() == 0).alias("held_out"), "score", "predicted", "n_matches")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.line_dedup import dedup_lines
    return dedup_lines(read_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.decontaminate import contaminated
    return contaminated(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; the file stays outside the repository."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.packing import pack
    return pack(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                {"ids_crc32": F.crc32("ids")})


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.token_files import round_trip
    return round_trip(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.secret_scan import digest, scan
    return digest(scan(read_documents(spark, sf_dir), F.col("source"), F.struct("source", "lang")))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.html_wrapper import extract
    return extract(read_documents(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.fertility import MEASURES, judge
    judged = judge(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                   tokenizer_path("piece_bpe_32k.model"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_tokens", *[F.round(m, 4).alias(m) for m in MEASURES])


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.substring_dedup import remove_repeats
    out = remove_repeats(read_documents(spark, sf_dir))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.periodic_runs import digest, find_runs, repeated_tail
    return digest(find_runs(read_documents(spark, sf_dir), order=repeated_tail))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.vector_codes import compress, digest
    return digest(*compress(read_documents(spark, sf_dir, "embeddings")))


@query
def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketframe.llm.bit_sliced_search import nearest
    return nearest(read_documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
