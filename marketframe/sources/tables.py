"""Table sources: Parquet scans of the given tables and the nested JSON feed.

Scans are lazy; Catalyst prunes columns and pushes filters into the Parquet
reader, so callers simply select what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.schemas import DRIVER, FEED_DOCUMENT

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


# Columns a spread hashes on: the table's natural row key, so that column
# pruning still reaches the Parquet reader.
SPREAD_KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",),
               "events": ("event_id",)}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """``SELECT * FROM name`` over ``{sf_dir}/{name}.parquet`` (S3: full scan).

    ``spread`` is for fact tables: when the scan yields fewer splits than the
    cluster has cores (e.g. one big file with a single row group), rows are
    spread over ``defaultParallelism`` tasks so that the projection and the
    map-side partial aggregation after it run in parallel.  A large
    input already has many splits and is left alone (no extra shuffle)."""
    reader = spark.read
    if name in DRIVER:          # declared schema: no inference job, no surprises
        reader = reader.schema(DRIVER[name])
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        df = spread_partitions(df, SPREAD_KEYS.get(name))
    return df


def spread_partitions(df: DataFrame, keys=None) -> DataFrame:
    """Spread ``df`` over ``defaultParallelism`` partitions only when it has
    fewer splits than that (deciding needs planning only, no job).  Rows are
    hashed on ``keys`` (default: all columns): deterministic on recomputation
    without the local sort a round-robin repartition needs, and only the key
    columns are forced into the scan.  Only small inputs (fewer splits than
    cores) ever take this path."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *(keys or df.columns))
    return df


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The landed catalog feed ``{"data": [card, ...]}`` as one row per card.

    The schema is declared, never inferred; ``multiLine`` because a landed
    payload is one JSON document per file.  ``inline`` is a generator, so the
    cards of one document stream out without building anything per document.
    """
    docs = spark.read.schema(FEED_DOCUMENT).option("multiLine", "true").json(path)
    return docs.select(F.inline("data"))


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 variant for JSON-lines landings (one card object per line): splits
    freely across tasks, the right layout for very large feeds."""
    from marketframe.schemas import FEED_CARD
    return spark.read.schema(FEED_CARD).json(path)
