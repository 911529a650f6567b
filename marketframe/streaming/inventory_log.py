"""A log-structured keyed table: every change set writes only the rows it
touched, and the newest version of a row wins on read.

Layout under ``root`` (Parquet, on whatever shared file system the cluster uses)::

    data/kind=base/version=V/bucket=B/     whole table as of version V
    data/kind=delta/version=V/bucket=B/    rows changed by version V
    manifest/                              one row per commit, written last

* Rows carry a bucket, the hash of their key modulo the buckets, so the rows
  that a change set meets are looked up in the buckets that it names only.
* The data folder is a Spark table bucketed by the key into ``parts`` (a multiple
  of the buckets): every version is dealt alike, so reading, compaction and the
  join of stored rows with a change set move no stored row.  The catalog entry names the folder only and is made anew by
  whoever opens it.
* A commit writes its data folder, then one manifest row.  Readers see folders
  that the manifest lists, so a half-written version does not exist, and a
  version that is listed already is not applied again: a replayed micro-batch
  changes nothing.
* A read takes the newest base and the deltas after it and keeps, for every key,
  the row of the highest version: one grouped ``max_by`` inside each part.
* Compaction writes a new base.  It is due once the deltas hold half as many
  rows as the base, so the rows written in all stay within a constant factor of
  the rows changed.

One writer at a time (as in a streaming query); any number of readers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; an existing one keeps its own number.
BUCKETS = 64
#: Share of the base's rows from which the deltas are compacted.
COMPACT_SHARE = 0.5
MANIFEST = "kind string, version long, rows long, buckets int, parts int"


class KeyedLog:
    """Table of ``schema`` with unique ``keys`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str],
                 buckets: int = BUCKETS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.schema = schema
        # one writer: what it commits itself is all that is new
        self.known = self.commits()
        if any(c.parts is None for c in self.known):
            raise ValueError(f"{self.root} was written without parts; its rows must be loaded anew")
        at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets, self.parts = ((self.known[0].buckets, self.known[0].parts) if self.known
                                    else (buckets, -(-at_once // buckets) * buckets))
        self.table = f"keyed_log_{hashlib.sha256(self.root.encode()).hexdigest()[:24]}"
        self._declare()

    def _declare(self) -> None:
        """Name the data folder in the catalog; its partitions are found by listing."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        folder = self.root.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} ({columns}, kind string, version bigint, bucket int)
            USING parquet PARTITIONED BY (kind, version, bucket) CLUSTERED BY ({keys}) INTO {self.parts} BUCKETS
            LOCATION '{folder}/data'""")
        if self.known:
            self.spark.catalog.recoverPartitions(self.table)

    # ---- manifest ------------------------------------------------------------
    def commits(self) -> list[Row]:
        """(kind, version, rows, buckets) of every commit: a few numbers per
        change set."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").distinct().collect()
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":   # anything else is a real failure
                raise
            return []                                   # no commit yet

    def _live(self, before: int | None = None):
        """(newest base, deltas after it) of the commits older than ``before``."""
        known = [c for c in self.known if before is None or c.version < before]
        bases = sorted((c for c in known if c.kind == "base"), key=lambda c: c.version)
        if not bases:
            raise FileNotFoundError(f"no committed table under {self.root}")
        return bases[-1], [c for c in known if c.kind == "delta" and c.version > bases[-1].version]

    # ---- reading -------------------------------------------------------------
    def _bucket(self) -> Column:
        # Spark's own bucket hash, so a bucket is a whole number of parts
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows``, shuffled as the stored ones are: joins on the keys move neither side."""
        return rows.repartition(self.parts, *self.keys)

    def _versions(self, before: int | None, buckets: list[int] | None) -> DataFrame:
        base, deltas = self._live(before)
        rows = self.spark.table(self.table)
        # partition filters: only the listed folders are opened
        listed = (F.col("kind") == "base") & (F.col("version") == base.version)
        if deltas:
            listed = listed | ((F.col("kind") == "delta") & F.col("version").isin([c.version for c in deltas]))
        rows = rows.where(listed)
        return rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the newest commit (older than ``before``)."""
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        newest = self._versions(before, buckets).groupBy(*self.keys).agg(
            F.max_by(F.struct(*rest), "version").alias("_row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col("_row")[c].alias(c) for c in self.schema.names])

    def stored(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows of the given keys, from the buckets that hold them."""
        keys = keys.select(*self.keys)
        # at most as many numbers as buckets
        named = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return self.read(before, named).join(keys, self.keys, "left_semi")

    # ---- writing -------------------------------------------------------------
    def _commit(self, kind: str, version: int, rows: DataFrame) -> None:
        """``rows`` dealt as the stored ones make one file a part."""
        written = Observation()
        # counted in the writing pass; whatever an uncommitted writer left there is replaced
        folder = f"{self.table}_{kind}_{version}".replace("-", "_")
        (rows.select(*self.schema.names, self._bucket().alias("bucket"))
             .observe(written, F.count("*").alias("rows"))
             .write.mode("overwrite").partitionBy("bucket").bucketBy(self.parts, *self.keys)
             .option("path", f"{self.root}/data/kind={kind}/version={version}").saveAsTable(folder))
        self.spark.sql(f"DROP TABLE {folder}")                # its files stay, as partitions of the whole
        self.spark.catalog.recoverPartitions(self.table)
        commit = Row(kind=kind, version=version, rows=written.get["rows"], buckets=self.buckets, parts=self.parts)
        self.spark.createDataFrame([commit], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self.known.append(commit)

    def create(self, rows: DataFrame) -> None:
        """The first base, version -1; nothing if there is one already."""
        if not any(c.kind == "base" for c in self.known):
            self._commit("base", -1, self.dealt(rows))

    def committed(self, version: int) -> bool:
        return any(c.kind == "delta" and c.version == version for c in self.known)

    def apply(self, version: int, changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Commit the rows that ``change`` makes of the stored rows with the
        keys of ``changes``; False if ``version`` is committed already."""
        if self.committed(version):
            return False
        self._commit("delta", version, self.dealt(change(self.stored(changes, before=version))))
        return True

    def compact(self, always: bool = False) -> bool:
        """Write a new base if the deltas have grown enough."""
        base, deltas = self._live()
        if not deltas or not (always or sum(c.rows for c in deltas) > COMPACT_SHARE * base.rows):
            return False
        self._commit("base", max(c.version for c in deltas), self.read())
        return True
