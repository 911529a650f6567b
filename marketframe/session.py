"""Session construction and the shared checkpoint folder.

On a cluster the session is created by the platform; ``get_spark`` only
fills in settings that are still unset, so cluster settings always win.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied when the caller has not set them.  They describe the
# plan shape we want at any scale: AQE re-plans joins and coalesces or
# splits skewed shuffle partitions at run time; broadcast happens only
# below a size threshold that Spark checks from statistics / shuffle sizes.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    # list state and timers of the streaming operators
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # checkpoint files of lineage cuts are removed once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def _platform_keys() -> set[str]:
    """Settings that the installation's ``spark-defaults.conf`` already makes."""
    home = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    path = os.path.join(home, "spark-defaults.conf")
    if not os.path.isfile(path):
        return set()
    with open(path, encoding="utf-8") as f:
        return {line.split()[0] for line in f if line.strip() and not line.lstrip().startswith("#")}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "marketframe") -> SparkSession:
    """Return the active session or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        if key not in _platform_keys():
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MF_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there and we only read it.
    When it is unset, a local master (tests) gets a fresh scratch folder; on a
    cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = tempfile.mkdtemp(prefix="mf-ckpt-", dir=os.environ.get("MF_SCRATCH", "/tmp"))
    sc.setCheckpointDir(current)
    return current


# A shuffle of a written table starts with a partition for so many bytes of
# its sources, and small ones are merged up to so many bytes of shuffle.
_SOURCE_BYTES, _SHUFFLE_BYTES = 4 << 20, 16 << 20


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as far as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


@contextlib.contextmanager
def written_shuffles(df: DataFrame):
    """Settings for writing ``df``: enough shuffle partitions that a task sorts
    its rows in memory, whatever the size (adaptive execution merges small
    ones), and Spark removes the shuffle files when the write ends, not when
    the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    parse = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    new = {initial: max(int(conf.get(initial, None) or conf.get("spark.sql.shuffle.partitions")),
                        source_bytes(df) // _SOURCE_BYTES),
           merged: min(parse(conf.get(merged)), _SHUFFLE_BYTES),
           "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: conf.get(k, None) for k in new}
    for k, v in new.items():
        conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once into the shared checkpoint folder as Parquet and
    read back, and its folder."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with written_shuffles(df):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def drop_written(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ``written`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
