"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "caseload") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CASELOAD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session (``spark.checkpoint.dir``).

    A single-process session (``local``, ``local[n]``) without one gets a scratch folder that is
    removed at exit. Anything else, ``local-cluster[...]`` included, must name a shared folder: a
    machine-local one would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc else None) or current
    master = sc.master if sc else spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)")
    scratch = tempfile.mkdtemp(prefix="caseload-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    if sc:
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir()
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


#: Bytes of an Arrow batch that a stored table's Python steps receive, unless the session sets its own. Spark's
#: default (10,000 rows of any width) is held several times over by the executor and each of its Python workers.
BATCH_BYTES = str(2 << 20)
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Unlike ``checkpoint()`` (row-serialised files), a Parquet table lets the
    next steps read only the columns they need, and it is a plain file scan
    when a later query reads it twice. ``by`` partitions the folder by a column.
    ``drop_table`` removes the files of a table that no later step reads.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    schema = df.schema
    own = spark.conf.get(_BATCH_BYTES_KEY, None) is not None
    if not own:
        spark.conf.set(_BATCH_BYTES_KEY, BATCH_BYTES)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if not own:
            spark.conf.unset(_BATCH_BYTES_KEY)
    out = spark.read.schema(schema).parquet(path)
    out._caseload_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any Hadoop file system, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a frame that ``materialize`` returned."""
    remove(df.sparkSession, df._caseload_path)


def scale_settings(families: int, total_cores: int, row_bytes: int = 256,
                   partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Session settings for a caseload of ``families`` rows on ``total_cores`` executor cores.

    Every exchange of the library is keyed on the family and carries at most
    one row per family per map task after partial aggregation, so shuffle
    volume scales with the case table, not with the raw child tables:

    * shuffle partitions: about ``partition_bytes`` of case rows each
      (``families * row_bytes / partition_bytes``), at least two waves of the
      cores, rounded to whole waves; AQE then merges small partitions and splits
      skewed join partitions;
    * scan splits of ``partition_bytes`` (Parquet splits at row groups, so write
      the survey tables with row groups of about that size);
    * broadcast joins only below Spark's 10 MB size check; the library itself
      broadcasts nothing that grows with the data.
    """
    partitions = max(2 * total_cores, -(-families * row_bytes // partition_bytes))
    partitions = -(-partitions // total_cores) * total_cores
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(10 << 20),
        "spark.sql.session.timeZone": "UTC",
    }
