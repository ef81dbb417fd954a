"""Streaming intake (T1-T3): responses arrive as files, scored cases land in a table.

``readStream`` → parse → state per intake id → ``foreachBatch``. Responses are parsed in the stream. Which
ids were added before is keyed state of the streaming engine (RocksDB, kept with the checkpoint), so a
micro-batch looks up its own ids and never reads the stored table: its cost does not grow with what earlier
batches stored. The state of an id is its first good record with the time of its batch, which the engine logs
with the batch's offsets: a replayed batch sees the same time, the state before it, and so the same records.

Each micro-batch scores and numbers its records after the current maximum and overwrites only its own
``intake_batch=<id>`` partition, so a replayed batch (after a failure between write and commit) replaces its
rows instead of adding them twice. Unparseable responses go to a quarantine table partitioned the same
way. The batch's part of the reports (``operators.partials``) is stored beside the table (``<table>_parts``).

The current maximum number comes from a high-water mark per committed batch (``<table>_hwm``), of which the
latest earlier one is read, not from a scan of the growing case table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseload.operators import partials
from caseload.operators.intake import first_records, parse_responses, parsed_rows, rows_where, score_intake
from caseload.operators.scoring import number_cases
from caseload.session import drop_table, materialize

RESPONSE_SCHEMA = "intake_id bigint, response string"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else every put looks its key up again
}
_BATCH = re.compile(r"intake_batch=(-?\d+)")


def _hwm_path(table_path: str) -> str:
    return table_path.rstrip("/") + "_hwm"


def parts_path(table_path: str) -> str:
    """Where the reports' parts of a stream's table are stored."""
    return table_path.rstrip("/") + "_parts"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written there yet; any other failure is not hidden."""
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The batches with a partition under ``path``, ascending (a folder listing, no file is read)."""
    if not _exists(spark, path):
        return []
    fs, where = _hadoop(spark, path)
    found = [_BATCH.fullmatch(str(s.getPath().getName())) for s in fs.listStatus(where)]
    return sorted(int(m[1]) for m in found if m)


def _existing_max(spark: SparkSession, table_path: str, batch_id: int, start_number: int = 0) -> int:
    """Highest number handed out by the batches before ``batch_id`` (``start_number`` when none)."""
    path = _hwm_path(table_path)
    earlier = [b for b in _batches(spark, path) if b < batch_id]
    if not earlier:
        return start_number
    row = spark.read.schema("max_num bigint").parquet(f"{path}/intake_batch={earlier[-1]}").first()
    return max(row[0], start_number)


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("intake_batch", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("intake_batch").parquet(path))


def commit_batch(parsed: DataFrame, batch_id: int, table_path: str, quarantine_path: str, start_number: int = 0,
                 on_commit: Callable[[DataFrame], None] | None = None) -> None:
    """Quarantine, score, number and write one micro-batch idempotently.

    ``parsed`` holds the malformed responses and the records to add, each once. It is written once, into the
    checkpoint folder, and removed at the end. ``on_commit`` gets the table after the batch, also
    when the batch added nothing.
    """
    spark = parsed.sparkSession
    parsed = materialize(parsed)
    _write(parsed.where(~F.col("parse_ok")).select("intake_id", "response"), quarantine_path, batch_id)
    base = _existing_max(spark, table_path, batch_id, start_number)
    scored = score_intake(parsed)
    numbered = number_cases(scored, order_by=["intake_id", "family_id"], start=base + 1, tie=[])
    _write(numbered, table_path, batch_id)
    partials.store(scored, parts_path(table_path), batch_id)
    added = parsed.where("parse_ok").agg((F.count(F.lit(1)) + F.lit(base)).cast("bigint").alias("max_num"))
    _write(added, _hwm_path(table_path), batch_id)
    if on_commit is not None:
        on_commit(spark.read.schema(f"{_ddl(numbered)}, intake_batch bigint").parquet(table_path))
    drop_table(parsed)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {dtype}" for name, dtype in df.dtypes)


def process_batch(batch: DataFrame, batch_id: int, table_path: str, quarantine_path: str,
                  start_number: int = 0, on_commit: Callable[[DataFrame], None] | None = None) -> None:
    """Add one batch of responses that does not come from a running stream (a backfill, a replay by hand).

    ``start_number`` is the highest number already in use before the stream
    (e.g. the survey case table's maximum); intake numbers continue after it.
    Without the stream's state, an ``intake_id`` that another batch stored is found in the
    table's id column. The rule is the same as the stream's: ``intake.first_records``.
    """
    spark = batch.sparkSession
    parsed = materialize(parse_responses(batch))
    records = first_records(parsed)
    if _exists(spark, table_path):
        stored = spark.read.schema("intake_id bigint, intake_batch bigint").parquet(table_path)
        records = records.join(stored.where(F.col("intake_batch") != F.lit(batch_id)).select("intake_id"), "intake_id", "left_anti")
    rows = records.unionByName(parsed.where(~F.col("parse_ok")))
    commit_batch(rows, batch_id, table_path, quarantine_path, start_number, on_commit)
    drop_table(parsed)


def new_records(responses: DataFrame) -> DataFrame:
    """Of a stream of responses: the malformed ones, those without id, and of every id the first good record.

    The state of an id is the smallest (batch time, digest of the response) with its record. An id is
    emitted by the batch whose time its state holds; later ones with that id only look it up.
    """
    parsed = parse_responses(responses)
    columns = [c for c in parsed.columns if c not in ("intake_id", "response", "parse_ok")]
    known = parse_responses(responses.where("intake_id is not null"))
    good = parsed_rows(known).withColumn("_arrival", F.current_timestamp())
    record = F.struct("_arrival", F.sha2("response", 256).alias("_digest"), *columns)
    first = good.groupBy("intake_id").agg(F.min(record).alias("_first")).where(F.col("_first._arrival") == F.current_timestamp())
    fresh = first.select("intake_id", F.lit(None).cast("string").alias("response"), F.lit(True).alias("parse_ok"),
                         *[F.col("_first")[c].alias(c) for c in columns])
    return fresh.unionByName(rows_where(parsed, F.col("intake_id").isNull() | ~F.col("parse_ok")))


def start_stream(spark: SparkSession, source_dir: str, table_path: str, quarantine_path: str,
                 checkpoint_location: str, fmt: str = "parquet", trigger: dict | None = None,
                 start_number: int = 0, on_commit: Callable[[DataFrame], None] | None = None,
                 source_options: dict | None = None, caseload: DataFrame | None = None) -> StreamingQuery:
    """Start the intake stream over files of (intake_id, response) in ``source_dir``.

    ``source_options`` go to the file source (e.g. ``maxFilesPerTrigger`` to bound a micro-batch).
    ``caseload`` is the case table before the stream: its part of the reports is stored once, as batch
    ``partials.BASE_BATCH``. A table that another checkpoint's stream wrote is refused, as its ids are not in the state.
    """
    if not _exists(spark, checkpoint_location) and _batches(spark, table_path):
        raise ValueError(f"{table_path} holds rows of a stream with another checkpoint than {checkpoint_location}")
    parts = parts_path(table_path)
    if caseload is not None and partials.BASE_BATCH not in _batches(spark, f"{parts}/cities"):
        partials.store(caseload, parts, partials.BASE_BATCH)
    source = (spark.readStream.schema(RESPONSE_SCHEMA).format(fmt).options(**(source_options or {}))
              .load(source_dir))
    writer = (new_records(source).writeStream.outputMode("update")
              .foreachBatch(lambda df, bid: commit_batch(df, bid, table_path, quarantine_path,
                                                         start_number=start_number, on_commit=on_commit))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():  # the query keeps the settings that it starts with
        spark.conf.set(key, value)
    try:
        return writer.start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
