"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.session import checkpoint_dir, drop_table, materialize

__all__ = ["checkpoint_dir", "drop_table", "free_name", "materialize", "partitions", "sample_of", "table", "task_cache", "without"]

#: Rows of ids or labels (16 bytes each) up to which a side may be broadcast.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the folder may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame has it (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_of(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of their id, however the rows are stored.

    Only hashes below a bound that few more rows have are sorted, so no task receives more than about that many.
    """
    n = rows.count()
    share = min(1.0, (1.1 * most + 100) / n) if n else 1.0
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 31))
    return rows.where(place < int(share * (1 << 31))).orderBy(place, id_col).limit(most)


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is not in the one column of ``ids``."""
    gone = materialize(ids.toDF("_id").where("_id is not null").distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, docs[id_col] == side["_id"], "left_anti")


def task_cache() -> dict:
    """A per-process dictionary for what tasks load once (a vocabulary, say).

    Functions are shipped by value, so their module's globals are new for every task; a
    module entry of the worker process is not.
    """
    return sys.modules.setdefault("_caseload_task_cache", types.ModuleType("_caseload_task_cache")).__dict__
