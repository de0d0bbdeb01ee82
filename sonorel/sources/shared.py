"""Places in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only where the session names none (tests, a laptop), a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sonorel-"))
        named = _own[0]
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder: computed once, its lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows up to which a side of a join is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are sure to be few; else as it is, for a shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
