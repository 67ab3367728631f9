"""What the operators of this subpackage share: tables, checkpoints, splits and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: few, since one text may be very long.
BATCH_ROWS = 500
#: Rows of a frame of keys (some tens of bytes each) that may be broadcast; beyond it, a shuffle join runs.
BROADCAST_ROWS = 400_000


#: Tables that this session has written for its steps.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small; a session that has its own setting keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them can read")
        given = tempfile.mkdtemp(prefix="ledgerframe-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def stash(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its readers survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide rows that later steps read by column."""
    path = f"{shared_dir(df.sparkSession)}/ledgerframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that written() made in this session, and says how many: for a caller who has stored what it read from them."""
    gone = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows; otherwise left to a shuffle join. df must be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remainder(key: str | Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by)).cast("int")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, as one table, from batches that are sorted by the keys."""
    held: list[pa.Table] = []
    current: tuple | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rows = list(zip(*(part[k].to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and current != rows[start]:
                yield current, pa.concat_tables(held)
                held = []
            current = rows[start]
            held.append(part.slice(start, i - start))
            start = i
    if held:
        yield current, pa.concat_tables(held)
