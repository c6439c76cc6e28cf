"""Logs that streams append to, and the tables they keep: day partitions, no state in the stream.

A log holds ``day=D/stream=S/batch=B`` folders.  A micro-batch adds only rows whose
key the log's same days don't hold yet: one anti-join with the key columns of
those days.  So a payload that comes twice is stored once however late it comes
again, a late poll is never dropped, and nothing is kept in the stream's state:
what bounds the work of a batch is the days it touches.

The stream's id comes from its checkpoint, so a replayed batch finds its own folders
again and overwrites them; rows of its earlier attempt don't count as known.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLL_KEY = ("city", "ts", "event_id")
#: The day of rows without a time.
NO_DAY = "none"
PARTS = ("day", "stream", "batch")


def day_of(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NO_DAY))


def stream_id(spark: SparkSession) -> str:
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of what matches a glob on the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in (found or []))


def log_days(spark: SparkSession, path: str) -> list[str]:
    """Days that a log has folders of."""
    return [os.path.basename(p).split("=", 1)[1] for p in _folders(spark, f"{path}/day=*")]


def _schema(rows: DataFrame) -> str:
    """Schema of a log of ``rows``, with text as the type of its days and streams."""
    kept = [f"`{name}` {kind}" for name, kind in rows.dtypes if name not in PARTS]
    return ", ".join([*kept, "day string", "stream string", "batch long"])


#: Up to so many days a log's folders are asked for one by one, then its days are listed once.
FEW_DAYS = 16
#: Rows of a day that go into one file.
FILE_ROWS = 500_000
#: Tasks that list the folders of a log.
LISTING_TASKS = 48


def listed_in_lots(spark: SparkSession) -> None:
    """List many folders in a few tasks; Spark would start one for each."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(tasks)) > LISTING_TASKS:
        spark.conf.set(tasks, str(LISTING_TASKS))


def read_days(spark: SparkSession, path: str, days: Sequence[str], schema: str) -> DataFrame | None:
    """The rows of some days of a log (only their folders are read); null if it has none of them."""
    listed_in_lots(spark)
    if len(days) <= FEW_DAYS:
        found = [p for day in days for p in _folders(spark, f"{path}/day={day}")]
    else:
        have = set(log_days(spark, path))
        found = [f"{path}/day={day}" for day in days if day in have]
        if len(found) == len(have) > 0:            # all of them: one folder to list instead of each
            return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("basePath", path).parquet(*found) if found else None


def by_day(rows: DataFrame, counts: dict, key: Sequence[str] = POLL_KEY) -> DataFrame:
    """Rows (with their ``day``) dealt for writing: those of a day to one task, a day of many rows to several.

    ``counts`` has the rows of each day, or more; days it lacks are one task each.
    """
    many = {day: -(-n // FILE_ROWS) for day, n in counts.items() if n > FILE_ROWS}
    share = F.lit(0)
    if many:
        shares = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("day")), F.lit(1))
        share = F.pmod(F.xxhash64(*key), shares.cast("long")).cast("int")
    return rows.withColumn("_share", share).repartition("day", "_share").drop("_share")


def day_counts(rows: DataFrame) -> dict:
    """Rows of each day: at most the calendar's days reach the driver."""
    return {r["day"]: r["count"] for r in rows.groupBy("day").count().collect()}


def new_rows(rows: DataFrame, batch_id: int, path: str, key: Sequence[str] = POLL_KEY,
             counts: dict | None = None) -> DataFrame:
    """Rows (with their ``day``) whose key neither the batch before them nor the log's same days hold.

    ``rows`` are read for their days (unless ``counts`` has them), then once more: a cached
    batch.  They come dealt by day, so that a task writes few folders and a hot day is many tasks.
    """
    spark = rows.sparkSession
    counts = day_counts(rows) if counts is None else counts
    # one key of all columns, which may be null: rows and log are dealt by it once
    whole = F.struct(*[F.col(c) for c in ("day", *key)])
    rows = rows.withColumn("_key", whole).dropDuplicates(["_key"])
    known = read_days(spark, path, sorted(counts), _schema(rows.drop("_key")))
    if known is not None:
        known = known.where(~((F.col("stream") == stream_id(spark)) & (F.col("batch") == batch_id)))
        rows = rows.join(known.select(whole.alias("_known")), F.col("_key") == F.col("_known"), "left_anti")
    return by_day(rows.drop("_key"), counts, key)


def append(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write rows (with their ``day``) as the folders of this stream's batch; a replay overwrites them."""
    spark = rows.sparkSession
    (rows.withColumns({"stream": F.lit(stream_id(spark)), "batch": F.lit(int(batch_id)).cast("long")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path))


def append_batches(path: str, build: Callable[[DataFrame], DataFrame] | None = None,
                   key: Sequence[str] = POLL_KEY):
    """``foreachBatch`` function: the rows that ``build`` makes of each batch, new ones only, into a log by day."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (build or (lambda b: b))(batch).withColumn("day", day_of("ts"))
        rows.persist()
        try:
            append(new_rows(rows, batch_id, path, key), batch_id, path)
        finally:
            rows.unpersist()
    return write


# ------------------------------------------------------------------ versioned tables

#: Complete versions of a table that are kept: readers of the last ones may still be at work.
KEEP_VERSIONS = 3


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are complete, oldest first."""
    done = _folders(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(os.path.basename(os.path.dirname(p)).split("=")[1]) for p in done)


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Write ``df`` as the next version of a table, which readers see when it is complete; its folder."""
    spark = df.sparkSession
    have = versions(spark, path)
    folder = f"{path}/version={max(have, default=-1) + 1}"
    (write or (lambda d, p: d.write.mode("overwrite").parquet(p)))(df, folder)
    for old in have[:-KEEP_VERSIONS]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return folder


def read_newest(spark: SparkSession, path: str) -> DataFrame | None:
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/version={have[-1]}") if have else None


class Snapshot:
    """A table as a stream's batches see it: loaded again when there is a newer version.

    ``path`` holds published versions, or one plain Parquet table that is overwritten
    as a whole (its version is then the time of its ``_SUCCESS`` file).  ``derive``
    reduces a version once, when it is loaded; the result is written to the
    checkpoint folder, so that each batch reads only the reduced rows.
    """

    def __init__(self, spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.derive = spark, path.rstrip("/"), derive
        self.version, self.rows = None, None

    def newest(self) -> tuple[str, object]:
        """Folder and version of what a batch should read now."""
        have = versions(self.spark, self.path)
        if have:
            return f"{self.path}/version={have[-1]}", have[-1]
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        fs = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(done):
            raise FileNotFoundError(f"no complete table in {self.path}")
        return self.path, f"written {fs.getFileStatus(done).getModificationTime()}"

    def current(self) -> DataFrame:
        from ..session import reliable_checkpoint
        folder, version = self.newest()
        if version != self.version:
            self.rows = reliable_checkpoint(self.derive(self.spark.read.parquet(folder)))
            self.version = version
        return self.rows
