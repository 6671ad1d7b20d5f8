"""Session defaults, checkpointing and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "colonnade", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="colonnade-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}/{label}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written below the shared folder and read back: computed once, whatever reads it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 100_000  # rows of a table that one task gets before heavy per-row work


def spread(df: DataFrame, fill: bool = True, rows: int | None = None) -> DataFrame:
    """Deal a table out before heavy per-row work, so that no task gets many more than `rows`
    (TASK_ROWS) rows, however few splits or row groups its files have; with `fill` also so that a table in
    fewer splits than there are cores goes to all cores. What is dealt out like that already is left alone."""
    rows = rows or TASK_ROWS
    held = [r["count"] for r in df.select(F.spark_partition_id().alias("_p")).groupBy("_p").count().collect()]
    wanted = max(-(-sum(held) // rows), df.sparkSession.sparkContext.defaultParallelism if fill else 1)
    return df.repartition(wanted) if (fill and len(held) < wanted) or max(held, default=0) > 2 * rows else df


SHUFFLE, COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
SHUFFLED_ROWS = 250_000  # rows that one task takes from a shuffle


def shuffled_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks after a shuffle of `rows` rows: as many as are set, more where these would get too many rows."""
    return max(int(spark.conf.get(SHUFFLE, "200")), -(-rows // SHUFFLED_ROWS))


@contextmanager
def more_partitions(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs run meanwhile: shuffles into `shuffled_tasks` tasks, so that no task's memory grows with the table."""
    before = {name: spark.conf.get(name, default) for name, default in ((SHUFFLE, "200"), (COALESCE, "true"))}
    spark.conf.set(SHUFFLE, str(shuffled_tasks(spark, rows)))
    spark.conf.set(COALESCE, "false")  # which counts bytes, of which narrow rows have few
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def broadcast_checked(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of one row per class, model or stratum, hinted for broadcast once it is known to
    have at most `most` rows; a longer one is left to a shuffle join, where no key is large."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
