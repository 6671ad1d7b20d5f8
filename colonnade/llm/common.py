"""Reading tables and cutting lineage, shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.session import scratch_path

#: One run of the white space that the text contracts name.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows: for tables whose rows are texts or long lists."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


@contextmanager
def uncollected() -> Iterator[None]:
    """No cyclic garbage collection meanwhile: for tasks that make very many small lists and no cycles."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there, and a lost
    executor costs no more than the tasks it ran."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most: int) -> bool:
    """Has `df` at most `most` rows? Reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most


def joined_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = 50_000) -> DataFrame:
    """Join a table that is usually short: broadcast after its rows were counted, shuffled beyond `most`."""
    return left.join(F.broadcast(right) if small_enough(right, most) else right, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


#: Groups with at least one in this many rows (so at most this many groups) are joined by broadcast.
HEAVY_SHARE = 1_000


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` left-joined with one row per `key` of `groups`, whatever the largest group's share.

    Groups of at least 1/HEAVY_SHARE of all `total` rows, of which there can be no more than
    HEAVY_SHARE, are broadcast; their rows, and rows without a key, are then spread for the join
    with the others by shuffle. Adds the columns of `groups` but its key and size.
    """
    extra = [c for c in groups.columns if c not in (key, size)]
    is_heavy, at, to = fresh(rows, "_heavy"), fresh(rows, "_from"), fresh(rows, "_to")
    of_heavy, of_light = ({c: fresh(rows, f"_{kind}_{c}") for c in extra} for kind in ("heavy", "light"))
    heavy = groups.where(F.col(size) * HEAVY_SHARE >= total).select(key, F.lit(True).alias(is_heavy), *[F.col(c).alias(n) for c, n in of_heavy.items()])
    light = groups.where(F.col(size) * HEAVY_SHARE < total).select(F.hex(key).alias(to), *[F.col(c).alias(n) for c, n in of_light.items()])
    first = rows.join(F.broadcast(heavy), key, "left")
    done = F.col(is_heavy).isNotNull() | F.col(key).isNull()
    spread = F.when(done, F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))).otherwise(F.hex(key))
    both = first.withColumn(at, spread).join(light, F.col(at) == F.col(to), "left")
    return both.select(*rows.columns, *[F.when(F.col(is_heavy), F.col(of_heavy[c])).otherwise(F.col(of_light[c])).alias(c) for c in extra])


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): `node`, `component` (its smallest node).

    Alternates large-star and small-star steps, in which every node hands its neighbours to the
    smallest one it knows, until nothing changes. No neighbourhood is gathered in one place: each
    step is a minimum (combined before the shuffle) and a join that may be split at hot nodes.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, seen = staged(pairs, "links"), None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == seen or not found[0]:
            break
        seen = found
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "stars")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
