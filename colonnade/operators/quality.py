"""Data-quality profiling: cardinality, missing / special values, duplicates, schema."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from colonnade.columns import col, is_float, is_missing, literal_rows, long_values, numeric_columns, present
from colonnade.operators.ordering import skew_join

SKETCH_REGISTERS = 512  # registers of the HyperLogLog++ sketch at its default error of 5 %


def approximate_cardinalities(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """One sketch per column in one scan; the driver receives a single row."""
    if not columns:
        return {}
    sketches = [F.approx_count_distinct(present(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(*sketches).first()
    return {c: row[i] for i, c in enumerate(columns)}


def maybe_few_values(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """Drop the columns that provably hold more than `limit` values.

    With k distinct values at most k sketch registers are non-zero, so linear counting
    cannot estimate more than m*ln(m/(m-k)). Whatever lies above is out, without an
    exact (shuffling) count; the survivors are counted exactly by the caller.
    """
    if limit > 200 or not columns:
        return list(columns)
    bound = SKETCH_REGISTERS * math.log(SKETCH_REGISTERS / (SKETCH_REGISTERS - limit)) + 1
    estimates = approximate_cardinalities(df, columns)
    return [c for c in columns if estimates[c] <= bound]


def value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) without nulls: one scan, map-side combined, one shuffle."""
    if not columns:
        return literal_rows(df.sparkSession, [], "column string, value string, n bigint")
    return (
        long_values(df, list(columns)).where("value is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def unique_counts(
    df: DataFrame, max_unique: int | None = 20, drop_features: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """(column, n_unique) of the columns with at most `max_unique` distinct non-null values."""
    names = [c for c in (columns or df.columns) if c not in drop_features]
    if max_unique is not None:
        names = maybe_few_values(df, names, max_unique)
    if not names:
        return literal_rows(df.sparkSession, [], "column string, n_unique bigint")
    counted = value_profile(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    listed = literal_rows(df.sparkSession, [(n,) for n in names], "column string")
    full = listed.join(counted, "column", "left").select("column", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"))
    if max_unique is not None:
        full = full.where(F.col("n_unique") <= max_unique)
    return full.orderBy(F.desc("n_unique"), "column")


def cardinalities(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Exact distinct counts of the columns with at most `limit` values (fit helper)."""
    return {r["column"]: r["n_unique"] for r in unique_counts(df, limit, columns=columns).collect()}


CHECKS = ("missing", "infinite", "zero", "negative")


def quality_counts(df: DataFrame, drop_features: Sequence[str] = ()) -> DataFrame:
    """(column, n_rows, missing, infinite, zero, negative) for all columns in one pass.

    The last three are null for non-numeric columns.
    """
    names = [c for c in df.columns if c not in drop_features]
    numeric = set(numeric_columns(df))
    measures = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        measures.append(F.count_if(is_missing(df, name)).alias(f"m{i}"))
        if name in numeric:
            c = col(name)
            infinite = F.abs(c.cast("double")) == F.lit(float("inf")) if is_float(df.schema[name].dataType) else F.lit(False)
            measures += [
                F.count_if(infinite).alias(f"i{i}"), F.count_if(c == 0).alias(f"z{i}"), F.count_if(c < 0).alias(f"g{i}")
            ]
    none = F.lit(None).cast("long")
    rows = [
        F.struct(
            F.lit(name).alias("column"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("missing"),
            *[(F.col(f"{k}{i}") if name in numeric else none).alias(check) for k, check in zip("izg", CHECKS[1:])],
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def special_values(df: DataFrame, check: str, drop_features: Sequence[str] = ()) -> DataFrame:
    """(column, n, pct) of one check, columns with a non-zero count only, most first."""
    counts = quality_counts(df, drop_features).where(F.col(check) > 0)
    return counts.select(
        "column", F.col(check).alias("n"), F.round(F.col(check) / F.col("n_rows") * 100, 3).alias("pct")
    ).orderBy(F.desc("n"), "column")


def duplicate_groups(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """The feature combinations that occur more than once, with their row count `n`."""
    features = [c for c in df.columns if c not in ignore]
    return df.groupBy(*[col(c) for c in features]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Every member row of a duplicated group, with the size `n` of its group.

    Nulls compare equal, as in a group-by: features are matched as one struct.
    """
    features = [c for c in df.columns if c not in ignore]
    keyed = df.withColumn("_key", F.struct(*[col(c) for c in features]))
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return skew_join(keyed, groups, ["_key"], "n", df.count()).drop("_key")


def duplicate_summary(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    groups = duplicate_groups(df, ignore)
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_redundant"),
    )


def compare_quality(frames: dict[str, DataFrame], check: str) -> DataFrame:
    """(label, column, n, pct, n_features): one check over several frames side by side."""
    parts = [special_values(df, check).withColumn("label", F.lit(label)) for label, df in frames.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.withColumn("n_features", F.count(F.lit(1)).over(W.partitionBy("label"))).select(
        "label", "column", "n", "pct", "n_features"
    )


def dtype_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string" if isinstance(dtype, T.StringType) else "other"


def schema_profile(df: DataFrame, persisted: Sequence[str] = ()) -> DataFrame:
    """(column, dtype_class, n_rows, n_columns, castable): numerics with more than two
    values that are neither id nor target may be turned into categories."""
    numeric = [c for c in numeric_columns(df) if c not in persisted]
    two_or_less = {c for c, n in cardinalities(df, numeric, 2).items()}
    listed = literal_rows(df.sparkSession,
        [(f.name, dtype_class(f.dataType), len(df.columns), f.name in numeric and f.name not in two_or_less) for f in df.schema],
        "column string, dtype_class string, n_columns int, castable boolean",
    )
    return listed.withColumn("n_rows", F.lit(df.count()).cast("long"))


