"""Cleaning steps. Each `fit_*` makes one bounded decision from aggregates; each
transform is a lazy expression that can be replayed on other data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from colonnade.columns import categorical_columns, col, numeric_columns, present
from colonnade.operators.ordering import hash_sample, quantiles, range_edges, with_bucket
from colonnade.operators.quality import approximate_cardinalities, cardinalities, quality_counts, unique_counts, value_profile


def fit_unique_columns(df: DataFrame, persisted: Sequence[str] = ()) -> list[str]:
    """Columns in which every row holds another value.

    A column far below n in the sketch cannot be one; only the near-unique columns pay
    for an exact count.
    """
    names = [c for c in df.columns if c not in persisted]
    if not names:
        return []
    n_rows = df.count()
    estimates = approximate_cardinalities(df, names)
    candidates = [c for c in names if estimates[c] >= 0.5 * n_rows]
    if not candidates:
        return []
    exact = unique_counts(df, None, columns=candidates).where(F.col("n_unique") == n_rows)
    found = {r["column"] for r in exact.collect()}
    return [c for c in names if c in found]


def fit_constant_columns(df: DataFrame, persisted: Sequence[str] = ()) -> list[str]:
    names = [c for c in df.columns if c not in persisted]
    counts = cardinalities(df, names, 1)
    return [c for c in names if counts.get(c) == 1]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def merge_duplicates(df: DataFrame, id_col: str | None, target: str) -> DataFrame:
    """One row per feature combination: id = its largest id, target = mean (numeric) or
    most frequent value (string / bool, ties to the smallest).

    Nulls group together. The mode is found on (features, target) counts, so a
    combination with very many rows is still reduced before it meets one task.
    """
    features = [c for c in df.columns if c not in (id_col, target)]
    keys = [col(c) for c in features]
    largest = [F.max(col(id_col)).alias(id_col)] if id_col else []
    if isinstance(df.schema[target].dataType, T.NumericType):
        merged = df.groupBy(*keys).agg(F.avg(col(target)).alias(target), *largest)
    else:
        counted = df.groupBy(*keys, col(target)).agg(F.count(col(target)).alias("_n"), *largest)
        merged = counted.groupBy(*keys).agg(
            F.min(F.struct((-F.col("_n")).alias("n"), col(target).alias("v")))["v"].alias(target), *largest
        )
    return merged.select(*[col(c) for c in df.columns])


def fit_binary_numbers(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list]:
    """Numeric columns with exactly two values -> [low, high]."""
    names = [c for c in numeric_columns(df) if c not in exclude]
    two = [c for c, n in cardinalities(df, names, 2).items() if n == 2]
    if not two:
        return {}
    ends = df.agg(*[f(present(df, c)).alias(f"{k}{i}") for i, c in enumerate(two) for f, k in ((F.min, "a"), (F.max, "b"))]).first()
    return {c: [ends[f"a{i}"], ends[f"b{i}"]] for i, c in enumerate(two)}


def plain_text(v) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def numbers_to_binary(df: DataFrame, pairs: dict[str, list]) -> DataFrame:
    """High value -> True, low -> False, null stays null. A pair other than {0, 1} also
    renames the column to `{column}_{high}`."""
    def convert(name: str) -> Column:
        if name not in pairs:
            return col(name)
        low, high = pairs[name]
        flag = F.when(present(df, name).isNotNull(), col(name) == F.lit(high))
        return flag.alias(name if {low, high} == {0, 1} else f"{name}_{plain_text(high)}")

    return df.select(*[convert(c) for c in df.columns])


def numbers_to_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present_columns = [c for c in columns if c in df.columns]
    return df.withColumns({c: col(c).cast("string") for c in present_columns}) if present_columns else df


DATE_PATTERN = r"^\d{2,4}[-/]\d{2}[-/]\d{2,4}"  # fixed value: what counts as date-looking
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yy-MM-dd", "yy/MM/dd",
)


def fit_date_strings(df: DataFrame) -> list[str]:
    """String columns whose every non-null value starts like a date (and has a value)."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = df.agg(*[F.bool_and(col(c).rlike(DATE_PATTERN)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[i]]


def strings_to_datetime(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Parse with the first listed format that fits; unparsable values become null."""
    def parse(c: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats]).cast("timestamp_ntz")

    named = [c for c in columns if c in df.columns]
    return df.withColumns({c: parse(c) for c in named}) if named else df


def fit_null_columns(df: DataFrame) -> list[str]:
    found = {r["column"] for r in quality_counts(df).where("missing > 0").select("column").collect()}
    return [c for c in df.columns if c in found]


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def fit_imputation(df: DataFrame, numeric: str = "mean", columns: Sequence[str] | None = None) -> dict[str, object]:
    """Fill values of the columns that have nulls: mode for string / bool (ties to the
    smallest), mean or median for numbers."""
    names = [c for c in (columns or df.columns) if c in set(fit_null_columns(df))]
    numbers = [c for c in names if c in numeric_columns(df)]
    categories = [c for c in names if c in categorical_columns(df)]
    fills: dict[str, object] = {}
    if numbers and numeric == "mean":
        row = df.agg(*[F.avg(present(df, c)).alias(f"c{i}") for i, c in enumerate(numbers)]).first()
        fills.update({c: row[i] for i, c in enumerate(numbers)})
    elif numbers and numeric == "median":
        fills.update({r["column"]: r["q"][0] for r in quantiles(df, numbers, [0.5]).collect()})
    elif numbers:
        raise ValueError("numeric imputation must be 'mean' or 'median'")
    if categories:
        modes = value_profile(df, categories).groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))["v"].alias("v")
        )
        booleans = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
        for r in modes.collect():
            fills[r["column"]] = r["v"] == "true" if r["column"] in booleans else r["v"]
    return {c: v for c, v in fills.items() if v is not None}


def impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Fill nulls (and NaN) with saved values; integers become double if a mean is filled in."""
    named = {c: v for c, v in fills.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(v)) for c, v in named.items()}) if named else df


def align_columns(df: DataFrame, kept: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Bring new data to the trained column list; id / target may be missing from it."""
    lost = [c for c in kept if c not in df.columns and c not in optional]
    if lost:
        raise ValueError(f"columns missing from the new data: {lost}")
    return df.select(*[col(c) for c in kept if c in df.columns])


def random_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """Exact sample of `size` rows in md5 order."""
    n_rows = df.count()
    return hash_sample(df, id_col, min(1.0, size / n_rows) if n_rows else 0.0, (), seed)


def stratified_sample(df: DataFrame, id_col: str, size: int, group: str, bins: int = 10, seed: int = 42) -> DataFrame:
    """Sample with the same fraction from every stratum; a numeric group is cut into
    quantile bins first."""
    from colonnade.operators.splitting import quantile_bins

    n_rows = df.count()
    frac = min(1.0, size / n_rows) if n_rows else 0.0
    if isinstance(df.schema[group].dataType, T.NumericType):
        return hash_sample(quantile_bins(df, group, bins, out="_stratum"), id_col, frac, ["_stratum"], seed).drop("_stratum")
    return hash_sample(df, id_col, frac, [group], seed)


def sortable(df: DataFrame, name: str) -> Column:
    """A double that orders like the numeric or timestamp column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{name}: only numeric and datetime keys can be cut into ranges")
    return col(name).cast("double")


def row_index(df: DataFrame, keys: Sequence[str], out: str = "id") -> DataFrame:
    """Dense 0-based row number in the order of `keys`, which must identify a row.

    The leading key is cut into range buckets and a second one again into sub-buckets
    wherever the leading key repeats so often that it fills whole buckets on its own.
    Bucket counts give each bucket its first number: there is no single-task sort.
    """
    lead = df.withColumn("_k0", sortable(df, keys[0]))
    edges = range_edges(lead, "_k0")
    # a value that spans several quantiles gets a bucket of its own: [v, next double)
    alone = sorted(edges + [math.nextafter(e, math.inf) for e in edges])
    cut = with_bucket(lead, "_k0", alone, "_b0")
    if len(keys) > 1 and edges:
        single = F.array_contains(F.array(*[F.lit(e) for e in edges]), F.col("_k0"))
        second = cut.withColumn("_k1", sortable(df, keys[1]))
        cut = with_bucket(second, "_k1", range_edges(second, "_k1"), "_s")
        cut = cut.withColumn("_b1", F.when(single, F.col("_s")).otherwise(0))
    else:
        cut = cut.withColumn("_b1", F.lit(0))
    totals = cut.groupBy("_b0", "_b1").agg(F.count(F.lit(1)).alias("_t"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_b0", "_b1").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_b0", "_b1", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    local = W.partitionBy("_b0", "_b1").orderBy(*[col(k) for k in keys])
    numbered = cut.withColumn("_r", F.row_number().over(local)).join(offsets, ["_b0", "_b1"])
    return numbered.select((F.col("_r") - 1 + F.col("_o")).cast("long").alias(out), *[col(c) for c in df.columns])
