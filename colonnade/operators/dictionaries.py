"""Encoders for category lists of any length: the list is a table, not columns or literals.

A fitted dictionary holds every category's position in its column's sorted list, null last. Rows
meet it by a join that no frequent value can overload, and one-hot codes are sparse vectors, so
neither the plan nor a row grows with the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colonnade.columns import col, literal_rows, present
from colonnade.operators.ordering import spread_left_join
from colonnade.operators.quality import value_profile
from colonnade.session import broadcast_checked, scratch_path

BROADCAST_VALUES = 100_000  # a longer list is joined by shuffle


def positions_in_order(table: DataFrame, by: str, value: str, out: str = "position") -> DataFrame:
    """0-based place of every row among the rows of its group, by value. Rows (group, value) are distinct.

    Range partitions are sorted where they are; a place is the row's number in its partition
    plus the group's rows in the partitions before. Only one row per group and partition
    is added up.
    """
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "ordered")
    ordered = table.repartitionByRange(col(by), col(value)).sortWithinPartitions(col(by), col(value))
    ordered.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_m", 33))
    sums = rows.groupBy(col(by), "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    earlier = W.partitionBy(col(by)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = rows.join(broadcast_checked(offsets), [by, "_part"])
    return placed.select(*[col(c) for c in table.columns], (F.col("_m") - F.col("_first") + F.col("_before")).alias(out))


def fit_dictionary(df: DataFrame, columns: Sequence[str], null_category: bool = True, path: str | None = None) -> DataFrame:
    """(column, value, position, n): the sorted categories of every column with their rows; null,
    where it occurs and counts, comes last. Written below `path`, or the scratch folder."""
    spark = df.sparkSession
    places = positions_in_order(value_profile(df, columns), "column", "value")
    if null_category:
        holes = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        counted = literal_rows(spark, [(c, int(holes[i])) for i, c in enumerate(columns) if holes[i]], "column string, n bigint")
        sizes = places.groupBy("column").agg(F.max("position").alias("last"))
        nulls = counted.join(sizes, "column", "left").select("column", F.lit(None).cast("string").alias("value"), "n", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("position"))
        places = places.unionByName(nulls)
    path = path or scratch_path(spark, "dictionary")
    places.select("column", "value", F.col("position").cast("long").alias("position"), F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dictionary_sizes(dictionary: DataFrame) -> dict[str, int]:
    """Categories per column, null included."""
    return {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def with_positions(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `{column}_position`: the category's place, null for values that the dictionary lacks."""
    for c in columns:
        out, text, entries = f"{c}_position", f"_text_{c}", dictionary.where(F.col("column") == c)
        known = entries.where("value is not null").select(F.col("value").alias(text), F.col("position").alias(out), "n")
        keyed = df.withColumn(text, category_text(df, c))
        if known.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
            joined = keyed.join(F.broadcast(known.drop("n")), text, "left")
        else:
            joined = spread_left_join(keyed, known, text, "n")
        null_place = entries.where("value is null").select("position").first()
        if null_place:
            joined = joined.withColumn(out, F.when(col(text).isNull(), F.lit(null_place[0])).otherwise(col(out)))
        df = joined.select(*[col(k) for k in df.columns], col(out))
    return df


def category_text(df: DataFrame, name: str) -> Column:
    """The text by which a value stands in the dictionary (NaN is null, -0.0 is 0.0)."""
    value = present(df, name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        value = value + F.lit(0.0)
    return value.cast("string")


def one_hot_vectors(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Replaces every column by the sparse vector `{column}_onehot`, one entry per category (the
    first one left out with `drop_first`); unseen values are all zeros. A column with nothing
    left to tell apart is dropped."""
    sizes, skip = dictionary_sizes(dictionary), int(drop_first)
    widths = {c: sizes.get(c, 0) - skip for c in columns}
    told = [c for c in columns if widths[c] > 0]
    out = with_positions(df, dictionary, told)
    # the encoder's own category for invalid values comes last and is the one that is not shown
    index = {c: F.when(col(f"{c}_position") >= skip, col(f"{c}_position") - skip).otherwise(widths[c]).cast("double") for c in told}
    plain = out.select(*[col(c) for c in df.columns if c not in columns], *[e.alias(f"{c}_onehot_index") for c, e in index.items()])
    if not told:
        return plain
    names = [f"{c}_onehot_index" for c in told]
    longest = literal_rows(df.sparkSession, [tuple(float(widths[c] - 1) for c in told)], ", ".join(f"`{n}` double" for n in names))
    encoder = OneHotEncoder(inputCols=names, outputCols=[f"{c}_onehot" for c in told], handleInvalid="keep", dropLast=True)
    return encoder.fit(longest).transform(plain).drop(*names)


def ordinal_codes(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces every column by its place among the non-null categories; unseen and null give -1."""
    out = with_positions(df, dictionary.where("value is not null"), columns)
    return out.withColumns({c: F.coalesce(col(f"{c}_position"), F.lit(-1)).cast("double") for c in columns}).drop(*[f"{c}_position" for c in columns])


def label_codes(df: DataFrame, dictionary: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Adds the class's place as a number; null for a class that the dictionary lacks."""
    return with_positions(df, dictionary.where("value is not null"), [target]).withColumn(out, col(f"{target}_position").cast("double")).drop(f"{target}_position")


def label_names(df: DataFrame, dictionary: DataFrame, target: str, code: str, out: str) -> DataFrame:
    """The other way round: adds the class name that a code stands for."""
    names = dictionary.where((F.col("column") == target) & F.col("value").isNotNull()).select(F.col("position").alias("_code"), F.col("value").alias(out), "n")
    keyed = df.withColumn("_code", col(code).cast("long"))
    if names.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        joined = keyed.join(F.broadcast(names.drop("n")), "_code", "left")
    else:
        joined = spread_left_join(keyed, names, "_code", "n")
    return joined.select(*[col(c) for c in df.columns], col(out))
