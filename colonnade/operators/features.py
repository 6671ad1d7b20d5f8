"""Feature engineering: derived columns, encoders and scaling, fitted once and replayed."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colonnade.columns import categorical_columns, col, numeric_columns, present
from colonnade.operators.ordering import quantiles
from colonnade.operators.quality import cardinalities, value_profile


def floor_divide(a: Column, b: Column) -> Column:
    """Exact floor of a/b for doubles (floor of the rounded quotient can be one too high)."""
    rest = a % b
    rest = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return F.floor((a - rest) / b + 0.5).cast("double")


def math_features(df: DataFrame, columns: Sequence[str] | None = None, include_last: bool = False) -> DataFrame:
    """Powers, multiples and all pairwise arithmetic of the numeric columns; x/0 is 0.

    One projection for the whole set, so the plan stays flat however wide it gets.
    """
    names = list(columns or numeric_columns(df))
    d = {c: col(c).cast("double") for c in names}
    made: dict[str, Column] = {}
    for c in names if include_last else names[:-1]:
        made |= {f"{c}_pow2": d[c] * d[c], f"{c}_pow3": d[c] * d[c] * d[c], f"{c}_mul10": d[c] * 10, f"{c}_mul100": d[c] * 100}
    for a, b in combinations(names, 2):
        made |= {f"{a}_add_{b}": d[a] + d[b], f"{a}_sub_{b}": d[a] - d[b], f"{a}_subabs_{b}": F.abs(d[a] - d[b]), f"{a}_mul_{b}": d[a] * d[b]}
        for x, y in ((a, b), (b, a)):
            made[f"{x}_truediv_{y}"] = F.when(d[y] != 0, d[x] / d[y]).otherwise(0.0)
            made[f"{x}_floordiv_{y}"] = F.when(d[y] != 0, floor_divide(d[x], d[y])).otherwise(0.0)
    return df.select("*", *[expr.alias(name) for name, expr in made.items()])


def category_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`a_data_b` = "a_b" for every pair of string columns; null when either is null."""
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
    return df.select("*", *[F.concat(col(a), F.lit("_"), col(b)).alias(f"{a}_data_{b}") for a, b in combinations(names, 2)])


WEEKDAY_NAMES = ("Mon", "Tues", "Wed", "Thurs", "Fri", "Sat", "Sun")  # fixed values


def fit_time_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The datetime columns whose time of day varies, so that hour and minute carry
    information. min <> max decides it without a distinct count."""
    if not columns:
        return []
    day_time = lambda c: F.date_format(col(c), "HH:mm:ss.SSSSSS")
    row = df.agg(*[(F.min(day_time(c)) != F.max(day_time(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def datetime_parts(df: DataFrame, columns: Sequence[str], with_time: Sequence[str], weekday_names: bool = False) -> DataFrame:
    """Year, Quarter, Month, Day, Weekday (Monday 0, or its name), IsWeekend, and where
    the time varies Hour, Minute, IsNight (up to 6 or from 18)."""
    made: dict[str, Column] = {}
    for c in columns:
        t = col(c)
        number = F.weekday(t)
        shown = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), number + 1) if weekday_names else number
        made |= {
            f"{c}_Year": F.year(t), f"{c}_Quarter": F.quarter(t), f"{c}_Month": F.month(t), f"{c}_Day": F.dayofmonth(t),
            f"{c}_Weekday": shown, f"{c}_IsWeekend": (number >= 5).cast("int"),
        }
        if c in with_time:
            made |= {f"{c}_Hour": F.hour(t), f"{c}_Minute": F.minute(t), f"{c}_IsNight": ((F.hour(t) <= 6) | (F.hour(t) >= 18)).cast("int")}
    return df.select("*", *[expr.alias(name) for name, expr in made.items()])


def fit_high_cardinality(df: DataFrame, max_unique: int, columns: Sequence[str] | None = None) -> list[str]:
    names = list(columns or categorical_columns(df))
    few = cardinalities(df, names, max_unique)
    return [c for c in names if c not in few]


MAX_CATEGORIES = 10_000  # a longer category list is a table (operators/dictionaries.py), not columns of the plan


def category_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values per column."""
    found = value_profile(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")) if columns else None
    sizes = {r["column"]: r["n"] for r in found.collect()} if columns else {}
    return {c: sizes.get(c, 0) for c in columns}


def fit_categories(df: DataFrame, columns: Sequence[str], null_category: bool = True, sizes: dict[str, int] | None = None) -> dict[str, list[str | None]]:
    """Sorted category list per column; null comes last as a category of its own.

    Lists become columns of the plan, so their length (`sizes`, where known) is checked before
    they are collected; longer ones are for `dictionaries.fit_dictionary`.
    """
    if not columns:
        return {}
    sizes = sizes or category_sizes(df, columns)
    too_long = [c for c in columns if sizes[c] > MAX_CATEGORIES]
    if too_long:
        raise ValueError(f"these category lists need a dictionary: {too_long}")
    lists: dict[str, list[str | None]] = {c: [] for c in columns}
    for r in value_profile(df, columns).groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("v")).collect():
        lists[r["column"]] = list(r["v"])
    if null_category:
        holes = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            if holes[i]:
                lists[c].append(None)
    return lists


def one_hot(df: DataFrame, categories: dict[str, list[str | None]], drop_first: bool = True, dtype: str = "double") -> DataFrame:
    """0/1 column `{column}_{category}` per fitted category; unseen values give all zeros."""
    made = []
    for c, values in categories.items():
        for v in values[1:] if drop_first else values:
            hit = col(c).isNull() if v is None else F.coalesce(col(c).cast("string") == F.lit(v), F.lit(False))
            made.append(hit.cast(dtype).alias(f"{c}_{'nan' if v is None else v}"))
    return df.select(*[col(c) for c in df.columns if c not in categories], *made)


def ordinal(df: DataFrame, categories: dict[str, list[str | None]]) -> DataFrame:
    """Position in the sorted category list; unseen and null give -1."""
    def code(c: str) -> Column:
        known = [v for v in categories[c] if v is not None]
        if not known:
            return F.lit(-1.0)
        position = F.array_position(F.array(*[F.lit(v) for v in known]), col(c).cast("string"))
        return F.coalesce(position - 1, F.lit(-1)).cast("double")

    return df.withColumns({c: code(c) for c in categories}) if categories else df


NOMINAL_LIMIT = 63  # categories that tree models take as unordered (with one more for the unknown, forests' bins)


def nominal(df: DataFrame, categories: dict[str, list[str | None]]) -> DataFrame:
    """Position in the sorted category list; unseen and null are one category behind the last.
    `as_nominal` marks the columns, so that trees split them by sets of categories."""
    def code(c: str) -> Column:
        known = [v for v in categories[c] if v is not None]
        position = F.array_position(F.array(*[F.lit(v) for v in known]), col(c).cast("string")) if known else F.lit(None)
        return F.when(position > 0, position - 1).otherwise(len(known)).cast("double")

    return df.withColumns({c: code(c) for c in categories}) if categories else df


def as_nominal(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Vector metadata for MLlib: these columns hold category numbers, `sizes` of them each."""
    for c, n in sizes.items():
        df = df.withMetadata(c, {"ml_attr": {"type": "nominal", "name": c, "num_vals": n}})
    return df


def fit_fills(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], list[str]]:
    """(median per numeric column, the columns that have missing values)."""
    if not columns:
        return {}, []
    medians = {r["column"]: float(r["q"][0]) for r in quantiles(df, columns, [0.5]).collect()}
    row = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: medians.get(c, 0.0) for c in columns}, [c for i, c in enumerate(columns) if row[i]]


def fill_numbers(df: DataFrame, fills: dict[str, float], flagged: Sequence[str]) -> DataFrame:
    """Missing numbers become the fitted value; `{column}_missing` = 1 tells where that was."""
    flags = {f"{c}_missing": present(df, c).isNull().cast("double") for c in flagged}
    return df.withColumns({**{c: F.coalesce(present(df, c).cast("double"), F.lit(v)) for c, v in fills.items()}, **flags}) if fills else df


def missing_category(df: DataFrame, columns: Sequence[str], label: str = "Missing") -> DataFrame:
    """Categories as strings, null as one more category; the same at fit and replay."""
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit(label)) for c in columns}) if columns else df


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name)


def rename_safe(df: DataFrame) -> DataFrame:
    """Every run of characters outside [A-Za-z0-9_] becomes one underscore."""
    names = [safe_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns collide after renaming: {clash}")
    return df.toDF(*names)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per numeric column, std 0 replaced by 1; one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[f(present(df, c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (present(df, c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}) if scaler else df


def fit_labels(df: DataFrame, target: str) -> list[str]:
    """Sorted class names (as text) of a classification target. A model holds numbers for
    every class, so the list is as long as a model is wide."""
    return [r["value"] for r in value_profile(df, [target]).orderBy("value").collect()]


def text_array(values: Sequence[str]) -> Column:
    """A fixed list as one literal: the optimizer folds it, so a long list does not become as many expressions."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def encode_label(df: DataFrame, target: str, classes: Sequence[str], out: str = "label") -> DataFrame:
    """The class's place in the list; null for an unknown one. Long lists are joined instead of searched."""
    if len(classes) > MAX_CATEGORIES:
        spark, text = df.sparkSession, "_class_text"
        table = spark.range(1).select(F.posexplode(text_array(classes)).alias(out, text)).select(F.col(out).cast("double").alias(out), text)
        return df.withColumn(text, col(target).cast("string")).join(F.broadcast(table), text, "left").drop(text)
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string"))
    return df.withColumn(out, F.when(position > 0, (position - 1).cast("double")))


def decode_label(code: Column, classes: Sequence[str]) -> Column:
    if len(classes) > MAX_CATEGORIES:
        return F.element_at(text_array(classes), code.cast("int") + 1)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), code.cast("int") + 1)


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    return {r["c"]: r["n"] for r in df.groupBy(col(target).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_class_weights(df: DataFrame, target: str, integer: bool = False, counts: dict[str, int] | None = None) -> dict[str, float]:
    """Balanced weights n / (k * n_c) per class; `integer` rescales so that the smallest
    is 100 and truncates (the form that boosted trees take). `counts`, where they are known."""
    counts = counts or class_counts(df, target)
    total, k = sum(counts.values()), len(counts)
    weights = {c: total / (k * n) for c, n in counts.items()}
    if integer:
        low = min(weights.values())
        weights = {c: float(int(w / low * 100)) for c, w in weights.items()}
    return weights


def with_class_weight(df: DataFrame, target: str, weights: dict[str, float], out: str = "weight") -> DataFrame:
    pairs = [x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), col(target).cast("string")))


def assemble(df: DataFrame, exclude: Sequence[str] = (), out: str = "features") -> DataFrame:
    """Numeric columns (bool as 0/1) into one vector; id, fold and target stay beside it."""
    inputs = [c for c in df.columns if c not in exclude]
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and f.name in inputs]
    plain = df.withColumns({c: col(c).cast("double") for c in flags}) if flags else df
    vector = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(plain)
    return vector.select(*[col(c) for c in exclude if c in df.columns], out)
