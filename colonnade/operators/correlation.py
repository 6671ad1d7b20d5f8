"""Pearson, Spearman and Kendall coefficients of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from colonnade.columns import categorical_columns, col, literal_rows, long_values, numeric_columns, present
from colonnade.operators import features as X
from colonnade.operators.cleaning import row_index
from colonnade.operators.gram import pearson_matrix
from colonnade.operators.ordering import column_edges, prefix_sum, skew_join, with_bucket
from colonnade.operators.quality import cardinalities, quality_counts
from colonnade.session import stored

PAIRS_PER_JOB = 150  # aggregates in one generated stage; more pairs go by blocked Gram matrices
RANK_VALUES = 2_000_000  # distinct values, of all rankings together, that are looked up in the tasks
DENSE_BUCKETS = 100_000  # places of one column up to which a running sum is left to one task
RADIX_BITS = 2       # bits per digit of the Kendall decomposition
RADIX = 2 ** RADIX_BITS


def fit_binary_categories(df: DataFrame) -> dict[str, list[str]]:
    """String / bool columns with two values -> [low, high] in text order."""
    two = [c for c, n in cardinalities(df, categorical_columns(df), 2).items() if n == 2]
    if not two:
        return {}
    ends = df.agg(*[f(col(c).cast("string")).alias(f"{k}{i}") for i, c in enumerate(two) for f, k in ((F.min, "a"), (F.max, "b"))]).first()
    return {c: [ends[f"a{i}"], ends[f"b{i}"]] for i, c in enumerate(two)}


def binary_to_numeric(df: DataFrame, pairs: dict[str, list[str]]) -> DataFrame:
    """`{column}_{high}` = 1 for the high value, 0 for the low one, null stays null."""
    return df.select(*[
        (col(c).cast("string") == pairs[c][1]).cast("int").alias(f"{c}_{pairs[c][1]}") if c in pairs else col(c) for c in df.columns
    ])


def prepare_matrix(
    df: DataFrame, time: bool = False, drop_features: Sequence[str] = (), max_cat_unique: int | None = 10,
    drop_first: bool = True, scale: bool = True,
) -> DataFrame:
    """A numeric frame for association analysis: datetime parts, one-hot columns, z-scores."""
    if time:
        dates = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        df = X.datetime_parts(df, dates, X.fit_time_columns(df, dates), weekday_names=True).drop(*dates)
    df = df.drop(*drop_features)
    if max_cat_unique is not None:
        df = df.drop(*X.fit_high_cardinality(df, max_cat_unique))
    matrix = X.one_hot(df, X.fit_categories(df, categorical_columns(df)), drop_first, "int")
    return X.standard_scale(matrix, X.fit_scaler(matrix, numeric_columns(matrix))) if scale else matrix


def pearson(x: Column, y: Column) -> Column:
    return F.regr_sxy(x, y) / F.nullif(F.sqrt(F.regr_sxx(x, y) * F.regr_syy(x, y)), F.lit(0.0))


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column_1, column_2, pearson): pairwise complete, a constant column gives null.

    A few pairs are aggregates of one scan and merge map-side (the built-in corr raises on a
    constant column in ANSI mode, hence its three sums); more are blocks of Gram matrices.
    """
    if len(pairs) > PAIRS_PER_JOB:
        return pearson_matrix(df, pairs).withColumnRenamed("r", "pearson")
    value = lambda c: present(df, c).cast("double")
    row = df.agg(*[pearson(value(a), value(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    named = [F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"p{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*named)))


@dataclass
class Rankings:
    """What has to be ranked so that every pair is ranked on its own complete rows.

    Columns without nulls share one ranking. A pair with nulls is ranked where the columns
    that have them are present, and pairs with the same such columns share that. `keys` names every
    (column, columns that must be present); `sides` gives the two keys of each pair.
    """

    keys: list[tuple[str, tuple[str, ...]]]
    sides: list[tuple[int, int]]

    def values(self, df: DataFrame) -> DataFrame:
        """One column `k0`, `k1`, ... per key, null in rows that do not count for it."""
        def value(c: str, needed: tuple[str, ...]) -> Column:
            whole = reduce(lambda a, b: a & b, [present(df, n).isNotNull() for n in needed], F.lit(True))
            return F.when(whole, present(df, c).cast("double"))

        return df.select(*[value(c, needed).alias(f"k{i}") for i, (c, needed) in enumerate(self.keys)])


def plan_rankings(pairs: Sequence[tuple[str, str]], holed: set[str]) -> Rankings:
    keys: dict[tuple, int] = {}
    sides = []
    for a, b in pairs:
        needed = tuple(sorted({a, b} & holed))
        sides.append(tuple(keys.setdefault((c, needed), len(keys)) for c in (a, b)))
    return Rankings(list(keys), sides)


@dataclass
class Places:
    """Per key: its distinct values in order, and their average ranks less the middle rank."""

    values: list[np.ndarray]
    ranks: list[np.ndarray]

    def of(self, matrix: np.ndarray, keys: Sequence[int], dense: bool = False) -> np.ndarray:
        """A matrix of values with their ranks (or places) instead; missing stays NaN."""
        out = np.full(matrix.shape, np.nan)
        for j, k in enumerate(keys):
            there = ~np.isnan(matrix[:, j])
            at = np.searchsorted(self.values[k], matrix[there, j])
            out[there, j] = at if dense else self.ranks[k][at]
        return out


def look_up_places(counts: DataFrame, keys: int) -> Places:
    """From (key, value, n), at most RANK_VALUES rows: sorted and added up on the driver."""
    table = counts.toArrow()
    key, value, n = (table.column(c).to_numpy() for c in ("key", "value", "n"))
    order = np.lexsort((value, key))
    key, value, n = key[order], value[order], n[order]
    cut = np.searchsorted(key, np.arange(keys + 1))
    values, ranks = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        upto = np.cumsum(n[a:b])
        values.append(value[a:b])
        ranks.append(upto - (n[a:b] - 1) / 2 - ((upto[-1] if b > a else 0) + 1) / 2)
    return Places(values, ranks)


def spearman_by_lookup(values: DataFrame, rankings: Rankings, places: Places) -> DataFrame:
    """(pair, spearman): Pearson of ranks that are looked up where the rows are, all pairs in one scan."""
    pairs = [(f"k{a}", f"k{b}") for a, b in rankings.sides]
    names = sorted({c for p in pairs for c in p})
    numbers = [int(c[1:]) for c in names]
    found = pearson_matrix(values, pairs, shift=np.zeros(len(names)), change=lambda m, used: places.of(m, [numbers[u] for u in used]))
    listed = literal_rows(values.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_1 string, column_2 string")
    return listed.join(found.distinct(), ["column_1", "column_2"]).select("pair", F.col("r").alias("spearman"))


def dense_places(values: DataFrame, places: Places) -> DataFrame:
    """The same columns holding each value's 0-based place among its key's values."""
    names = values.columns
    schema = ", ".join(f"{c} long" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = places.of(np.stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns], 1), range(len(names)), dense=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.nan_to_num(c).astype(np.int64), mask=np.isnan(c)) for c in m.T], names=names)

    return values.mapInArrow(place, schema)


def rank_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank, dense): average rank and 0-based dense index per value."""
    edges = column_edges(df, columns)
    parts = [with_bucket(df.select(F.lit(c).alias("column"), present(df, c).cast("double").alias("value")).where("value is not null"), "value", edges[c]) for c in columns]
    counts = reduce(DataFrame.unionByName, parts).groupBy("column", "value", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    placed = prefix_sum(counts, "value", {"n": "before", "one": "dense"}, ["column"], bucket="_bucket")
    return placed.select("column", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), F.col("dense").cast("long").alias("dense"))


SMALL_RANKS = 200_000  # distinct values up to which a rank table is broadcast


@contextmanager
def rank_frame(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """The numeric columns replaced by structs (rank, dense); rows without any null. Cached
    while in use.

    Rank tables are counted first: short ones are broadcast, long ones go through the
    skew-safe join, one column at a time.
    """
    rows = df.select(*[present(df, c).cast("double").alias(c) for c in columns]).na.drop("any")
    table = rank_table(rows, columns).persist()
    sizes = {r["column"]: (r["values"], r["rows"]) for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    out = rows
    for c in columns:
        ranks = table.where(F.col("column") == c).select(F.col("value").alias(c), "n", F.struct("rank", "dense").alias("_place"))
        values, total = sizes.get(c, (0, 0))
        joined = out.join(F.broadcast(ranks), c) if values <= SMALL_RANKS else skew_join(out, ranks, [c], "n", total)
        out = joined.drop("n", c).withColumnRenamed("_place", c)
    out = out.select(*[col(c) for c in columns]).persist()
    try:
        yield out
    finally:
        out.unpersist()
        table.unpersist()


def spearman_pairs(ranked: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson of average ranks."""
    names = sorted({c for p in pairs for c in p})
    plain = ranked.select(*[col(c)["rank"].alias(c) for c in names])
    return pearson_pairs(plain, pairs).withColumnRenamed("pearson", "spearman")


def kendall_pairs(dense: DataFrame, pairs: Sequence[tuple[str, str]], top: dict[str, int]) -> DataFrame:
    """(pair, kendall): exact tau-b without comparing rows with each other. `dense` holds each
    value's place (at most `top`), null where the row does not count.

    Rows are merged into cells of equal (x, y). Two rows with different y differ first in
    some digit of y's place; at that digit they share all higher digits. So for each
    digit position, group by the higher digits, walk x upwards with the running number of
    rows per digit, and every pair is counted once, at its own position. Each position is
    a prefix sum, i.e. one bucketed shuffle of pre-aggregated cells.
    """
    names = sorted({c for p in pairs for c in p})
    levels = {c: max(1, -(-int(top[c]).bit_length() // RADIX_BITS)) for c in names}
    # tau-b is symmetric: the column with fewer digits is the one that is decomposed
    sides = [(a, b) if levels[b] <= levels[a] else (b, a) for a, b in pairs]
    listed = F.array(*[
        F.struct(F.lit(i).alias("pair"), col(a).alias("x"), col(b).alias("y"), F.lit(levels[b]).alias("digits")) for i, (a, b) in enumerate(sides)
    ])
    cells = stored(dense.select(F.inline(listed)).where("x is not null and y is not null").groupBy("pair", "x", "y", "digits").agg(F.count(F.lit(1)).alias("n")), "cells")
    power = F.pow(F.lit(float(RADIX)), F.col("level")).cast("long")
    placed = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("level")).select(
        "pair", "level", "x", "n", F.floor(F.col("y") / (power * RADIX)).alias("prefix"), F.pmod(F.floor(F.col("y") / power), F.lit(RADIX)).alias("digit")
    )
    by = ["pair", "level", "prefix"]
    at_x = placed.groupBy(*by, "x").agg(*[F.sum(F.when(F.col("digit") == k, F.col("n")).otherwise(0)).alias(f"d{k}") for k in range(RADIX)])
    # places are whole numbers, so buckets of equal width need no look at the data
    most = max(top[a] for a, _ in sides)
    wide = max(1, most // DENSE_BUCKETS)
    cut = at_x.withColumn("_bucket", F.floor(F.col("x") * wide / (most + 1)).cast("int"))
    walked = prefix_sum(cut, "x", {f"d{k}": f"b{k}" for k in range(RADIX)}, by, bucket="_bucket")
    d = lambda k: F.col(f"d{k}").cast("double")
    lower = lambda k: reduce(lambda s, m: s + F.col(f"b{m}"), range(k), F.lit(0))
    upper = lambda k: reduce(lambda s, m: s + F.col(f"b{m}"), range(k + 1, RADIX), F.lit(0))
    balance = reduce(lambda s, k: s + d(k) * (lower(k) - upper(k)), range(RADIX), F.lit(0.0))
    score = walked.groupBy("pair").agg(F.sum(balance).alias("s"))
    tied = lambda axis: cells.groupBy("pair", axis).agg(F.sum("n").cast("double").alias("t")).groupBy("pair").agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"tied_{axis}"), F.sum("t").alias(f"rows_{axis}")
    )
    n0 = F.col("rows_x") * (F.col("rows_x") - 1) / 2
    scale = F.sqrt((n0 - F.col("tied_x")) * (n0 - F.col("tied_y")))
    joined = score.join(tied("x"), "pair").join(tied("y"), "pair")
    return stored(joined.select("pair", F.when(scale > 0, F.col("s") / scale).alias("kendall")), "kendall")


METHODS = ("pearson", "spearman", "kendall")


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], methods: Sequence[str] = METHODS) -> DataFrame:
    """(column_1, column_2, <methods>) for the given pairs, each on its complete rows.

    All pairs share one counting of values, whatever their nulls. As long as the values are few
    enough, ranks are looked up where the rows are; beyond that they are joined.
    """
    spark = df.sparkSession
    if not pairs:
        return literal_rows(spark, [], "column_1 string, column_2 string, " + ", ".join(f"{m} double" for m in methods))
    listed = spark.createDataFrame(pa.table({"pair": pa.array(range(len(pairs)), pa.int32()), "column_1": [a for a, _ in pairs], "column_2": [b for _, b in pairs]}))
    frames = {}
    if "pearson" in methods:
        frames["pearson"] = pearson_pairs(df, pairs).join(listed, ["column_1", "column_2"]).select("pair", "pearson")
    if set(methods) & {"spearman", "kendall"}:
        frames |= ranked_correlations(df, pairs, methods)
    out = listed
    for m in methods:
        out = out.join(frames[m], "pair", "left")
    return out.select("column_1", "column_2", *methods)


def ranked_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], methods: Sequence[str]) -> dict[str, DataFrame]:
    used = sorted({c for p in pairs for c in p})
    holed = {r["column"] for r in quality_counts(df.select(*[col(c) for c in used])).where("missing > 0").collect()}
    rankings = plan_rankings(pairs, holed)
    values = rankings.values(df)
    names = [(f"k{a}", f"k{b}") for a, b in rankings.sides]
    cells = long_values(values, values.columns, dtype="double").where("value is not null")
    counts = stored(cells.groupBy(F.substring("column", 2, 9).cast("int").alias("key"), "value").agg(F.count(F.lit(1)).alias("n")), "values")
    if counts.limit(RANK_VALUES + 1).count() <= RANK_VALUES:
        places = look_up_places(counts, len(rankings.keys))
        made = {"spearman": lambda: spearman_by_lookup(values, rankings, places),
                "kendall": lambda: kendall_pairs(dense_places(values, places), names, {f"k{i}": max(len(v) - 1, 0) for i, v in enumerate(places.values)})}
        return {m: f() for m, f in made.items() if m in methods}
    parts: dict[str, list[DataFrame]] = {m: [] for m in ("spearman", "kendall") if m in methods}
    whole = [i for i, p in enumerate(pairs) if not holed & set(p)]
    for group in ([whole] if whole else []) + [[i] for i, p in enumerate(pairs) if holed & set(p)]:
        some = [pairs[i] for i in group]
        numbers = literal_rows(df.sparkSession, [(n, i) for n, i in enumerate(group)], "_n int, pair int")
        with rank_frame(df, sorted({c for p in some for c in p})) as ranked:
            if "spearman" in parts:
                told = literal_rows(df.sparkSession, [(i, a, b) for i, (a, b) in zip(group, some)], "pair int, column_1 string, column_2 string")
                parts["spearman"].append(stored(spearman_pairs(ranked, some).join(told, ["column_1", "column_2"]).select("pair", "spearman"), "spearman"))
            if "kendall" in parts:
                plain = ranked.select(*[col(c)["dense"].alias(c) for c in ranked.columns])
                row = plain.agg(*[F.max(col(c)).alias(f"c{i}") for i, c in enumerate(plain.columns)]).first()
                found = kendall_pairs(plain, some, {c: int(row[i] or 0) for i, c in enumerate(plain.columns)})
                parts["kendall"].append(found.withColumnRenamed("pair", "_n").join(numbers, "_n").select("pair", "kendall"))
    return {m: reduce(DataFrame.unionByName, p) for m, p in parts.items()}


def correlation_long(df: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """The upper triangle over all numeric columns."""
    return correlation_pairs(df, list(combinations(numeric_columns(df), 2)), methods)


def correlation_analysis(df: DataFrame, methods: Sequence[str] = METHODS) -> tuple[DataFrame, list[str]]:
    """Upper triangle of the prepared matrix (binaries as 0/1, other categories one-hot),
    and the columns that preparation generated."""
    matrix = prepare_matrix(binary_to_numeric(df, fit_binary_categories(df)), drop_first=False, scale=False)
    numeric = matrix.select(*[col(c) for c in numeric_columns(matrix)])
    return correlation_long(numeric, methods), [c for c in numeric.columns if c not in df.columns]


def strong_weak(
    correlations: DataFrame, generated: Sequence[str], method: str = "pearson", top: int | None = None,
    positive: float = 0.6, negative: float = -0.6, weak: tuple[float, float] = (-0.1, 0.1),
) -> DataFrame:
    """(kind, position, column_1, column_2, value): strong +, strong -, weak pairs of
    original columns, strongest (or weakest) first."""
    v = F.col(method)
    kept = correlations.where(~F.col("column_1").isin(list(generated)) & ~F.col("column_2").isin(list(generated))) if generated else correlations
    kinds = F.array_compact(F.array(
        F.when(v >= positive, F.lit("positive")), F.when(v <= negative, F.lit("negative")), F.when(v.between(*weak), F.lit("weak"))
    ))
    tagged = kept.where(v.isNotNull()).select(F.explode(kinds).alias("kind"), "column_1", "column_2", v.alias("value"))
    strength = F.when(F.col("kind") == "weak", F.abs("value")).otherwise(-F.abs("value"))
    order = W.partitionBy("kind").orderBy(strength, "column_1", "column_2")
    ranked = tagged.withColumn("position", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("position") <= top)


def correlation_series(df: DataFrame, feature: str, id_col: str | None = None, methods: Sequence[str] = METHODS) -> DataFrame:
    """One feature against all other numeric columns; a non-numeric feature stands for the
    row order (by `id_col`)."""
    others = [c for c in numeric_columns(df) if c != feature]
    if feature in numeric_columns(df):
        frame = df.select(col(feature), *[col(c) for c in others])
    else:
        if id_col is None:
            raise ValueError("a non-numeric feature needs id_col for the row order")
        frame = row_index(df.drop(feature), [id_col], feature)
    return correlation_pairs(frame, [(feature, c) for c in others], methods)


def scatter_points(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column_1, column_2, x, y, n): the distinct points of each pair and their weight."""
    listed = F.array(*[
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), present(df, a).cast("double").alias("x"), present(df, b).cast("double").alias("y")) for a, b in pairs
    ])
    points = df.select(F.inline(listed)).where("x is not null and y is not null")
    return points.groupBy("column_1", "column_2", "x", "y").agg(F.count(F.lit(1)).alias("n"))
