"""Tests of association: numeric by category (ANOVA on sample means), category by category."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colonnade.columns import categorical_columns, col, literal_rows, numeric_columns, present
from colonnade.functions.distributions import chi2_sf, f_sf, normal_sf
from colonnade.functions.normal import inverse_normal, polynomial
from colonnade.operators.ordering import hash_rank, prefix_sum
from colonnade.operators.quality import cardinalities, value_profile
from colonnade.session import stored

SIGNIFICANCE = 0.05
PAIR = ["cat_column", "num_column"]


def eligible_groups(df: DataFrame, cat: str, sample_size: int = 30, min_means: int = 20, max_unique: int = 5) -> DataFrame:
    """(cat_column, group, n): the largest groups with enough rows for `min_means` sample
    means; empty when fewer than two qualify."""
    counts = df.where(col(cat).isNotNull()).groupBy(col(cat).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= sample_size * min_means).orderBy(F.desc("n"), "group").limit(max_unique)
    enough = F.count(F.lit(1)).over(W.partitionBy("cat_column"))
    return top.withColumn("cat_column", F.lit(cat)).withColumn("_k", enough).where("_k >= 2").select("cat_column", "group", "n")


def sample_means(
    df: DataFrame, id_col: str, cat: str, numeric: Sequence[str], sample_size: int = 30, max_unique: int = 5,
    min_means: int = 20, max_means: int | None = None, seed: int = 42,
) -> DataFrame:
    """(cat_column, num_column, group, batch, mean): rows of a group in md5 order, cut into
    full batches, one mean per batch and numeric column, all in one pass.

    Ranking spreads a group over its hash buckets, and a batch lies in one bucket (or two),
    so the means are mostly combined before the shuffle.
    """
    groups = {r["group"]: r["n"] for r in eligible_groups(df, cat, sample_size, min_means, max_unique).collect()}
    if not groups:
        return literal_rows(df.sparkSession, [], "cat_column string, num_column string, group string, batch bigint, mean double")
    rows = df.select(col(id_col), col(cat).cast("string").alias("_group"), *[present(df, c).cast("double").alias(c) for c in numeric])
    ranked = hash_rank(rows.where(F.col("_group").isin(list(groups))), id_col, ["_group"], seed, out="_rank")
    full = {g: n // sample_size if max_means is None else min(max_means, n // sample_size) for g, n in groups.items()}
    limit = F.element_at(F.create_map(*[x for g, k in full.items() for x in (F.lit(g), F.lit(k))]), F.col("_group"))
    batched = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / sample_size)).where(F.col("batch") < limit)
    wide = batched.groupBy("_group", "batch").agg(*[F.avg(col(c)).alias(c) for c in numeric])
    tall = wide.unpivot(["_group", "batch"], [col(c) for c in numeric], "num_column", "mean")
    return tall.select(F.lit(cat).alias("cat_column"), "num_column", F.col("_group").alias("group"), "batch", "mean")


def all_sample_means(df: DataFrame, id_col: str, categories: Sequence[str], numeric: Sequence[str], **options) -> DataFrame:
    return reduce(DataFrame.unionByName, [sample_means(df, id_col, c, numeric, **options) for c in categories])


# Polynomial coefficients of Royston's algorithm AS R94 (lowest power first).
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_SCALE = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SCALE = (-0.4803, -0.082676, 0.0030302)


def rising(coefficients: Sequence[float], x: Column) -> Column:
    return polynomial(tuple(reversed(coefficients)), x)


def shapiro_wilk(means: DataFrame, by: Sequence[str] = (*PAIR, "group"), value: str = "mean") -> DataFrame:
    """(by..., n, w, z): Shapiro-Wilk W (Royston 1995) and its normal score, any group size.

    W is a weighted sum of order statistics, and the weights depend on position and n
    only, so it is two aggregates over ranked values rather than a per-group function.
    """
    counts = means.where(col(value).isNotNull()).groupBy(*[col(b) for b in by], col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    placed = prefix_sum(counts, "x", {"c": "before"}, by)
    spread = means.groupBy(*[col(b) for b in by]).agg(F.count(col(value)).alias("n"), (F.var_pop(col(value)) * F.count(col(value))).alias("ss"))
    usable = spread.where("n >= 3 and ss > 0")
    ordered = placed.join(usable, list(by)).select(
        *[col(b) for b in by], "x", "n", "ss", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("i")
    ).withColumn("m", inverse_normal((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    keys = [col(b) for b in by]
    at = lambda k: inverse_normal((F.col("n") - (k + 0.375)) / (F.col("n") + 0.25))
    norms = ordered.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    r = 1 / F.sqrt("n")
    m1, m2 = at(0), at(1)
    a1 = F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(rising(LAST_WEIGHT, r) + m1 / F.sqrt("mm"))
    a2 = rising(NEXT_WEIGHT, r) + m2 / F.sqrt("mm")
    weights = norms.select(*keys, a1.alias("a1"), F.when(F.col("n") > 5, a2).alias("a2"), F.col("mm"), m1.alias("m1"), m2.alias("m2"))
    fac = F.when(F.col("a2").isNull(), (F.col("mm") - 2 * F.col("m1") ** 2) / F.nullif(1 - 2 * F.col("a1") ** 2, F.lit(0.0))).otherwise(
        (F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2))
    weights = weights.select(*keys, "a1", "a2", F.sqrt(F.when(fac > 0, fac)).alias("fac"))
    i, n = F.col("i"), F.col("n")
    weight = (
        F.when(i == n, F.col("a1")).when(i == 1, -F.col("a1"))
        .when((i == n - 1) & F.col("a2").isNotNull(), F.col("a2")).when((i == 2) & F.col("a2").isNotNull(), -F.col("a2"))
        .otherwise(F.coalesce(F.col("m") / F.col("fac"), F.lit(0.0)))
    )
    summed = ordered.join(weights, list(by)).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("ss").alias("ss"), F.sum(weight * F.col("x")).alias("s")
    )
    w = F.least(F.col("s") * F.col("s") / F.col("ss"), F.lit(1.0))
    out = summed.select(*keys, "n", w.alias("w"))
    y, lg, nn = F.log(F.when(F.col("w") < 1, 1 - F.col("w"))), F.log(F.col("n").cast("double")), F.col("n").cast("double")
    small = (-F.log(F.when(rising(SMALL_GAMMA, nn) > y, rising(SMALL_GAMMA, nn) - y)) - rising(SMALL_MEAN, nn)) / F.exp(rising(SMALL_SCALE, nn))
    large = (y - rising(LARGE_MEAN, lg)) / F.exp(rising(LARGE_SCALE, lg))
    return out.withColumn("z", F.when(F.col("n") == 3, F.lit(None)).when(F.col("n") <= 11, small).otherwise(large))


def shapiro_p(n: Column, w: Column, z: Column) -> Column:
    exact3 = F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75)))
    return F.when(n == 3, F.greatest(exact3, F.lit(0.0))).when(w >= 1, 1.0).when(z.isNull(), 0.0).otherwise(normal_sf(z))


def one_way(rows: DataFrame, value: str, by: Sequence[str] = PAIR, group: str = "group") -> DataFrame:
    """(by..., k, n, ssb, ssw, f, df1, df2, eta2): one-way analysis of variance from group
    sizes, means and variances."""
    stats = rows.groupBy(*[col(b) for b in by], col(group)).agg(
        F.count(col(value)).cast("double").alias("n"), F.avg(col(value)).alias("m"), F.var_pop(col(value)).alias("v")
    )
    total = W.partitionBy(*[col(b) for b in by])
    grand = F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total)
    sums = stats.withColumn("g", grand).groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw")
    )
    df1, df2 = (F.col("k") - 1).cast("double"), F.col("n") - F.col("k")
    return sums.withColumns({"df1": df1, "df2": df2}).withColumns({
        "f": F.when((F.col("ssw") > 0) & (df2 > 0) & (df1 > 0), (F.col("ssb") / F.nullif(df1, F.lit(0.0))) / (F.col("ssw") / F.nullif(df2, F.lit(0.0)))),
        "eta2": F.col("ssb") / F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0)),
    })


def levene(means: DataFrame, by: Sequence[str] = PAIR, group: str = "group", value: str = "mean") -> DataFrame:
    """(by..., levene, df1, df2): analysis of variance of |x - group mean|."""
    keys = [*by, group]
    centres = means.groupBy(*[col(k) for k in keys]).agg(F.avg(col(value)).alias("_centre"))
    spread = means.join(centres, keys).withColumn("_dev", F.abs(col(value) - F.col("_centre")))
    return one_way(spread, "_dev", by, group).select(*[col(b) for b in by], F.col("f").alias("levene"), "df1", "df2")


def welch_anova(means: DataFrame, by: Sequence[str] = PAIR, group: str = "group", value: str = "mean") -> DataFrame:
    """(by..., welch_f, df1, df2): groups weighted by n / variance."""
    keys = [col(b) for b in by]
    stats = means.groupBy(*keys, col(group)).agg(
        F.count(col(value)).cast("double").alias("n"), F.avg(col(value)).alias("m"), F.var_samp(col(value)).alias("v")
    ).withColumn("w", F.col("n") / F.nullif(F.col("v"), F.lit(0.0)))
    total = W.partitionBy(*keys)
    weighted = stats.withColumns({"ws": F.sum("w").over(total), "g": F.sum(F.col("w") * F.col("m")).over(total) / F.sum("w").over(total)})
    lam = F.sum((1 - F.col("w") / F.col("ws")) ** 2 / F.nullif(F.col("n") - 1, F.lit(0.0)))
    sums = weighted.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("w") * (F.col("m") - F.col("g")) ** 2).alias("b"), lam.alias("lam")).where("k > 1")
    k = F.col("k")
    return sums.select(
        *keys, ((F.col("b") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("lam"))).alias("welch_f"), (k - 1).alias("df1"),
        ((k * k - 1) / F.nullif(3 * F.col("lam"), F.lit(0.0))).alias("df2"),
    )


def numeric_by_category(
    df: DataFrame, id_col: str, categories: Sequence[str] | None = None, numeric: Sequence[str] | None = None, feature: str | None = None, **options
) -> DataFrame:
    """The full verdict per (category column, numeric column): coverage, normality,
    homogeneity, (Welch) ANOVA p-value, partial eta-squared, conclusion."""
    cats = list(categories or categorical_columns(df))
    nums = [c for c in (numeric or numeric_columns(df)) if c != id_col]
    if feature:
        cats, nums = ([feature], nums) if feature in categorical_columns(df) else (cats, [feature])
    means = stored(all_sample_means(df, id_col, cats, nums, **options), "means")  # four tests read them
    normality = shapiro_wilk(means)
    normal = normality.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("num_groups"), F.min(shapiro_p(F.col("n"), F.col("w"), F.col("z"))).alias("min_normal_p")
    )
    total = F.broadcast(value_profile(df, cats).groupBy(F.col("column").alias("cat_column")).agg(F.count(F.lit(1)).alias("n_values")))  # one row per column
    tests = (
        normal.join(total, "cat_column").join(levene(means).select(*PAIR, "levene", F.col("df1").alias("l1"), F.col("df2").alias("l2")), PAIR)
        .join(one_way(means, "mean").select(*PAIR, "f", F.col("df1").alias("a1"), F.col("df2").alias("a2"), "eta2"), PAIR)
        .join(welch_anova(means).select(*PAIR, "welch_f", F.col("df1").alias("w1"), F.col("df2").alias("w2")), PAIR)
    )
    priced = tests.withColumns({
        "homogeneity_p": f_sf(F.col("levene"), F.col("l1"), F.col("l2")), "anova_p": f_sf(F.col("f"), F.col("a1"), F.col("a2")),
        "welch_p": f_sf(F.col("welch_f"), F.col("w1"), F.col("w2")),
    })
    normal_ok, unequal = F.col("min_normal_p") >= SIGNIFICANCE, F.col("homogeneity_p") < SIGNIFICANCE
    p = F.when(unequal, F.col("welch_p")).otherwise(F.col("anova_p"))
    return priced.select(
        *PAIR, "num_groups", F.when(F.col("num_groups") == F.col("n_values"), "Full").otherwise("Partial").alias("full_groups"),
        F.when(normal_ok, "Normal").otherwise("Not Normal").alias("normality"),
        F.when(normal_ok, F.when(unequal, "Unequal").otherwise("Equal")).alias("homogeneity"), F.when(normal_ok, F.col("homogeneity_p")).alias("homogeneity_p"),
        F.when(normal_ok, p).alias("anova_p"), F.when(normal_ok, F.col("eta2")).alias("partial_eta2"),
        F.when(normal_ok, F.when(p < SIGNIFICANCE, "Rejected").otherwise("Failed to Reject")).alias("conclusion"),
    )


def top_numeric_by_category(verdicts: DataFrame, num_groups: int = 5, top: int = 5) -> DataFrame:
    return verdicts.where((F.col("normality") == "Normal") & (F.col("num_groups") <= num_groups)).orderBy(F.desc("partial_eta2"), *PAIR).limit(top)


CATS = ["column_1", "column_2"]


def crosstab(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column_1, column_2, a, b, n, pct): cell counts of every pair in one job, and the
    share of the row. Each input row is combined map-side into at most |a| x |b| cells."""
    listed = F.array(*[F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), col(a).cast("string").alias("a"), col(b).cast("string").alias("b")) for a, b in pairs])
    cells = df.select(F.inline(listed)).where("a is not null and b is not null").groupBy(*CATS, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy(*CATS, "a")) * 100)


def category_pairs(df: DataFrame, max_unique: int = 20, feature: str | None = None) -> list[tuple[str, str]]:
    few = cardinalities(df, categorical_columns(df), max_unique)
    names = [c for c in categorical_columns(df) if c in few and c != feature]
    return [(c, feature) for c in names] if feature else list(combinations(names, 2))


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column_1, column_2, a, b, n, na, nb, rows, cols, total) of the cells that hold rows. The
    input is read once: the counts are stored, and everything else comes from them."""
    cells = stored(crosstab(df, pairs).drop("pct"), "cells")
    left = cells.groupBy(*CATS, "a").agg(F.sum("n").alias("na"))
    right = cells.groupBy(*CATS, "b").agg(F.sum("n").alias("nb"))
    shape = left.groupBy(*CATS).agg(F.count(F.lit(1)).alias("rows"), F.sum("na").alias("total")).join(right.groupBy(*CATS).agg(F.count(F.lit(1)).alias("cols")), CATS)
    return cells.join(left, [*CATS, "a"]).join(right, [*CATS, "b"]).join(F.broadcast(shape), CATS)  # one row per pair


EVENT_ROWS = 100_000  # up to here one task per pair of columns adds up its totals


def expected_shares(cells: DataFrame) -> DataFrame:
    """(column_1, column_2, expected_pct, below_one): the share of all rows x cols cells, empty
    ones too, with an expected count of 5 and more, and how many expect less than 1.

    A row total na expects 5 in every column whose total is at least 5 total / na, so the two
    lists of totals are never combined: the bounds of one list are put among the totals of the
    other, in order, and running sums count the columns below each. In whole numbers throughout.
    """
    side = lambda total_of, value: cells.groupBy(*CATS, value).agg(F.max(total_of).alias("t"), F.max("total").alias("total")).groupBy(*CATS, "t", "total").agg(F.count(F.lit(1)).alias("k"))
    none = F.lit(0).cast("long")
    least = lambda times: F.expr(f"({times} * total + t - 1) div t")  # the smallest total that expects as many
    columns = side("nb", "b").select(*CATS, F.col("t").alias("at"), F.col("k").alias("here"), none.alias("k5"), none.alias("k1"))
    rows = side("na", "a")
    bounds = [rows.select(*CATS, least(5).alias("at"), none.alias("here"), F.col("k").alias("k5"), none.alias("k1")),
              rows.select(*CATS, least(1).alias("at"), none.alias("here"), none.alias("k5"), F.col("k").alias("k1"))]
    events = stored(columns.unionByName(bounds[0]).unionByName(bounds[1]).groupBy(*CATS, "at").agg(*[F.sum(c).alias(c) for c in ("here", "k5", "k1")]), "totals")
    edges = [] if events.limit(EVENT_ROWS + 1).count() <= EVENT_ROWS else None
    counted = prefix_sum(events, "at", {"here": "before"}, CATS, edges=edges, totals={"here": "cols"})
    sums = counted.groupBy(*CATS).agg(F.sum(F.col("k5") * (F.col("cols") - F.col("before"))).alias("enough"), F.sum(F.col("k5") * F.col("cols")).alias("all"), F.sum(F.col("k1") * F.col("before")).alias("below_one"))
    return sums.select(*CATS, (F.col("enough") / F.col("all") * 100).alias("expected_pct"), "below_one")


def binary_tables(cells: DataFrame) -> DataFrame:
    """The four counts p q / s t of every 2x2 table, values in text order."""
    tables = cells.where("rows = 2 and cols = 2")
    ends = tables.groupBy(*CATS).agg(F.min("a").alias("_a"), F.min("b").alias("_b"))
    flags = tables.join(F.broadcast(ends), CATS)  # one row per pair
    cell = lambda r, c: F.sum(F.when(((F.col("a") != F.col("_a")) == r) & ((F.col("b") != F.col("_b")) == c), F.col("n")).otherwise(0)).cast("double")
    return flags.groupBy(*CATS).agg(cell(False, False).alias("p"), cell(False, True).alias("q"), cell(True, False).alias("s"), cell(True, True).alias("t"))


def chi_square(df: DataFrame, pairs: Sequence[tuple[str, str]], cells: DataFrame | None = None) -> DataFrame:
    """(column_1, column_2, chi2, dof, expected_pct, below_one, rows, cols, total), with
    Yates' correction when there is one degree of freedom. Only cells that hold rows are
    built: the empty ones add what the others leave of the total. `cells` are those of
    `contingency`, where they are there already."""
    cells = contingency(df, pairs) if cells is None else cells
    expected = F.col("na") * F.col("nb") / F.col("total")
    gap = F.col("n") - expected
    sums = cells.groupBy(*CATS, "rows", "cols", "total").agg((F.sum(gap * gap / expected) + (F.col("total") - F.sum(expected))).alias("_plain"))
    p, q, s, u = (F.col(x) for x in "pqst")
    n, apart = p + q + s + u, F.abs(p * u - q * s)
    step = apart / n - F.least(apart / n, F.lit(0.5))  # |observed - expected| is the same in all four cells
    yates = step * step * n * n * n / ((p + q) * (s + u) * (p + s) * (q + u))
    corrected = binary_tables(cells).select(*CATS, yates.alias("_yates"))
    joined = sums.join(expected_shares(cells), CATS).join(corrected, CATS, "left")
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("int")
    return joined.select(*CATS, "rows", "cols", "total", F.coalesce("_yates", "_plain").alias("chi2"), dof.alias("dof"), "expected_pct", "below_one")


def phi_coefficient(df: DataFrame, pairs: Sequence[tuple[str, str]], cells: DataFrame | None = None) -> DataFrame:
    """(column_1, column_2, phi) of 2x2 tables, categories in text order."""
    t = binary_tables(contingency(df, pairs) if cells is None else cells)
    p, q, s, u = (F.col(x) for x in "pqst")
    return t.select(*CATS, ((p * u - q * s) / F.nullif(F.sqrt((p + q) * (s + u) * (p + s) * (q + u)), F.lit(0.0))).alias("phi"))


def category_by_category(df: DataFrame, max_unique: int = 20, feature: str | None = None) -> DataFrame:
    """The verdict per pair of low-cardinality columns: chi-squared p, expected-cell rule,
    then phi (2x2) or Cramer's V (n = all rows of the frame)."""
    pairs = category_pairs(df, max_unique, feature)
    if not pairs:
        return literal_rows(df.sparkSession, [], "column_1 string, column_2 string, chi2 double, dof int, p double, expected_pct double, assumptions string, variables string, phi double, cramers_v double")
    n_rows = df.count()
    cells = contingency(df, pairs)
    tests = chi_square(df, pairs, cells).join(phi_coefficient(df, pairs, cells), CATS, "left")
    ok = (F.col("expected_pct") >= 80) & (F.col("below_one") == 0)
    binary = (F.col("rows") == 2) & (F.col("cols") == 2)
    v = F.sqrt(F.col("chi2") / n_rows / F.nullif((F.least("rows", "cols") - 1).cast("double"), F.lit(0.0)))
    return tests.select(
        *CATS, "chi2", "dof", chi2_sf(F.col("chi2"), F.col("dof")).alias("p"), F.round("expected_pct", 2).alias("expected_pct"),
        F.when(ok, "Success").otherwise("Failed").alias("assumptions"), F.when(ok, F.when(binary, "Two Binary").otherwise("At Least 1 Nominal")).alias("variables"),
        F.when(ok & binary, F.col("phi")).alias("phi"), F.when(ok & ~binary, v).alias("cramers_v"),
    )


def top_associations(verdicts: DataFrame, measure: str, top: int = 6) -> DataFrame:
    """(position, column_1, column_2, value) by absolute size; a top-k report."""
    best = verdicts.where(F.col(measure).isNotNull()).orderBy(F.desc(F.abs(F.col(measure))), *CATS).limit(top)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(F.col("value"))), *CATS)
    return best.select(*CATS, F.col(measure).alias("value")).withColumn("position", F.row_number().over(order))
