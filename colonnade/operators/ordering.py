"""Ranks, prefix sums, exact samples and exact quantiles without a global sort.

Every operator here splits an ordered group into buckets, totals the buckets (a small
pre-aggregated table), and finishes inside each bucket. A group that holds most of the
rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colonnade.columns import col, long_values, present
from colonnade.session import broadcast_checked, stored

MANY_GROUPS = 100_000   # groups whose cut-offs are broadcast
HOT_KEYS = 200          # keys above total/HOT_KEYS rows are hot: at most HOT_KEYS of them exist
SMALL_ROWS, SMALL_CELLS = 2_000_000, 16_000_000  # rows and cells up to which the in-memory percentile aggregate is used


def group_key(by: Sequence[str]) -> Column:
    """One non-null key for any number of (nullable) grouping columns."""
    return F.struct(*[col(b) for b in by]) if by else F.lit(0)


def shuffle_hash(id_col: str, seed: int = 42) -> Column:
    """Pseudo-random order that depends only on the id, not on partitioning or engine."""
    return F.md5(F.concat(col(id_col).cast("string"), F.lit(f"-{seed}")))


def default_buckets(df: DataFrame) -> int:
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, min(4000, wanted))


def range_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles used only to cut a range into buckets; never part of a result.

    A bucket between two edges holds about 1/buckets of the rows of `df`, whether `df` is
    the raw rows or the values merged from them.
    """
    return column_edges(df, [value], buckets)[value]


def column_edges(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """The same for several columns in one pass; nulls and NaN are ignored."""
    n = buckets or default_buckets(df)
    if n < 2:
        return {c: [] for c in columns}
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = df.agg(*[F.percentile_approx(present(df, c).cast("double"), probs, max(100, 4 * n)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(q or [])) for c, q in zip(columns, row)}


def with_bucket(df: DataFrame, value: str, edges: list[float], out: str = "_bucket") -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0))
    source = f"{out}_src"
    cut = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=source, outputCol=f"{out}_d", handleInvalid="keep"
    )
    # -0.0 and 0.0 are one value, but the search for its bucket would tell them apart
    widened = cut.transform(df.withColumn(source, col(value).cast("double") + F.lit(0.0)))
    # declared non-null: otherwise joins on the bucket push a null filter into one of the
    # two reads of the input, which then no longer share their shuffle
    return widened.withColumn(out, F.coalesce(F.col(f"{out}_d").cast("int"), F.lit(-1))).drop(source, f"{out}_d")


def prefix_sum(
    df: DataFrame, value: str, weights: dict[str, str], by: Sequence[str] = (), buckets: int | None = None,
    edges: list[float] | None = None, totals: dict[str, str] | None = None, bucket: str | None = None,
) -> DataFrame:
    """Sum of each weight over the rows of the group that come strictly before, by `value`.

    Values must be unique within a group (aggregate first). `weights` maps weight column
    to output column; `totals` maps it to a column for the whole-group sum. The in-bucket
    window and the join to the bucket offsets share one shuffle, as both are keyed by
    (group, bucket). Pass `edges` where they can be had without evaluating `df`, or name the
    column `bucket` that cuts each group by its own edges (it grows with the value; it is dropped).
    """
    if bucket:
        cut = df.withColumnRenamed(bucket, "_bucket").withColumn("_g", group_key(by))
        df = df.drop(bucket)
    else:
        edges = range_edges(df, value, buckets) if edges is None else edges
        cut = with_bucket(df, value, edges).withColumn("_g", group_key(by))
    sums = cut.groupBy("_g", "_bucket").agg(*[F.sum(col(w)).alias(f"_t_{w}") for w in weights])
    whole = W.partitionBy("_g")
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals or {}
    offsets = sums.select(
        "_g", "_bucket", *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"_w_{w}") for w in totals],
    )
    local = W.partitionBy("_g", "_bucket").orderBy(col(value)).rowsBetween(W.unboundedPreceding, -1)
    inside = cut.withColumns(
        {f"_i_{w}": F.coalesce(F.sum(col(w)).over(local), F.lit(0)) for w in weights}
    )
    joined = inside.join(offsets, ["_g", "_bucket"])
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_i_{w}") + F.col(f"_o_{w}")).alias(out) for w, out in weights.items()],
        *[F.col(f"_w_{w}").alias(out) for w, out in totals.items()],
    )


BUCKET_ROWS = 1_000_000  # rows of a group that one task ranks at most (unless they share one id)


def hash_digits(rows: int) -> int:
    """Hex digits of the hash that cut `rows` rows into buckets of at most BUCKET_ROWS."""
    return max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16) + 0.5))


def hash_rank(
    df: DataFrame, id_col: str, by: Sequence[str] = (), seed: int = 42, digits: int | None = None, out: str = "rank"
) -> DataFrame:
    """Exact shuffled row number 1..n within each group, in md5 order.

    The first hex digits of the hash are the bucket (evenly filled; as many as the number of
    rows needs), so one huge stratum is still ranked by many tasks.
    """
    digits = hash_digits(df.count()) if digits is None else digits
    cut = df.withColumns(
        {"_h": F.coalesce(shuffle_hash(id_col, seed), F.lit("")), "_g": group_key(by)}
    ).withColumn("_bucket", F.coalesce(F.substring("_h", 1, digits), F.lit("")))
    totals = cut.groupBy("_g", "_bucket").agg(F.count(F.lit(1)).alias("_t"))
    earlier = W.partitionBy("_g").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_g", "_bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    local = W.partitionBy("_g", "_bucket").orderBy("_h", col(id_col))
    ranked = cut.withColumn("_r", F.row_number().over(local)).join(offsets, ["_g", "_bucket"])
    return ranked.select(*[col(c) for c in df.columns], (F.col("_r") + F.col("_o")).cast("long").alias(out))


def hash_cutoffs(keyed: DataFrame, frac: float) -> DataFrame:
    """(_g, _n, _edge, _left): per group the hash prefix that the cut-off falls into, and how many
    rows of it are still wanted. Prefixes grow by two digits, for the rows at the cut-off
    alone, until no group has more than BUCKET_ROWS rows there."""
    length, rows, edges = 2, keyed, None
    while True:
        totals = rows.groupBy("_g", F.substring("_h", 1, length).alias("_p")).agg(F.count(F.lit(1)).alias("_t"))
        whole = W.partitionBy("_g")
        upto = F.sum("_t").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
        if edges is None:
            counted = totals.withColumn("_n", F.sum("_t").over(whole)).withColumn("_want", F.round(F.lit(frac) * F.col("_n")).cast("long"))
        else:
            counted = totals.join(broadcast_checked(edges.select("_g", "_n", F.col("_left").alias("_want"))), "_g")
        found = counted.withColumn("_upto", upto).where("_upto >= _want and _upto - _t < _want")
        edges = stored(found.select("_g", "_n", F.col("_p").alias("_edge"), (F.col("_want") - F.col("_upto") + F.col("_t")).alias("_left"), "_t"), "cutoffs")
        most = edges.agg(F.max("_t")).first()[0]
        if most is None or most <= BUCKET_ROWS or length >= 32:
            return edges.drop("_t")
        rows = keyed.join(broadcast_checked(edges.select("_g", "_edge")), "_g").where(F.substring("_h", 1, length) == F.col("_edge")).drop("_edge")
        length += 2


def hash_sample(df: DataFrame, id_col: str, frac: float, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Exactly round(frac * n) rows of every group: the first ones in md5 order.

    Rows whose hash lies below their group's cut-off pass without any shuffle; only the one
    bucket that the cut-off falls into, of at most BUCKET_ROWS rows, is ranked.
    """
    key = F.to_json(F.struct(*[col(b).cast("string").alias(f"g{i}") for i, b in enumerate(by)])) if by else F.lit("")
    cut = df.withColumns({"_h": F.coalesce(shuffle_hash(id_col, seed), F.lit("")), "_g": key})
    edges = hash_cutoffs(cut.select("_g", "_h"), frac)
    few = edges.limit(MANY_GROUPS + 1).count() <= MANY_GROUPS
    marked = cut.join(F.broadcast(edges.drop("_n")), "_g", "left") if few else spread_left_join(cut, edges, "_g", "_n")
    prefix = F.substring("_h", 1, F.length("_edge"))
    keep = [col(c) for c in df.columns]
    at_edge = marked.where(prefix == F.col("_edge")).withColumn(
        "_r", F.row_number().over(W.partitionBy("_g").orderBy("_h", col(id_col)))
    ).where("_r <= _left")
    return marked.where(prefix < F.col("_edge")).select(*keep).unionByName(at_edge.select(*keep))


def skew_join(df: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows to a per-key table when some keys may hold a large share of rows.

    `weight` is the number of rows of `df` per key, summing to `total`, so at most
    HOT_KEYS keys can reach total/HOT_KEYS rows. Their rows meet a broadcast of that many
    table rows where they are; all other rows go through a shuffle join. No random salt is
    involved (equal rows could not be salted reproducibly), so a retried task gives the
    same rows.
    """
    hot_rule = F.col(weight) * F.lit(HOT_KEYS) >= F.lit(max(total, 1))
    hot, cold = table.where(hot_rule), table.where(~hot_rule)
    spread_out = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return df.join(F.broadcast(hot), keys).unionByName(spread_out.join(cold, keys)).select(
        *[col(c) for c in df.columns], *[col(c) for c in table.columns if c not in keys]
    )


def spread_left_join(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows left-joined with a table of one row per non-null `key`, whatever a key's share.

    Keys with at least 1/HOT_KEYS of the summed `weight` (so at most HOT_KEYS of them) are
    broadcast. Their rows, and rows without a key, then have nothing to meet in the shuffle
    join of the others and are dealt out by a hash of the row. Adds the table's columns but
    `key` and `weight`.
    """
    extra = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot_rule = F.col(weight) * F.lit(HOT_KEYS) >= F.lit(max(total, 1))
    hot = table.where(hot_rule).select(col(key), F.lit(True).alias("_hot"), *[col(c).alias(f"_hot_{c}") for c in extra])
    cold = table.where(~hot_rule).select(F.hex(col(key)).alias("_to"), *[col(c).alias(f"_cold_{c}") for c in extra])
    first = df.join(F.broadcast(hot), key, "left")
    alone = F.concat(F.lit("-"), F.xxhash64(*[col(c) for c in df.columns]).cast("string"))
    spread = F.when(F.col("_hot").isNotNull() | col(key).isNull(), alone).otherwise(F.hex(col(key)))
    both = first.withColumn("_from", spread).join(cold, F.col("_from") == F.col("_to"), "left")
    return both.select(*[col(c) for c in df.columns], *[F.when(F.col("_hot"), col(f"_hot_{c}")).otherwise(col(f"_cold_{c}")).alias(c) for c in extra])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., value, n, rank): the tie-averaged 1-based rank of every distinct value."""
    counts = df.groupBy(*[col(b) for b in by], col(value)).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(counts, value, {"n": "before"}, by, edges=range_edges(df, value, buckets)).select(
        *[col(b) for b in by], col(value), "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")
    )


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    ranks = average_ranks(df, value, by).withColumnRenamed("rank", out)
    return skew_join(df, ranks, [*by, value], "n", df.count()).drop("n")


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
    exact: bool = True, small_rows: int = SMALL_ROWS, buckets: int | None = None,
) -> DataFrame:
    """(by..., column, n, q): linearly interpolated quantiles of numeric columns.

    Up to `small_rows` rows (and SMALL_CELLS cells) the built-in percentile, a map of
    distinct values per group, does it in one aggregate. Beyond that the same numbers come from selection:
    count buckets, find the buckets that hold the wanted order statistics, and sort only
    those. `exact=False` uses the mergeable sketch.
    """
    keys = [*by, "column"]
    cells = long_values(df, list(columns), list(by), "double").where("value is not null")
    array = F.array(*[F.lit(float(p)) for p in probs])
    if not exact:
        return cells.groupBy(*[col(k) for k in keys]).agg(
            F.count("value").alias("n"), F.percentile_approx("value", array, 10000).alias("q")
        )
    rows = df.count()
    if rows <= small_rows and rows * len(columns) <= SMALL_CELLS:
        return cells.groupBy(*[col(k) for k in keys]).agg(
            F.count("value").alias("n"), F.percentile("value", array).alias("q")
        )
    parts = []
    edges = column_edges(df, columns, buckets)
    for c in columns:
        one = df.select(*[col(b) for b in by], col(c).cast("double").alias("value")).where("value is not null and not isnan(value)")
        parts.append(with_bucket(one, "value", edges[c]).select(*[col(b) for b in by], F.lit(c).alias("column"), "value", "_bucket"))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return select_order_statistics(cells, keys, probs)


def select_order_statistics(cells: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    cut = cells.withColumn("_g", group_key(keys)).select("_g", "value", "_bucket")
    totals = cut.groupBy("_g", "_bucket").agg(F.count(F.lit(1)).alias("_t"))
    whole = W.partitionBy("_g")
    running = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = totals.withColumns(
        {"_before": F.coalesce(F.sum("_t").over(running), F.lit(0)), "n": F.sum("_t").over(whole)}
    )
    wanted = (
        counted.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
        .withColumn("_pos", (F.col("n") - 1) * F.col("_p"))
        .select("*", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_k"))
        .where("_k >= _before and _k < _before + _t")
        .distinct()
    )
    targets = wanted.groupBy("_g", "_bucket").agg(F.first("_before").alias("_before"))
    values = cut.join(targets, ["_g", "_bucket"]).groupBy("_g", "_bucket", "_before", "value").agg(F.count(F.lit(1)).alias("_c"))
    local = W.partitionBy("_g", "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    placed = values.withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_c").over(local), F.lit(0))).select(
        "_g", "_bucket", "value", "_lo", (F.col("_lo") + F.col("_c")).alias("_hi")
    )
    picked = wanted.select("_g", "_bucket", "n", "_i", "_pos", "_k").join(placed, ["_g", "_bucket"]).where("_k >= _lo and _k < _hi")
    each = picked.groupBy("_g", "n", "_i", "_pos").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    point = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return (
        each.groupBy("_g", "n")
        .agg(F.array_sort(F.collect_list(F.struct("_i", point.alias("q")))).alias("_qs"))
        .select(*[F.col("_g").getField(k).alias(k) for k in keys], "n", F.col("_qs.q").alias("q"))
    )
