"""Exact k nearest neighbours without comparing all pairs in one place.

Small training sets (checked by count) travel to the tasks whole. Larger ones are cut into
cells around pivots, as in the block nearest-neighbour join of Lu et al. (2012), with a second
level of pivots above: triangle-inequality bounds say which groups and which of their cells can
hold a neighbour of a query. There are as many cells as the rows need, and cells are cut into tiles of
bounded size, so no task ever holds a whole hot cell. Where the bounds exclude little (wide
vectors), cells are merged, so that a query is copied to a few large ones rather than to most of
many; comparing is then quadratic, in bounded memory. Random projections are the other way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from colonnade.columns import col
from colonnade.operators.ordering import shuffle_hash
from colonnade.session import broadcast_checked, stored

SMALL_CELLS = 2_000_000  # training rows x features that may travel to every task
OUTPUT = "query_id bigint, neighbour_id bigint, distance double"


#: Numbers of one side that a task holds to compare, and rows that are compared at once.
TILE_CELLS, QUERY_ROWS, POINT_ROWS = 4_000_000, 1_024, 4_096
#: Cells that a query meets on the mean before cells are merged, as counted on some queries; tiles
#: of one side of a cell before they grow.
COPIES, SAMPLE, TILES = 24, 1_000, 4
#: Rows whose distances to all centres are held at once, and copies that are made at once.
PLACE_ROWS, CANDIDATES = 256, 20_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = a @ b.T
    square *= -2
    square += (a * a).sum(1)[:, None]
    square += (b * b).sum(1)[None, :]
    np.maximum(square, 0, out=square)
    return np.sqrt(square, out=square)


def exact_distances(queries: np.ndarray, points: np.ndarray, q: np.ndarray, t: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """Of pairs of rows, by plain subtraction, some at a time."""
    parts = [np.sqrt(((queries[q[s:s + rows]] - points[t[s:s + rows]]) ** 2).sum(1)) for s in range(0, len(q), rows)]
    return np.concatenate(parts) if parts else np.zeros(0)


def best_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest points of each query, ties to the smallest id.

    Points are looked at in pieces, and only the k nearest so far are kept. The matrix product only
    shortlists (with a tolerance); the shortlisted distances are recomputed by plain subtraction.
    """
    n = len(queries)
    slack = 1e-6 * (1 + np.abs(points).max() + np.abs(queries).max())
    limit = np.full(n, np.inf)
    q, t, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(points), POINT_ROWS):
        part = points[start:start + POINT_ROWS]
        rough = distances(queries, part)
        if start == 0 and len(part) >= k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
        found, at = np.nonzero(rough <= limit[:, None])
        if not len(found):
            continue
        at += start
        q, t, exact = np.concatenate([q, found]), np.concatenate([t, at]), np.concatenate([exact, exact_distances(queries, points, found, at)])
        order = np.lexsort((ids[t], exact, q))
        q, t, exact = q[order], t[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = place == k - 1
        limit[q[last]] = np.minimum(limit[q[last]], exact[last] + slack)
        keep = place < k
        q, t, exact = q[keep], t[keep], exact[keep]
    return pd.DataFrame({"query_id": query_ids[q], "neighbour_id": ids[t], "distance": exact})


def small_neighbours(train: pd.DataFrame, queries: DataFrame, k: int) -> DataFrame:
    ids, points = train["id"].to_numpy(), np.stack(train["x"].to_numpy())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUERY_ROWS):
                part = batch.iloc[start:start + QUERY_ROWS]
                yield best_k(part["id"].to_numpy(), np.stack(part["x"].to_numpy()), ids, points, k)

    return queries.mapInPandas(search, OUTPUT)


@dataclass
class Pivots:
    """Centres of cells on two levels: every cell belongs to the group of its nearest top centre."""

    tops: np.ndarray
    centres: np.ndarray
    members: list[np.ndarray]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group and cell of every point, and its distance to the centre of either."""
        parts = [self._place(x[s:s + PLACE_ROWS]) for s in range(0, len(x), PLACE_ROWS)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        to_tops = distances(x, self.tops)
        group = to_tops.argmin(1)
        cell, r = np.empty(len(x), np.int64), np.empty(len(x))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            d = distances(x[at], self.centres[self.members[g]])
            best = d.argmin(1)
            cell[at], r[at] = self.members[g][best], d[np.arange(len(at)), best]
        return group, cell, to_tops[np.arange(len(x)), group], r


def choose_pivots(train: DataFrame, cells: int) -> Pivots:
    centres = np.stack(train.orderBy(shuffle_hash("id"), "id").limit(cells).toPandas()["x"].to_numpy())
    tops = centres[:max(1, math.isqrt(len(centres)))]
    group = distances(centres, tops).argmin(1)
    return Pivots(tops, centres, [np.flatnonzero(group == g) for g in range(len(tops))])


@dataclass
class Bounds:
    """What is known of the rows of every cell and group: how far they are from the centre."""

    high: np.ndarray
    low: np.ndarray
    group_high: np.ndarray
    group_low: np.ndarray
    #: Per group, of some of its rows: their cell and how far from its centre they are at most.
    owner: list[np.ndarray]
    radii: list[np.ndarray]
    slack: float

    def cells_of(self, x: np.ndarray, pivots: Pivots, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): the cells that may hold one of the k nearest rows of each query."""
        tops = pivots.tops
        to_tops = distances(x, tops)
        limit = np.full(len(x), np.inf)
        # the first groups, by distance, that together hold k known rows bound the k-th distance
        order = to_tops.argsort(1)
        for first in np.unique(order[:, 0]):
            at = np.flatnonzero(order[:, 0] == first)
            near = distances(tops[first][None], tops)[0].argsort(kind="stable")
            owner, radii = [], []
            for g in near:
                owner.append(self.owner[g])
                radii.append(self.radii[g])
                if sum(map(len, radii)) >= k:
                    break
            owner, radii = np.concatenate(owner), np.concatenate(radii)
            if len(radii) >= k:
                reach = distances(x[at], pivots.centres[owner]) + radii
                limit[at] = np.partition(reach, k - 1, 1)[:, k - 1]
        limit = (limit + self.slack)[:, None]
        queries, cells = [], []
        far = np.maximum(to_tops - self.group_high, self.group_low - to_tops) <= limit
        for g, members in enumerate(pivots.members):
            at = np.flatnonzero(far[:, g])
            if len(at) and len(members):
                d = distances(x[at], pivots.centres[members])
                q, c = np.nonzero(np.maximum(d - self.high[members], self.low[members] - d) <= limit[at])
                queries.append(at[q])
                cells.append(members[c])
        return (np.concatenate(queries), np.concatenate(cells)) if queries else (np.zeros(0, int), np.zeros(0, int))


MAX_CELLS = 16_384  # centres that travel to every task
PLACED = "id bigint, x array<double>, cell bigint"


def fit_bounds(placed: DataFrame, pivots: Pivots, k: int) -> Bounds:
    """From one row per cell and the k innermost rows of each: at most MAX_CELLS * (k + 1) rows."""
    sizes = placed.groupBy("cell").agg(F.first("group").alias("group"), F.max("r").alias("hi"), F.min("r").alias("lo"), F.max("r_top").alias("top_hi"), F.min("r_top").alias("top_lo")).toPandas()

    def innermost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"cell": pd.Series(dtype=int), "r": pd.Series(dtype=float)})
        for batch in batches:
            kept = pd.concat([kept, batch]).sort_values("r").groupby("cell").head(k)
        yield kept

    inner = placed.select("cell", "r").mapInPandas(innermost, "cell bigint, r double")
    inner = inner.withColumn("i", F.row_number().over(W.partitionBy("cell").orderBy("r"))).where(F.col("i") <= k).toPandas()
    n, groups = len(pivots.centres), len(pivots.tops)
    slack = 1e-6 * (1 + np.abs(pivots.centres).max() + float(sizes["top_hi"].max()))
    high, low, group_high, group_low = np.full(n, -np.inf), np.full(n, np.inf), np.full(groups, -np.inf), np.full(groups, np.inf)
    cell, group = sizes["cell"].to_numpy(), sizes["group"].to_numpy()
    high[cell], low[cell] = sizes["hi"] + slack, sizes["lo"] - slack
    np.maximum.at(group_high, group, sizes["top_hi"].to_numpy() + slack)
    np.minimum.at(group_low, group, sizes["top_lo"].to_numpy() - slack)
    of_group = np.zeros(n, int)
    for g, members in enumerate(pivots.members):
        of_group[members] = g
    owner, radii = inner["cell"].to_numpy(), inner["r"].to_numpy() + slack
    mine = [np.flatnonzero(of_group[owner] == g) for g in range(groups)]
    return Bounds(high, low, group_high, group_low, [owner[m] for m in mine], [radii[m] for m in mine], slack)


def search_tiles(placed: DataFrame, wanted: DataFrame, k: int, tile: int) -> DataFrame:
    """The k best of every query among the rows of its cells. Both are (id, x, cell), and stored.

    A cell is cut into tiles of about `tile` rows on both sides, by its own counts, so a row is
    copied as often as the other side of its cells has tiles: while cells keep their size,
    copies do not grow with the tables. The tiles of a larger cell grow with it, so that there are
    TILES of them, until a task holds TILE_CELLS numbers of a side.
    """
    first = placed.select(F.size("x").alias("n")).first()
    most = max(tile, TILE_CELLS // max(first["n"], 1) if first else tile)

    def tiles(df: DataFrame, out: str) -> DataFrame:
        n = F.count(F.lit(1))
        size = F.greatest(F.lit(tile), F.least(F.ceil(n / F.lit(TILES)), F.lit(most)))
        return df.groupBy("cell").agg(F.ceil(n / size).cast("int").alias(out))

    table = stored(tiles(placed, "t_tiles").join(tiles(wanted, "q_tiles"), "cell"), "tiles")
    deal = lambda df, own, other: df.join(broadcast_checked(table), "cell").select(
        "id", "x", "cell", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
    keys = ["cell", "t_tiles", "q_tiles"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbour_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})
        ids, points = right["id"].to_numpy(), np.stack(right["x"].to_numpy())
        return pd.concat([
            best_k(part["id"].to_numpy(), np.stack(part["x"].to_numpy()), ids, points, k)
            for part in (left.iloc[s:s + QUERY_ROWS] for s in range(0, len(left), QUERY_ROWS))
        ])

    found = deal(wanted, "q_tiles", "t_tiles").groupBy(*keys).cogroup(deal(placed, "t_tiles", "q_tiles").groupBy(*keys)).applyInPandas(search, OUTPUT)
    nearest = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r")


def merged_cells(bounds: Bounds, pivots: Pivots, sample: np.ndarray, sizes: np.ndarray, k: int, most: int) -> tuple[np.ndarray, int]:
    """Per cell the number of the merged cell that takes it in, and about how many rows these hold (0:
    cells stay as they are). Runs of cells, group by group, are doubled until a sampled query meets
    at most COPIES of them on the mean, or a run holds `most` rows."""
    order = np.concatenate(pivots.members)
    held = np.empty(len(order), np.int64)
    held[order] = np.cumsum(sizes[order]) - sizes[order]  # rows of the cells before it
    parts = [bounds.cells_of(sample[s:s + PLACE_ROWS], pivots, k) for s in range(0, len(sample), PLACE_ROWS)]
    met = [(q + i * PLACE_ROWS, c) for i, (q, c) in enumerate(parts)]
    q, c = (np.concatenate(p) for p in zip(*met)) if met else (np.zeros(0, int), np.zeros(0, int))
    merged, rows, total = np.arange(len(order)), 0, int(sizes.sum())
    while len(q) and len(np.unique(q * len(order) + merged[c])) > COPIES * len(sample) and rows < min(most, total):
        rows = min(2 * (rows or max(1, total // len(order))), most)
        merged = np.unique(held // rows, return_inverse=True)[1]
    return merged, rows


def tiled_neighbours(train: DataFrame, queries: DataFrame, k: int, n_train: int, pivots: int | None, tile: int) -> DataFrame:
    """Exact neighbours by cells: as many of them as give cells of about half a tile, fewer where the
    bounds would send a query to most of them."""
    chosen = choose_pivots(train, min(pivots or max(64, 2 * n_train // tile), MAX_CELLS, n_train))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                group, cell, r_top, r = chosen.place(np.stack(batch["x"].to_numpy()))
                yield batch.assign(cell=cell, group=group, r_top=r_top, r=r)

    placed = stored(train.mapInPandas(assign, f"{PLACED}, group bigint, r_top double, r double"), "placed")
    bounds, sizes = fit_bounds(placed, chosen, k), np.zeros(len(chosen.centres), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    # how many cells some queries meet only says how cells are laid out; results are exact whatever it is
    some = [r["x"] for r in queries.orderBy(shuffle_hash("id"), "id").limit(SAMPLE).select("x").collect()]
    merged, rows = merged_cells(bounds, chosen, np.array(some, float).reshape(len(some), -1), sizes, min(k, n_train), max(tile, TILE_CELLS // max(chosen.centres.shape[1], 1)))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PLACE_ROWS):
                part = batch.iloc[start:start + PLACE_ROWS]
                q, c = bounds.cells_of(np.stack(part["x"].to_numpy()), chosen, min(k, n_train))
                q, c = np.divmod(np.unique(q * len(merged) + merged[c]), len(merged))
                for at in range(0, len(q), CANDIDATES):
                    yield part.iloc[q[at:at + CANDIDATES]].assign(cell=c[at:at + CANDIDATES])

    wanted = stored(queries.mapInPandas(candidates, PLACED), "wanted")
    points = placed.select("id", "x", "cell")
    if rows:
        numbers = train.sparkSession.createDataFrame(list(enumerate(merged.tolist())), "cell bigint, _merged bigint")
        points = points.join(F.broadcast(numbers), "cell").select("id", "x", F.col("_merged").alias("cell"))
    return search_tiles(points, wanted, k, max(tile, rows))


def approximate_neighbours(
    train: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5, tables: int = 12, projections: int = 4, width: float | None = None, tile: int = 20_000, seed: int = 42
) -> DataFrame:
    """(query_id, neighbour_id, distance): near rows by locality-sensitive hashing.

    Each of `tables` hashes a row by `projections` random directions cut into steps of `width`
    (by default four times the typical distance to the k-th neighbour in a sample of 2,000 rows).
    Rows that share a hash with a query are compared exactly, so distances are exact and
    what may be missing are neighbours: `recall` measures it. A query may get fewer than k rows.
    """
    points, asked = shaped(train, id_col, vector), shaped(queries, id_col, vector)
    some = points.orderBy(shuffle_hash("id"), "id").limit(2_000).toPandas()
    if not len(some):
        raise ValueError("no training rows")
    sample = np.stack(some["x"].to_numpy())
    if width is None:
        d = np.sort(distances(sample[:200], sample), 1)
        width = 4 * float(np.median(d[:, min(k, len(sample) - 1)])) or 1.0
    draw = np.random.RandomState(seed)
    directions = draw.normal(size=(sample.shape[1], tables * projections))
    starts, mix = draw.uniform(0, width, tables * projections), draw.randint(1, 2**62, (tables, projections)) | 1

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                steps = np.floor((np.stack(batch["x"].to_numpy()) @ directions + starts) / width).astype(np.int64)
                for t in range(tables):
                    with np.errstate(over="ignore"):
                        cell = (steps[:, t * projections:(t + 1) * projections] * mix[t]).sum(1) * np.int64(tables) + t
                    yield batch.assign(cell=cell)

    placed, wanted = (stored(df.mapInPandas(hashed, PLACED), name) for df, name in ((points, "placed"), (asked, "wanted")))
    met = search_tiles(placed, wanted, k * tables, tile).groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    nearest = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return met.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query, neighbour) pairs that were found."""
    pairs = exact.select("query_id", "neighbour_id")
    hits, total = pairs.join(found.select("query_id", "neighbour_id", F.lit(1).alias("_hit")), ["query_id", "neighbour_id"], "left").agg(F.count("_hit"), F.count(F.lit(1))).first()
    return hits / total if total else 1.0


def shaped(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(col(id_col).cast("long").alias("id"), col(vector).cast("array<double>").alias("x"))


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5, small_cells: int = SMALL_CELLS, pivots: int | None = None, tile: int = 20_000
) -> DataFrame:
    """(query_id, neighbour_id, distance): the exact k nearest training rows by Euclidean
    distance, ties to the smaller id. `vector` is an array column."""
    points, asked = shaped(train, id_col, vector), shaped(queries, id_col, vector)
    n_train = points.count()
    if n_train == 0:
        raise ValueError("no training rows")
    width = len(points.first()["x"])
    if n_train * width <= small_cells:
        return small_neighbours(points.toPandas(), asked, k)
    return tiled_neighbours(points, asked, k, n_train, pivots, tile)


def knn_classify(train: DataFrame, queries: DataFrame, id_col: str, vector: str, label: str, k: int = 5, **options) -> DataFrame:
    """(query_id, class, votes, proba, pred): majority vote, ties to the smallest class."""
    found = nearest_neighbours(train, queries, id_col, vector, k, **options)
    labels = train.select(col(id_col).cast("long").alias("neighbour_id"), col(label).alias("class"))
    votes = found.join(labels, "neighbour_id").groupBy("query_id", "class").agg(F.count(F.lit(1)).alias("votes"))
    per_query = W.partitionBy("query_id")
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col("class").alias("c"))).over(per_query)
    return votes.select("query_id", "class", "votes", (F.col("votes") / F.sum("votes").over(per_query)).alias("proba"), best["c"].alias("pred"))


def knn_regress(train: DataFrame, queries: DataFrame, id_col: str, vector: str, label: str, k: int = 5, **options) -> DataFrame:
    """(query_id, pred): mean label of the k nearest."""
    found = nearest_neighbours(train, queries, id_col, vector, k, **options)
    labels = train.select(col(id_col).cast("long").alias("neighbour_id"), col(label).cast("double").alias("y"))
    return found.join(labels, "neighbour_id").groupBy("query_id").agg(F.avg("y").alias("pred"))
