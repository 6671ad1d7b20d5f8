"""Pairwise-complete sums of many columns at once: blocked Gram matrices over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colonnade.columns import col, present
from colonnade.session import stored

TILE = 1_000       # columns on a side of one block of the matrix
BATCH_CELLS = 2_000_000
FLAT = 1e-12       # share of a sum of squares below which a variance is rounding
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")


def block_sums(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The sums over the rows that both columns have, for all left x right columns; NaN is
    missing. `odd` counts rows where either is infinite, which are left out of the others."""
    (x, mx, ix), (y, my, iy) = (_parts(m) for m in (left, right))
    out = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
    if ix.any() or iy.any():
        # infinite values are present but not finite: rows of a pair are odd if one of the two is
        px, py = mx + ix, my + iy
        out.append(px.T @ py - mx.T @ my)
    else:
        out.append(np.zeros_like(out[0]))
    return out


def _parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    finite = np.isfinite(m)
    return np.where(finite, m, 0.0), finite.astype(float), np.isinf(m).astype(float)


def correlations_of(sums: np.ndarray) -> np.ndarray:
    """Pearson's r out of the sums (in the order of `SUMS`, along the first axis): NaN where a
    column is constant (to be shown as null) and infinity where a value is infinite."""
    n, sx, sy, sxx, syy, sxy, odd = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        r = np.where((vx > FLAT * sxx) & (vy > FLAT * syy), cov / np.sqrt(vx * vy), np.nan)
    return np.where(odd > 0, np.inf, np.clip(r, -1, 1))


def column_centres(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """A number near the middle of every column, so that squares do not swamp the variance."""
    row = df.agg(*[F.avg(F.when(F.abs(present(df, c).cast("double")) < float("inf"), present(df, c).cast("double"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return np.array([float(v) if v is not None else 0.0 for v in row])


def pairwise(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]], shift: np.ndarray, change: Callable[[np.ndarray, list[int]], np.ndarray] | None = None) -> DataFrame:
    """(first, second, r): Pearson of the listed pairs of column numbers, first below second.

    Columns are cut into tiles; for two tiles one scan adds up a block of sums per task (a few at a
    time, so blocks are few however many splits the input has), and each row of the block is
    summed by the task that its number falls to. Nothing is gathered in one place. `change`
    replaces a matrix of values, given its column numbers (say by ranks), before it is summed.
    """
    wanted: dict[int, list[int]] = {}
    for a, b in pairs:
        wanted.setdefault(a, []).append(b)
    parts = []
    tiles = [range(i, min(i + TILE, len(columns))) for i in range(0, len(columns), TILE)]
    for s, first in enumerate(tiles):
        for second in tiles[s:]:
            rows = {a: [b for b in wanted.get(a, ()) if b in second] for a in first}
            if any(rows.values()):
                parts.append(_block(df, columns, first, second, {a: np.array(b) for a, b in rows.items() if b}, shift, change))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(df, columns, first, second, rows, shift, change) -> DataFrame:
    spark = df.sparkSession
    used = list(first) if first == second else [*first, *second]
    moved = shift[used]
    values = df.select(*[present(df, columns[c]).cast("double").alias(f"c{c}") for c in used])
    few = 4 * spark.sparkContext.defaultParallelism
    values = values.coalesce(few)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, BATCH_CELLS // len(used))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = np.stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in part.columns], 1)
                m = change(m, used) if change else m - moved
                sums = np.stack(block_sums(m[:, :len(first)], m[:, -len(second):]))
                total = sums if total is None else total + sums
        if total is not None:
            for i, a in enumerate(first):
                if a in rows:
                    held = total[:, i, rows[a] - second[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([held.ravel()])], names=["first", "sums"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = sums.values.to_numpy()
                held[a] = held[a] + v if a in held else v
        for a, v in held.items():
            r = correlations_of(v.reshape(len(SUMS), -1))
            shown = pa.array([None if np.isnan(x) else float("nan") if np.isinf(x) else float(x) for x in r], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), a)), pa.array(rows[a]), shown], names=["first", "second", "r"])

    sums = values.mapInArrow(add, "first long, sums array<double>")
    return sums.repartition("first").mapInArrow(finish, "first long, second long, r double")


def pearson_matrix(df: DataFrame, pairs: Sequence[tuple[str, str]], shift: np.ndarray | None = None, change: Callable[[np.ndarray, list[int]], np.ndarray] | None = None) -> DataFrame:
    """(column_1, column_2, r) of any number of pairs, from one scan per block of columns.

    The pairs that hold rows without a missing value count; a constant column gives null, an
    infinite value NaN. Stored, as it is the size of the answer.
    """
    names = sorted({c for p in pairs for c in p})
    place = {c: i for i, c in enumerate(names)}
    turned = {(min(place[a], place[b]), max(place[a], place[b])): None for a, b in pairs}
    shift = column_centres(df, names) if shift is None else shift
    found = stored(pairwise(df, names, [*turned], shift, change), "correlations")
    spark = df.sparkSession
    asked = spark.createDataFrame(pa.table({"column_1": [a for a, _ in pairs], "column_2": [b for _, b in pairs],
                                            "first": [min(place[a], place[b]) for a, b in pairs], "second": [max(place[a], place[b]) for a, b in pairs]}))
    return asked.join(found, ["first", "second"], "left").select("column_1", "column_2", "r")
