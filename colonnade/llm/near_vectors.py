"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by the ordered numbers of its nearest pivots (reference vectors drawn from
the table by hash and thinned, so that a dense group has few of them and its members share those).
Inverted lists hold, per label and pivot, the vectors with that pivot among
their nearest; vectors of one list that share enough pivots are candidates and their cosine is
computed. To share `shared` of `nearest` pivots, two vectors must have one in common among their
`nearest - shared + 1` lowest-numbered ones, so only those lists are kept, and a pair is looked at
in its first common list alone. Lists are worked through in blocks of bounded size, as matrix
products inside a task: pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import components, joined_small, left_join_groups, staged

#: Vectors of a list that meet in one task; longer lists are cut into pairs of such blocks.
BLOCK_ROWS = 1_024
#: Vectors drawn for each pivot wanted, before they are thinned, and numbers that they may hold.
DRAWN, DRAWN_NUMBERS = 4, 8_000_000


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded to `width`, and their own lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    sizes, offsets = np.diff(offsets), offsets - offsets[0]
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - offsets[:-1][rows]] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True)), sizes


def thinned(drawn: np.ndarray, cosine: float, most: int) -> np.ndarray:
    """The first of `drawn`, up to `most`, of which no two lie within twice the angle of a link.

    Linked vectors then have the same pivot in or near their group as their nearest, however large
    the group's share of the rows is.
    """
    apart = min(cosine, max(0.5, 2 * cosine * cosine - 1))
    kept, free = [], np.ones(len(drawn), bool)
    while free.any() and len(kept) < most:
        kept.append(int(free.argmax()))
        free &= drawn @ drawn[kept[-1]] < apart
        free[kept[-1]] = False
    return drawn[kept]


def _described(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Adds `nearest`: the numbers of a vector's nearest pivots, nearest first."""
    known = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*classes.schema.fields, T.StructField("nearest", T.ArrayType(T.IntegerType()))])
    at = classes.columns.index("vector")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                some = batch.slice(begin, 2_000)
                close = _matrix(some.column(at), known.value.shape[1])[0] @ known.value.T
                count = min(nearest, close.shape[1])
                top = np.argpartition(-close, count - 1, axis=1)[:, :count]
                order = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
                lists = pa.array(list(np.take_along_axis(top, order, 1).astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=schema.names)

    return classes.mapInArrow(describe, schema)


def _block_links(cosine: float, shared: int, width: int):
    """Links within a block, or between two blocks, of one pivot's list."""

    def link(table: pa.Table) -> pa.Table:
        vectors, sizes = _matrix(table["vector"], width)
        pivot, halves = table["pivot"][0].as_py(), table["half"].to_numpy()
        weights, names = table["weight"].to_numpy(), table["key"].to_pylist()
        nearest = np.array(table["nearest"].to_pylist())
        found, place = np.unique(nearest, return_inverse=True)
        has = np.zeros((len(names), len(found)), np.float32)
        has[np.arange(len(names))[:, None], place.reshape(nearest.shape)] = 1
        before = has[:, found < pivot]
        linked = (vectors @ vectors.T >= cosine) & (has @ has.T >= shared) & (before @ before.T == 0) & (sizes[:, None] == sizes)
        np.fill_diagonal(linked, False)
        if table["first"][0].as_py() != table["second"][0].as_py():
            linked &= halves[:, None] != halves
        label, at = np.arange(len(names)), np.arange(len(names))
        while True:
            low = np.minimum(label, np.where(linked, label, len(names)).min(axis=1))
            if (low == label).all():
                break
            label = low[low]
        any_link = linked.any(axis=1)
        own = at[any_link]
        counts = (linked @ weights)[any_link]
        return pa.table({"key": pa.array([names[i] for i in own], pa.binary()), "links": pa.array(counts, pa.int64()), "near": pa.array([names[label[i]] for i in own], pa.binary())})

    return link


def near_groups(rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", nearest: int = 10, shared: int = 3, most_pivots: int = 4_096) -> DataFrame:
    """One row per row: id, `n_links`, `component_id` (smallest id reachable by links), `kept`.

    Rows link when their labels are equal and not null, their vectors have the same length and a
    cosine of at least `cosine`. A vector that is null, empty or zero, or holds nulls or non-finite
    numbers, has no links. Identical vectors of a label are one entry of the index with a weight. The
    number of pivots follows the square root of the rows, up to `most_pivots`; where rows lie so
    close that thinning leaves fewer, the lists are longer. Only the three columns are read; an
    empty table gives no rows.
    """
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce(x.isNotNull() & F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    name = F.concat(*(F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(salt), "label", "vector")), 16, "0")) for salt in (1, 2)))
    plain = rows.select(F.col(id_col), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    keyed = plain.withColumn("key", F.when(good, name))
    classes = staged(keyed.where("key is not null").groupBy("key", "label", "vector").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("weight")), "vectors")
    width, n = classes.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    if not n:
        return plain.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    count = min(most_pivots, max(16, int(4 * n**0.5)))
    draw = max(count, min(DRAWN * count, DRAWN_NUMBERS // width))
    drawn = _matrix(classes.orderBy(F.xxhash64("key")).limit(draw).select("vector").toArrow()["vector"], width)[0]
    pivots = thinned(drawn, cosine, count)
    described = staged(_described(classes, pivots, nearest), "described")
    kept_lists = F.slice(F.sort_array("nearest"), 1, max(1, nearest - shared + 1))
    postings = described.select("*", F.explode(kept_lists).alias("pivot"))
    sizes = postings.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("key", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = joined_small(postings, staged(sizes, "long_lists"), ["label", "pivot"]).withColumn("own", block)
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    blocks = spread.select("label", "pivot", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "key", "weight", "nearest", "vector", F.col("own").alias("half"))
    few = shared if len(pivots) > nearest else 1
    found = staged(blocks.groupBy("label", "pivot", "first", "second").applyInArrow(_block_links(cosine, few, width), "key binary, links long, near binary"), "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("key").alias("a"), F.col("near").alias("b")))
    named = classes.drop("label", "vector").join(links, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = staged(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("weight").alias("members")).where("members > 1")
    total = named.agg(F.sum("weight")).first()[0]
    grouped = left_join_groups(named.select("key", "weight", "links", "component"), least, "component", "members", total).where("component_id is not null")
    grouped = grouped.select("key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    found_rows = left_join_groups(keyed.select(id_col, "key"), grouped, "key", "weight", total)
    component = F.when(F.col("n_links").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return found_rows.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))
