"""Best-fit packing by minimum bin slack.

Lengths are at most the capacity, so the whole corpus is described by one count per length. Over
these counts each bin is filled by subset-sum dynamic programming: a bitset per length holds the
sums that lengths up to it can reach, the largest reachable sum within the capacity is the fullest
combination, and among equals the one with the longest pieces is read back. The combination is
removed as often as its counts allow, which leaves at most a few thousand different combinations
however many rows there are. Each piece then finds its bin from its rank among the pieces of its
length: ranks are task-local counts plus offsets, so no piece is sorted or moved to do so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.llm.common import staged
from colonnade.llm.tokens import crc32, encoder, slices

#: A combination: how often it is used, and its lengths with their multiplicities.
Bin = tuple[int, list[tuple[int, int]]]


def fill_bins(counts: dict[int, int], capacity: int, longest_first: bool = False) -> list[Bin]:
    """Combinations that use up `counts` (pieces by length), by minimum bin slack.

    With `longest_first` each bin must hold the longest piece left and the search fills the rest;
    without, the fullest combination of any lengths is taken.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    everything = (1 << (capacity + 1)) - 1
    bins: list[Bin] = []
    lengths, reach, valid = sorted(left), [1], 0
    while lengths:
        for n in lengths[valid:]:  # sums reached by lengths up to n, each at most as often as it is left
            sums, copies, step = reach[-1], min(left[n], capacity // n), 1
            while copies:
                take = min(step, copies)
                sums |= (sums << (take * n)) & everything
                copies, step = copies - take, step * 2
            reach.append(sums)
        used: dict[int, int] = {}
        room = capacity
        if longest_first:
            used[lengths[-1]] = 1
            room -= lengths[-1]
            target = room - _gap(_reach_without_one(reach, lengths, left, everything), room)
        else:
            target = room - _gap(reach[-1], room)
        for at in range(len(lengths) - 1, -1, -1):
            n = lengths[at]
            most = min(left[n] - used.get(n, 0), target // n)
            for k in range(most, -1, -1):
                if reach[at] >> (target - k * n) & 1:
                    break
            if k:
                used[n] = used.get(n, 0) + k
                target -= k * n
            if not target:
                break
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        valid = len(lengths)
        for n, k in used.items():
            before = min(left[n], capacity // n)
            left[n] -= times * k
            if min(left[n], capacity // n) != before:
                valid = min(valid, lengths.index(n))
        del reach[valid + 1 :]
        lengths = lengths[:valid] + [n for n in lengths[valid:] if left[n]]
    return bins


def _gap(sums: int, room: int) -> int:
    """Slack of the fullest sum that fits into `room`."""
    return room - ((sums & ((1 << (room + 1)) - 1)).bit_length() - 1)


def _reach_without_one(reach: list[int], lengths: list[int], left: dict[int, int], everything: int) -> int:
    """Sums reachable when one of the longest pieces is set aside."""
    n = lengths[-1]
    sums = reach[-2]
    for _ in range(min(left[n] - 1, (everything.bit_length() - 1) // n)):
        sums |= (sums << n) & everything
    return sums


def best_bins(counts: dict[int, int], capacity: int) -> list[Bin]:
    """The better of both ways to fill bins; both read only one count per length."""
    return min((fill_bins(counts, capacity, way) for way in (False, True)), key=lambda bins: sum(t for t, _ in bins))


def places(bins: list[Bin]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, copies in a bin, first bin, offset), ascending by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for times, used in bins:
        offset = 0
        for n, k in used:
            found.setdefault(n, []).append((seen.get(n, 0), k, first, offset))
            seen[n] = seen.get(n, 0) + times * k
            offset += n * k
        first += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def pieces(docs: DataFrame, vocabulary: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole texts: id, piece, start, length, ids_crc32, and `part`, `nth` (the
    piece's number among those of its length in its task).

    A document is its ids and the end id; only one longer than the capacity is cut, and then its
    first piece is the shorter one. A null or empty text is one piece with the end id alone.
    """
    longs = ("start", "length", "ids_crc32")
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 1):
                ids, begins = encoder(vocabulary).encode(some.column(1), end)
                sizes = np.diff(begins)
                parts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                short = sizes - (parts - 1) * capacity
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                order = np.argsort(length, kind="stable")
                groups, firsts, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(firsts, counts) + np.repeat(seen[groups], counts)
                seen[groups] += counts
                begin = begins[:-1][row] + start
                crcs = np.fromiter((crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), length.tolist())), np.int64, len(row))
                arrays = [some.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crcs)), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        encoder(vocabulary).reset()  # a worker that is used again starts small
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with `sequence_id` and `offset`; sequences are gapless from offset 0.

    Repeated rows are packed each on its own; an empty table gives no rows; null ids are carried
    along. The driver sees one count per length (at most `capacity` numbers) and holds the
    combinations, whose number is bounded by the capacity, not by the rows.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary, end, capacity, id_col, text_col), "pieces")
    by_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("length").orderBy("part")
    before = staged(by_task.withColumn("_before", F.sum("_n").over(order) - F.col("_n")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    known = spark.sparkContext.broadcast(places(best_bins(counts, capacity)))
    ranked = cut.join(before.drop("_n"), ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*(cut.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                rows = known.value[n]
                first, copies, bin_, at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1].T
                sequence[mine] = bin_ + (rank[mine] - first) // copies
                offset[mine] = at + (rank[mine] - first) % copies * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*columns, "_rank").mapInArrow(place, schema)
