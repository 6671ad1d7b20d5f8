"""Token-id files: sorted Parquet list columns with chosen encodings, row groups and page indexes.

Documents are dealt to files by ranges of their id and sorted, so files, row groups and pages carry
narrow id bounds and a reader that asks for some ids skips the rest; token counts and starts are
columns of their own, read without touching any token. Token ids are dictionary-encoded (a
vocabulary's ids fit a dictionary page), the sorted numbers delta-encoded (writer version 2).
Spark's own writer makes the files, so a retried or speculative task leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.llm.common import joined_small, staged
from colonnade.llm.tokens import crc32, encoder, slices


def encoded(docs: DataFrame, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs` with its token ids, in file order.

    Columns: the id, `tokens`, `n_tokens`, `part` (the file's number in id order), `part_start`
    (ids of all earlier documents of the file). A null text counts as empty and holds the end id
    alone; null ids come first; rows of one id are ordered by text, so repeated rows are all
    kept. Other columns of `docs` are not read.
    """
    key = docs.schema[id_col]
    schema = T.StructType([key, T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1):
                ids, begins = encoder(vocabulary).encode(some.column(1), end)
                sizes = np.diff(begins)
                starts = before + begins[:-1]
                before += int(begins[-1])
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column(0), lists, pa.array(sizes, pa.int64()), pa.array(np.full(some.num_rows, part, np.int32)), pa.array(starts, pa.int64())], names=schema.names)
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(F.col(id_col).asc_nulls_first())
    return rows.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col)).mapInArrow(encode, schema)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, token_encoding: str = "dictionary") -> None:
    """Encode all texts and write them below `path`, ascending by id over the files.

    `token_encoding` is "dictionary" or "delta"; `row_group_bytes` and `page_bytes` bound what a
    selective read fetches at least. Column and offset indexes are written for every page.
    """
    if token_encoding not in ("dictionary", "delta"):
        raise ValueError(f"no token encoding {token_encoding!r}")
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.write-checksum.enabled": "true",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": str(token_encoding == "dictionary").lower(), "compression": "zstd",
    }
    encoded(docs, vocabulary, end, id_col, text_col).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The files' rows; `where` on the id reaches the row-group and page bounds, `columns` prunes the scan."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before a row, from the metadata columns of all `files`.

    One row per file is summed in order; that short table is broadcast once it is counted.
    """
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_ids"))
    before = totals.select("part", (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before"))
    return joined_small(rows, staged(before, "before"), ["part"], "inner").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before", "part_start")


def token_digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of token files: id, part, part_start, `n_tokens` counted from the list, and the ids' CRC."""
    schema = T.StructType([rows.schema[id_col], T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crcs = np.fromiter((crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crcs)], names=schema.names)

    return rows.select(id_col, "part", "part_start", "tokens").mapInArrow(digest, schema)
