"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from colonnade.columns import col


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema where there is one: inference reads the data twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Arrow IPC files, their record batches dealt over all tasks.

    Spark lists the files; a first pass opens only their footers and numbers the batches, then
    each task fetches the batches dealt to it, so no file is ever one value in memory. Without
    a schema, that of the first file's footer is taken.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path")
    if schema is None:
        first = files.orderBy("path").first()
        if first is None:
            raise ValueError(f"no feather file in {path}; give a schema to read an empty folder")
        with open_ipc(first["path"]) as file:
            schema = from_arrow_schema(file.schema)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in wanted.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_ipc(name) as file:
                    n = file.num_record_batches
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "number"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number in zip(*(c.to_pylist() for c in batch.columns)):
                with open_ipc(name) as file:
                    part = file.get_batch(number)
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names], names=names)

    return files.mapInArrow(count, "path string, number int").repartition("path", "number").mapInArrow(fetch, wanted)


@contextmanager
def open_ipc(uri: str) -> Iterator[pa.ipc.RecordBatchFileReader]:
    system, base = pa.fs.FileSystem.from_uri(uri)
    with system.open_input_file(base) as source, pa.ipc.open_file(source) as file:
        yield file


def write_feather(df: DataFrame, path: str) -> None:
    """One Arrow IPC file per partition, named by partition so that a retried task
    overwrites its own file."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, stream, rows = TaskContext.get().partitionId(), None, None, 0
        system, base = pa.fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        for batch in batches:
            if writer is None:
                stream = system.open_output_stream(f"{base}/part-{part:05d}.feather")
                writer = pa.ipc.new_file(stream, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(store, "rows bigint").agg(F.sum("rows")).collect()


READERS = {"csv": read_csv, "parquet": read_parquet, "feather": read_feather}


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension: csv, parquet, otherwise feather."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return READERS.get(kind, read_feather)(spark, path, **options)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a parquet table and read it back: the cleaned train / test sink, and a
    reliable cut in the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Long prediction / metric tables by (model, fold): readers prune whole folders. Rows are
    not moved first, so one large model is still written by many tasks."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, **values) -> DataFrame:
    rows = spark.read.parquet(path)
    for name, value in values.items():
        rows = rows.where(col(name) == value)
    return rows
