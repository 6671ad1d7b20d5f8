"""Column-name quoting and dtype classes shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def col(name: str) -> Column:
    """Reference a column whose name may hold spaces, dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into null, so that `missing` means one thing."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(df.schema[name].dataType) else c


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def long_values(df: DataFrame, columns: list[str], keep: list[str] = (), dtype: str = "string") -> DataFrame:
    """Unpivot `columns` into (keep..., column, value): one scan, one row per cell.

    Spark's `unpivot` is a narrow Expand, so nothing is shuffled here.
    """
    def cell(c: str) -> Column:
        value = present(df, c)
        if dtype == "string" and is_float(df.schema[c].dataType):
            value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
        return value.cast(dtype).alias(c)

    plain = df.select(*[col(k) for k in keep], *[cell(c) for c in columns])
    return plain.unpivot(
        [col(k) for k in keep], [col(c) for c in columns], "column", "value"
    )


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table (fit decisions, column lists) as literals, planned in the JVM."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
    fields = T.StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
