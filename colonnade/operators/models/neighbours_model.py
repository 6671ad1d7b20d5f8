"""k nearest neighbours as a fitted model: the training rows are its state, kept as a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colonnade.columns import col
from colonnade.operators.models.common import LABEL, Scored, Table, argmax, class_count, scorer, with_array
from colonnade.operators.models.neighbours import QUERY_ROWS, SMALL_CELLS, best_k, nearest_neighbours
from colonnade.session import scratch_path


def knn(df: DataFrame, id_col: str, k: int = 5, task: str = "classification", path: str | None = None) -> Scored:
    """The rows go to `path` (or the scratch folder); saving the model copies them beside it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "neighbours")
    with_array(df).select(col(id_col).alias("id"), "_x", LABEL).write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path)
    classes = class_count(df) if task == "classification" else 0
    first = kept.first()
    return Scored("neighbours", table=Table(path), k=k, task=task, classes=classes, id_col=id_col, cells=kept.count() * len(first["_x"]) if first else 0)


def by_lookup(state: dict, rows: DataFrame) -> DataFrame:
    """Small training sets: a projection, so that rows keep their places and streams can be scored."""
    held = rows.sparkSession.read.parquet(state["table"].path).toPandas()
    held = held.sort_values("id", kind="stable")
    points, labels, k = np.stack(held["_x"].to_numpy()), held[LABEL].to_numpy(float), state["k"]
    classes = state["classes"] if state["task"] == "classification" else 0

    @F.pandas_udf("array<double>")
    def near_labels(x: pd.Series) -> pd.Series:
        """Class shares, or the mean alone, of the k nearest rows."""
        out = []
        for start in range(0, len(x), QUERY_ROWS):
            part = np.stack(x.iloc[start:start + QUERY_ROWS].to_numpy())
            # ties go to the smaller id, so rows are numbered in the order of their ids
            near = best_k(np.arange(len(part)), part, np.arange(len(points)), points, k)
            found, of = labels[near["neighbour_id"].to_numpy()], near["query_id"].to_numpy()
            n = np.bincount(of, minlength=len(part))
            if classes:
                shares = np.bincount(of * classes + found.astype(int), minlength=len(part) * classes).reshape(len(part), classes)
            else:
                shares = np.bincount(of, found, len(part))[:, None]
            out += list(shares / n[:, None])
        return pd.Series(out)

    made = with_array(rows).withColumn("_near", near_labels(F.col("_x"))).drop("_x")
    if classes:
        return made.withColumnRenamed("_near", "probability").withColumn("prediction", argmax(F.col("probability")))
    return made.withColumn("prediction", F.col("_near")[0]).drop("_near")


@scorer("neighbours")
def score_neighbours(state: dict, rows: DataFrame) -> DataFrame:
    """A lookup where the rows are while the training set is small, else a join (not for streams)."""
    if 0 < state["cells"] <= SMALL_CELLS:
        return by_lookup(state, rows)
    if rows.isStreaming:
        raise ValueError(f"a stream can be scored by nearest neighbours only with at most {SMALL_CELLS} numbers to compare with, not {state['cells']}")
    spark, id_col = rows.sparkSession, state["id_col"]
    train = spark.read.parquet(state["table"].path)
    asked = with_array(rows).select(col(id_col).alias("id"), "_x")
    found = nearest_neighbours(train, asked, "id", "_x", state["k"], small_cells=0)
    labelled = found.join(train.select(F.col("id").alias("neighbour_id"), LABEL), "neighbour_id")
    if state["task"] == "regression":
        made = labelled.groupBy("query_id").agg(F.avg(LABEL).alias("prediction"))
    else:
        n = F.count(F.lit(1))
        shares = [F.count_if(F.col(LABEL) == c) / n for c in range(state["classes"])]
        made = labelled.groupBy("query_id").agg(F.array(*shares).alias("probability")).withColumn("prediction", argmax(F.col("probability")))
    return rows.join(made, col(id_col) == F.col("query_id")).drop("query_id")
