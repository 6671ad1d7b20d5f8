"""Saving and loading fitted models: MLlib's own format, one JSON row of numbers, and tables."""

from __future__ import annotations

import importlib
import json

import numpy as np
from pyspark.sql import SparkSession

from colonnade.columns import literal_rows
from colonnade.operators.models import bayes, linear, neighbours_model, trees  # noqa: F401  (registers the scorers)
from colonnade.operators.models.common import Scored, Table


def is_mllib(v) -> bool:
    return hasattr(v, "write") and hasattr(v, "transform")


def save_model(spark: SparkSession, model: Scored, path: str) -> None:
    meta: dict = {"kind": model.kind, "plain": {}, "arrays": {}, "mllib": {}, "nested": [], "tables": []}
    for name, v in model.state.items():
        if isinstance(v, Scored):
            save_model(spark, v, f"{path}/{name}")
            meta["nested"].append(name)
        elif isinstance(v, Table):
            spark.read.parquet(v.path).write.mode("overwrite").parquet(f"{path}/{name}")
            meta["tables"].append(name)
        elif is_mllib(v) or (isinstance(v, list) and v and is_mllib(v[0])):
            many = v if isinstance(v, list) else [v]
            for i, m in enumerate(many):
                m.write().overwrite().save(f"{path}/{name}/{i}")
            meta["mllib"][name] = [isinstance(v, list), [f"{type(m).__module__}.{type(m).__name__}" for m in many]]
        elif isinstance(v, np.ndarray):
            meta["arrays"][name] = v.tolist()
        else:
            meta["plain"][name] = v
    literal_rows(spark, [(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Scored:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    state = {**meta["plain"], **{k: np.array(v) for k, v in meta["arrays"].items()}}
    for name, (many, classes) in meta["mllib"].items():
        loaded = []
        for i, full in enumerate(classes):
            module, cls = full.rsplit(".", 1)
            if not module.startswith("pyspark.ml."):
                raise ValueError(f"not an MLlib model: {full}")
            loaded.append(getattr(importlib.import_module(module), cls).load(f"{path}/{name}/{i}"))
        state[name] = loaded if many else loaded[0]
    for name in meta["tables"]:
        state[name] = Table(f"{path}/{name}")
    for name in meta["nested"]:
        state[name] = load_model(spark, f"{path}/{name}")
    return Scored(meta["kind"], **state)
