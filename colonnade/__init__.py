"""Tabular analytics jobs over Spark DataFrames: profiling, cleaning, statistics,
feature engineering, cross-validated training, evaluation, scoring and explanation."""

__version__ = "0.1.0"
