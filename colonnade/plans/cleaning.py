"""The cleaning plan: fit all decisions on training data, replay them on any frame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from colonnade.columns import literal_rows
from colonnade.operators import cleaning as C


@dataclass
class CleaningOptions:
    id_col: str | None = None
    target: str | None = None
    drop_unique: bool = True
    drop_constant: bool = True
    drop_duplicates: bool = True
    merge_duplicates: bool = False
    binary_numbers: bool = True
    number_to_category: list[str] = field(default_factory=list)
    date_strings: bool = True
    missing: str = "ignore"  # ignore | drop_columns | drop_rows | mean | median
    sample_size: int | None = None
    stratify: bool = False

    def roles(self) -> list[str]:
        return [c for c in (self.id_col, self.target) if c]


@dataclass
class CleaningPlan:
    """Ordered decisions: (step, column, action, value). Row-dropping steps (duplicates,
    null rows, sampling) shape the training data only and are not replayed."""

    options: CleaningOptions
    dropped: list[str] = field(default_factory=list)
    binary: dict[str, list] = field(default_factory=dict)
    to_category: list[str] = field(default_factory=list)
    to_datetime: list[str] = field(default_factory=list)
    null_columns: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)

    def _retype(self, df: DataFrame) -> DataFrame:
        df = df.drop(*self.dropped)
        df = C.numbers_to_binary(df, {c: p for c, p in self.binary.items() if c in df.columns})
        df = C.numbers_to_category(df, self.to_category)
        return C.strings_to_datetime(df, self.to_datetime)

    def _rows(self, df: DataFrame) -> DataFrame:
        o = self.options
        if o.merge_duplicates and o.target:
            return C.merge_duplicates(df, o.id_col, o.target)
        return C.drop_duplicate_rows(df) if o.drop_duplicates else df

    @classmethod
    def fit(cls, df: DataFrame, options: CleaningOptions) -> CleaningPlan:
        plan = cls(options)
        keep = options.roles()
        if options.drop_unique:
            plan.dropped += C.fit_unique_columns(df, keep)
        if options.drop_constant:
            plan.dropped += C.fit_constant_columns(df.drop(*plan.dropped), keep)
        left = plan._rows(df.drop(*plan.dropped)).persist()  # read by every later decision
        try:
            return plan._fit_types(left)
        finally:
            left.unpersist()

    def _fit_types(self, left: DataFrame) -> CleaningPlan:
        plan, options, keep = self, self.options, self.options.roles()
        if options.binary_numbers:
            plan.binary = C.fit_binary_numbers(left, keep)  # the target keeps its name and values
        plan.to_category = [c for c in options.number_to_category if c in left.columns and c not in plan.binary]
        if options.date_strings:
            plan.to_datetime = C.fit_date_strings(left)
        typed = plan._retype(left)
        if options.missing == "drop_columns":
            plan.null_columns = [c for c in C.fit_null_columns(typed) if c not in keep]
        elif options.missing in ("mean", "median"):
            plan.fills = C.fit_imputation(typed, options.missing, [c for c in typed.columns if c not in keep])
        plan.columns = [c for c in typed.columns if c not in plan.null_columns]
        return plan

    def transform_train(self, df: DataFrame) -> DataFrame:
        """The cleaned training frame, row-level steps included."""
        o = self.options
        out = C.impute(self._retype(self._rows(df.drop(*self.dropped))).drop(*self.null_columns), self.fills)
        if o.missing == "drop_rows":
            out = C.drop_null_rows(out)
        if o.sample_size and o.id_col:
            if o.stratify and o.target:
                if o.target not in out.columns:
                    raise ValueError(f"no column {o.target!r} to stratify by")
                return C.stratified_sample(out, o.id_col, o.sample_size, o.target)
            return C.random_sample(out, o.id_col, o.sample_size)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay on new data: same columns and types, saved fill values, every row kept."""
        typed = self._retype(df).drop(*self.null_columns)
        return C.align_columns(C.impute(typed, self.fills), self.columns, self.options.roles())

    def decisions(self, spark: SparkSession) -> DataFrame:
        """The plan as a table (step, column, action, value), values JSON-encoded."""
        rows = [("drop", c, "drop", None) for c in self.dropped]
        rows += [("binary", c, "equals_high", json.dumps(p)) for c, p in self.binary.items()]
        rows += [("category", c, "cast_string", None) for c in self.to_category]
        rows += [("datetime", c, "parse", None) for c in self.to_datetime]
        rows += [("null_columns", c, "drop", None) for c in self.null_columns]
        rows += [("impute", c, "fill", json.dumps(v)) for c, v in self.fills.items()]
        rows += [("columns", c, "keep", str(i)) for i, c in enumerate(self.columns)]
        rows.append(("options", "", "options", json.dumps(self.options.__dict__)))
        return literal_rows(spark, rows, "step string, column string, action string, value string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.decisions(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CleaningPlan:
        by_step: dict[str, list] = {}
        for r in spark.read.parquet(path).collect():  # a handful of rows per column
            by_step.setdefault(r["step"], []).append(r)
        names = lambda step: [r["column"] for r in by_step.get(step, [])]
        plan = cls(CleaningOptions(**json.loads(by_step["options"][0]["value"])))
        plan.dropped = names("drop")
        plan.binary = {r["column"]: json.loads(r["value"]) for r in by_step.get("binary", [])}
        plan.to_category, plan.to_datetime, plan.null_columns = names("category"), names("datetime"), names("null_columns")
        plan.fills = {r["column"]: json.loads(r["value"]) for r in by_step.get("impute", [])}
        plan.columns = [r["column"] for r in sorted(by_step.get("columns", []), key=lambda r: int(r["value"]))]
        return plan
