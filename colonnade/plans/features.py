"""The feature plan: fit encoders and scalers on the training fold, replay anywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from colonnade.columns import categorical_columns, datetime_columns, literal_rows, numeric_columns
from colonnade.operators import dictionaries as D, features as X
from colonnade.session import scratch_path


@dataclass
class FeatureOptions:
    id_col: str | None = None
    target: str | None = None
    math: bool = False
    category_pairs: bool = False
    datetime: bool = True
    max_cat_unique: int | None = None
    encoding: str | None = "one_hot"  # one_hot | ordinal | nominal | None
    fill_missing: bool = False  # missing numbers: the training median and a flag
    missing_category: bool = False
    scale: bool = False

    def kept(self) -> list[str]:
        return [c for c in (self.id_col, self.target, "fold") if c]


@dataclass
class FeaturePlan:
    options: FeatureOptions
    dates: list[str] = field(default_factory=list)
    timed: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    categories: dict[str, list] = field(default_factory=dict)
    long: dict[str, int] = field(default_factory=dict)  # columns whose categories are a table, and how many there are
    dictionary: str | None = None  # where that table is
    fills: dict[str, float] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)
    nominal: dict[str, int] = field(default_factory=dict)  # columns of category numbers, and how many there are
    scaler: dict[str, list] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)

    def _expand(self, df: DataFrame) -> DataFrame:
        o = self.options
        side = [c for c in o.kept() if c in df.columns]
        if o.math:
            df = X.math_features(df, [c for c in numeric_columns(df) if c not in side])
        if o.category_pairs:
            df = X.category_pairs(df, [f for f in categorical_columns(df) if f not in side and dict(df.dtypes)[f] == "string"])
        if self.dates:
            df = X.datetime_parts(df, self.dates, self.timed).drop(*self.dates)
        return df

    def _encode(self, df: DataFrame) -> DataFrame:
        df = df.drop(*self.dropped)
        if self.options.missing_category:
            df = X.missing_category(df, [*self.categories, *self.long])
        table = df.sparkSession.read.parquet(self.dictionary) if self.long else None
        if self.options.encoding == "one_hot":
            df = X.one_hot(df, self.categories)
            df = D.one_hot_vectors(df, table, list(self.long)) if self.long else df
        elif self.options.encoding in ("ordinal", "nominal"):
            unordered = {c: v for c, v in self.categories.items() if self.options.encoding == "nominal" and len(v) <= X.NOMINAL_LIMIT}
            df = X.nominal(X.ordinal(df, {c: v for c, v in self.categories.items() if c not in unordered}), unordered)
            df = D.ordinal_codes(df, table, list(self.long)) if self.long else df
        return X.fill_numbers(X.rename_safe(df), self.fills, self.flagged)

    @classmethod
    def fit(cls, df: DataFrame, options: FeatureOptions) -> FeaturePlan:
        plan = cls(options)
        side = options.kept()
        if options.datetime:
            plan.dates = [c for c in datetime_columns(df) if c not in side]
            plan.timed = X.fit_time_columns(df, plan.dates)
        wide = plan._expand(df)
        categorical = [c for c in categorical_columns(wide) if c not in side]
        if options.max_cat_unique is not None:
            plan.dropped = X.fit_high_cardinality(wide, options.max_cat_unique, categorical)
        categorical = [c for c in categorical if c not in plan.dropped]
        if options.encoding:
            filled = X.missing_category(wide, categorical) if options.missing_category else wide
            sizes = X.category_sizes(filled, categorical)
            long = [c for c in categorical if sizes[c] > X.MAX_CATEGORIES]
            if long:
                plan.dictionary = scratch_path(df.sparkSession, "dictionary")
                plan.long = D.dictionary_sizes(D.fit_dictionary(filled, long, path=plan.dictionary))
            plan.categories = X.fit_categories(filled, [c for c in categorical if c not in long], sizes=sizes)
            if options.missing_category:
                for values in plan.categories.values():
                    if "Missing" not in values:
                        values.append("Missing")
                        values.sort()
        if options.encoding == "nominal":
            plan.nominal = {X.safe_name(c): sum(v is not None for v in values) + 1 for c, values in plan.categories.items() if len(values) <= X.NOMINAL_LIMIT}
        encoded = plan._encode(wide)
        safe_side = [*(X.safe_name(c) for c in side), *plan.nominal]
        if options.fill_missing:
            plan.fills, plan.flagged = X.fit_fills(encoded, [c for c in numeric_columns(encoded) if c not in safe_side])
            encoded = X.fill_numbers(encoded, plan.fills, plan.flagged)
        if options.scale:
            numbers = [c for c in numeric_columns(encoded) if c not in safe_side and c not in [f"{f}_missing" for f in plan.flagged]]
            plan.scaler = {c: list(v) for c, v in X.fit_scaler(encoded, numbers).items()}
        plan.features = [c for c in encoded.columns if c not in safe_side or c in plan.nominal]
        return plan

    def transform(self, df: DataFrame) -> DataFrame:
        """id / target / fold as found in `df`, then the fitted feature columns."""
        done = X.standard_scale(self._encode(self._expand(df)), {c: tuple(v) for c, v in self.scaler.items()})
        side = [X.safe_name(c) for c in self.options.kept() if X.safe_name(c) in done.columns]
        return X.as_nominal(done.select(*side, *self.features), self.nominal)

    def assembled(self, df: DataFrame) -> DataFrame:
        done = self.transform(df)
        return X.assemble(done, [c for c in done.columns if c not in self.features])

    @property
    def width(self) -> int:
        """Numbers in an assembled vector: a one-hot vector counts as its entries."""
        return len(self.features) + (sum(n - 2 for n in self.long.values()) if self.options.encoding == "one_hot" else 0)

    def save(self, spark: SparkSession, path: str) -> None:
        """The plan as one JSON row; the table of long category lists beside it."""
        if self.dictionary:
            beside = f"{path.rstrip('/')}_dictionary"
            if self.dictionary != beside:
                spark.read.parquet(self.dictionary).write.mode("overwrite").parquet(beside)
                self.dictionary = beside
        literal_rows(spark, [(json.dumps(asdict(self)),)], "plan string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePlan:
        state = json.loads(spark.read.schema("plan string").json(path).first()["plan"])
        return cls(FeatureOptions(**state.pop("options")), **state)
