"""Profiling and cleaning on hand-made frames."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators import cleaning as C, features as X, quality as Q, univariate as U
from colonnade.plans.cleaning import CleaningOptions, CleaningPlan
from colonnade.plans.features import FeatureOptions, FeaturePlan
from colonnade.session import scratch_path


@pytest.fixture(scope="module")
def nulls(spark):
    inf = float("inf")
    return spark.createDataFrame([(v,) for v in (None, float("nan"), inf, -inf, 0.0, -0.0, -2.0, 5.0)], "v double")


def test_special_values(nulls):
    row = Q.quality_counts(nulls).first()
    assert (row["missing"], row["infinite"], row["zero"], row["negative"]) == (2, 2, 2, 2)


def test_nan_is_not_a_value(nulls):
    assert Q.unique_counts(nulls).first()["n_unique"] == 5


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string, c boolean")
    assert {r["column"]: r["n_unique"] for r in Q.unique_counts(df).collect()} == {"a": 0, "b": 0, "c": 0}
    assert Q.special_values(df, "missing").count() == 0
    assert C.fit_imputation(df) == {} and C.fit_date_strings(df) == []
    assert U.descriptive_statistics(df, ["a"]).first()["n"] == 0
    assert C.random_sample(df.withColumn("id", F.lit(1)), "id", 5).count() == 0


def test_one_row(spark):
    row = U.descriptive_statistics(spark.createDataFrame([(3.0,)], "v double")).first()
    assert row["mean"] == 3.0 and row["var"] is None and row["skew"] is None and row["kurt"] is None


def test_cardinality_sketch_never_drops_a_short_column(spark):
    df = spark.range(5_000).select(*[(F.col("id") % k).alias(f"k{k}") for k in (1, 2, 19, 20, 21, 4000)])
    assert {r["column"]: r["n_unique"] for r in Q.unique_counts(df, 20).collect()} == {"k1": 1, "k2": 2, "k19": 19, "k20": 20}


def test_duplicates_match_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1.0, "a"), (4, 1.0, "b")], "id int, x double, y string")
    assert sorted(r["id"] for r in Q.duplicate_rows(df, ["id"]).collect()) == [1, 2]


def test_merge_duplicates_mean_and_mode(spark):
    df = spark.createDataFrame([(1, "p", 2.0), (2, "p", 4.0), (3, "q", 9.0)], "id int, f string, t double")
    assert {tuple(r) for r in C.merge_duplicates(df, "id", "t").collect()} == {(2, "p", 3.0), (3, "q", 9.0)}
    text = spark.createDataFrame([(1, "p", "y"), (2, "p", "x"), (5, None, "z")], "id int, f string, t string")
    assert {tuple(r) for r in C.merge_duplicates(text, "id", "t").collect()} == {(2, "p", "x"), (5, None, "z")}


def test_binary_numbers(spark):
    df = spark.createDataFrame([(3, 0), (7, 1), (None, 1)], "a int, b int")
    pairs = C.fit_binary_numbers(df)
    out = C.numbers_to_binary(df, pairs)
    assert out.columns == ["a_7", "b"]
    assert [tuple(r) for r in out.collect()] == [(False, False), (True, True), (None, True)]


def test_mode_tie_takes_the_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert C.fit_imputation(df) == {"c": "a"}


def test_dates_are_all_or_nothing(spark):
    df = spark.createDataFrame([("2024-01-31", "24/01/31", "2024-01-31"), ("31/12/2023", None, "soon")], "a string, b string, c string")
    assert C.fit_date_strings(df) == ["a", "b"]
    out = C.strings_to_datetime(df, ["a", "b"]).collect()
    assert [r["a"].date() for r in out] == [datetime.date(2024, 1, 31), datetime.date(2023, 12, 31)]
    assert out[0]["b"].date() == datetime.date(2024, 1, 31) and out[1]["b"] is None


def test_column_names_with_spaces_and_dots(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], ["id", "Curricular units 1st sem (grade)", "Mother's job / a.b"])
    assert {r["column"] for r in Q.special_values(df, "missing").collect()} == {"Curricular units 1st sem (grade)"}
    plan = FeaturePlan.fit(df, FeatureOptions("id", scale=True))
    assert plan.transform(df).columns == ["id", "Curricular_units_1st_sem_grade_", "Mother_s_job_a_b_y"]


def test_plan_replay_is_the_fit_on_the_same_rows(spark):
    df = spark.createDataFrame(
        [(i, 3 if i % 2 else 7, "x", f"2024-01-{1 + i % 28:02d}", None if i % 5 == 0 else float(i), i % 3) for i in range(50)],
        "id int, b int, flat string, day string, v double, k int")
    options = CleaningOptions(id_col="id", missing="median", number_to_category=["k"], drop_duplicates=False)
    plan = CleaningPlan.fit(df, options)
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    loaded = CleaningPlan.load(spark, path)
    assert loaded == plan and plan.dropped == ["flat"]
    first, again = plan.transform_train(df), loaded.transform(df)
    assert first.schema == again.schema and first.exceptAll(again).count() == 0
    assert dict(again.dtypes) == {"id": "int", "b_7": "boolean", "day": "timestamp_ntz", "v": "double", "k": "string"}


def test_unseen_category(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    new = spark.createDataFrame([("z",), (None,), ("b",)], "c string")
    fitted = X.fit_categories(train, ["c"])
    assert [tuple(r) for r in X.one_hot(new, fitted).collect()] == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    assert [r["c"] for r in X.ordinal(new, fitted).collect()] == [-1.0, -1.0, 1.0]


def test_feature_plan_saves_and_loads(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "id int, c string, v double")
    plan = FeaturePlan.fit(df, FeatureOptions("id", encoding="ordinal", scale=True, missing_category=True))
    path = scratch_path(spark, "features")
    plan.save(spark, path)
    loaded = FeaturePlan.load(spark, path)
    assert loaded.transform(df).exceptAll(plan.transform(df)).count() == 0


def test_renaming_collision_is_an_error(spark):
    with pytest.raises(ValueError, match="collide"):
        X.rename_safe(spark.createDataFrame([(1, 2)], ["a b", "a-b"]))


def test_box_whiskers_and_fliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    row = U.box_statistics({"all": df}).first()
    assert (row["whisker_low"], row["whisker_high"], row["n_fliers"]) == (1.0, 5.0, 1)
    assert [r["value"] for r in U.box_fliers({"all": df}).collect()] == [100.0]


def test_binned_density_is_close(spark):
    df = spark.range(4_000).select((F.sin("id") * 10).alias("v"))
    exact = {r["i"]: r["density"] for r in U.kde_curves({"a": df}).collect()}
    binned = {r["i"]: r["density"] for r in U.kde_curves({"a": df}, bins=2000).collect()}
    assert max(abs(exact[i] - binned[i]) for i in exact) < 1e-4


def test_densities_are_those_of_the_definition(spark, monkeypatch):
    """By vectors per task and by join alike, with nulls, hot values and a curve without spread."""
    draw = np.random.RandomState(2)
    v = np.round(draw.normal(size=500), 2)
    v[:150] = 0.25
    df = spark.createDataFrame([(float(x), 1.0, None if i % 9 == 0 else float(x) * 3) for i, x in enumerate(v)], "a double, flat double, b double").repartition(5)
    want = {}
    for name, values in (("a", v), ("b", np.array([x * 3 for i, x in enumerate(v) if i % 9]))):
        h = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 200)
        want[name] = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(1) / (np.sqrt(2 * np.pi) * h * len(values))
    for most in (10_000, 0):
        monkeypatch.setattr(U, "MAX_CURVES", most)
        rows = U.kde_curves({"all": df}).orderBy("column", "i").collect()
        assert {r["column"] for r in rows} == {"a", "b"}
        for name in want:
            assert np.allclose([r["density"] for r in rows if r["column"] == name], want[name], rtol=1e-9, atol=1e-12)
