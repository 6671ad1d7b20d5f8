"""Beyond former limits: many values, many groups, renamed columns, two-valued targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators import association as A
from colonnade.operators.models.linear import ridge
from colonnade.plans.cleaning import CleaningOptions, CleaningPlan
from colonnade.plans.training import TrainingConfig, define_models, train
from colonnade.sources.tables import read_table, write_feather


def chi_square_of(pairs):
    rows, cols = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    n = np.zeros((len(rows), len(cols)))
    for a, b in pairs:
        n[rows.index(a), cols.index(b)] += 1
    e = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
    return ((n - e) ** 2 / e).sum(), (e >= 5).mean() * 100, int((e < 1).sum())


def test_chi_square_with_many_values(spark):
    pairs = [(f"a{i * i % 307}", f"b{i % 11}") for i in range(4_000)]
    got = A.chi_square(spark.createDataFrame(pairs, "x string, y string"), [("x", "y")]).first()
    chi2, share, below = chi_square_of(pairs)
    assert got["chi2"] == pytest.approx(chi2) and got["expected_pct"] == pytest.approx(share) and got["below_one"] == below
    many = spark.range(40_000).select((F.col("id") % 20_000).cast("string").alias("x"), (F.col("id") % 7).cast("string").alias("y"))
    wide = A.chi_square(many, [("x", "y")]).first()
    assert (wide["rows"], wide["cols"]) == (20_000, 7) and np.isfinite(wide["chi2"])


@pytest.mark.parametrize("in_one_task", [True, False])
def test_expected_cells_of_long_lists(spark, monkeypatch, in_one_task):
    """10^5 distinct totals on both sides: 10^10 cells, none of which is built."""
    monkeypatch.setattr(A, "EVENT_ROWS", 10**9 if in_one_task else 1_000)
    size, total = 100_000, 3_000_000_000
    cells = spark.range(1, size + 1).select(
        F.lit("x").alias("column_1"), F.lit("y").alias("column_2"), F.col("id").cast("string").alias("a"), F.col("id").cast("string").alias("b"),
        F.col("id").alias("na"), (2 * F.col("id") + 3).alias("nb"), F.lit(total).cast("long").alias("total"))
    got = A.expected_shares(cells).first()
    na = np.arange(1, size + 1, dtype=np.int64)
    nb = 2 * na + 3
    enough = (size - np.searchsorted(nb, -(-5 * total // na), "left")).sum()
    assert got["expected_pct"] == pytest.approx(enough / size**2 * 100)
    assert got["below_one"] == np.searchsorted(nb, -(-total // na), "left").sum()


@pytest.mark.parametrize("short", [0, 3])
def test_coverage_counts_all_groups(spark, short):
    """250 groups of 600 rows, of which some may have too few rows for their 20 means of 30."""
    rows = spark.range(150_000).select("id", (F.col("id") % 250).alias("g"), ((F.col("id") * 7919 + F.floor(F.col("id") / 250) * 31) % 101).cast("double").alias("v"))
    df = rows.where(f"g >= {short} or id < 75000").select("id", F.concat(F.lit("g"), F.col("g").cast("string")).alias("category"), "v")
    got = A.numeric_by_category(df, "id", ["category"], ["v"], max_unique=250).collect()
    assert len(got) == 1 and got[0]["num_groups"] == 250 - short
    assert (got[0]["full_groups"] == "Full") == (short == 0)


def test_ridge_beyond_the_normal_equations(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from colonnade.operators.models import linear
    from colonnade.operators.models.common import FEATURES, LABEL

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = x @ [1.0, 2.0, 0.0, -1.0, 0.5] + rng.normal(size=80)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], [FEATURES, LABEL]).persist()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    for width in (4096, 4):
        monkeypatch.setattr(linear, "NORMAL_WIDTH", width)
        scored = [r["prediction"] for r in ridge(df).score(df).collect()]
        assert np.allclose(scored, xc @ want + y.mean(), atol=1e-4)


def test_two_valued_target_keeps_its_name(spark):
    df = spark.createDataFrame([(i, 1 + i % 2, float(i), i % 2) for i in range(200)], "id long, y int, v double, flag int")
    plan = CleaningPlan.fit(df, CleaningOptions(id_col="id", target="y", binary_numbers=True, sample_size=40, stratify=True))
    out = plan.transform_train(df)
    assert "y" in out.columns and {r["y"] for r in out.collect()} == {1, 2} and out.groupBy("y").count().where("count = 20").count() == 2


def test_training_with_names_to_be_renamed(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 13), "yes" if i % 13 > 6 else "no") for i in range(120)], "`row id` long, v double, `the target` string")
    config = TrainingConfig("row id", "the target", "classification", define_models(["Decision Tree"]), best_metric="Accuracy", folds=2)
    run = train(df, config, str(tmp_path / "run"))
    assert "row id" in run.oof().columns and run.best().count() == 2
    assert run.score(df).select("row id").distinct().count() == 120
    with pytest.raises(ValueError):
        train(df, TrainingConfig("row id", "the target", "classification", define_models(["Decision Tree", "Decision Tree"]), best_metric="Accuracy"), str(tmp_path / "twice"))


def test_feather_by_extension(spark, tmp_path):
    path = str(tmp_path / "t.feather")
    df = spark.range(1_000).withColumn("s", F.col("id").cast("string")).repartition(3)
    write_feather(df, path)
    assert sorted(map(tuple, read_table(spark, path).collect())) == sorted(map(tuple, df.collect()))
