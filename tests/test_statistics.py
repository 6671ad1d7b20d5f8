"""Tests of association, distributions and metrics against definitions and known values."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colonnade.functions.distributions import beta_lower, chi2_sf, f_sf, gamma_upper, normal_sf
from colonnade.functions.normal import inverse_normal
from colonnade.operators import association as A, correlation as K, gram, metrics as M


def tau_b(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in combinations(range(len(x)), 2))
    n0 = len(x) * (len(x) - 1) / 2
    tie = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    return s / math.sqrt((n0 - tie(x)) * (n0 - tie(y)))


def test_kendall_is_brute_force(spark):
    draw = np.random.RandomState(3)
    a, b = draw.normal(size=150), draw.randint(0, 6, 150).astype(float)
    c = np.round(a + draw.normal(size=150), 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    cols = {"a": a, "b": b, "c": c}
    for r in K.correlation_long(df, ["kendall"]).collect():
        assert r["kendall"] == pytest.approx(tau_b(cols[r["column_1"]], cols[r["column_2"]]), abs=1e-12)


def test_rank_correlation_uses_pairwise_complete_rows(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 3.0), (3.0, 1.0, 2.0), (4.0, 5.0, 4.0), (5.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["column_1"], r["column_2"]): r for r in K.correlation_long(df).collect()}
    whole = [r for r in rows if r[1] is not None]
    assert got[("a", "b")]["kendall"] == pytest.approx(tau_b([r[0] for r in whole], [r[1] for r in whole]))
    assert got[("a", "c")]["kendall"] == pytest.approx(tau_b([r[0] for r in rows], [r[2] for r in rows]))
    assert got[("a", "b")]["spearman"] == pytest.approx(0.6)


@pytest.mark.parametrize("looked_up", [True, False])
def test_ranks_with_nulls_and_ties(spark, monkeypatch, looked_up):
    """Every pair on its own complete rows, whether ranks are looked up or joined."""
    monkeypatch.setattr(K, "RANK_VALUES", 10**9 if looked_up else 0)
    draw = np.random.RandomState(5)
    m = draw.randint(0, 9, (120, 4)).astype(float)
    m[:, 1] += draw.normal(size=120)
    m[draw.rand(120) < 0.2, 1] = np.nan
    m[draw.rand(120) < 0.3, 2] = np.nan
    m[3, 0], m[4, 3] = np.inf, -0.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, `d e` double").repartition(3)
    got = {(r["column_1"], r["column_2"]): r for r in K.correlation_long(df, ["spearman", "kendall"]).collect()}
    assert len(got) == 6
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for (i, a), (j, b) in combinations(enumerate(["a", "b", "c", "d e"]), 2):
        rows = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
        x, y = m[rows, i], m[rows, j]
        assert got[a, b]["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-12)
        assert got[a, b]["kendall"] == pytest.approx(tau_b(x, y), abs=1e-12)


def test_pairs_of_one_null_pattern_share_a_ranking():
    plan = K.plan_rankings([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")], {"d"})
    assert plan.keys == [("a", ()), ("b", ()), ("c", ()), ("a", ("d",)), ("d", ("d",))] and plan.sides == [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_places_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(K, "DENSE_BUCKETS", 7)
    draw = np.random.RandomState(6)
    x, y = draw.normal(size=200), draw.randint(0, 90, 200).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert K.correlation_long(df, ["kendall"]).first()["kendall"] == pytest.approx(tau_b(x, y), abs=1e-12)


@pytest.mark.parametrize("tile", [1_000, 70])
def test_pearson_of_a_thousand_columns(spark, monkeypatch, tile):
    """One scan per block of columns, each pair on its complete rows; far means, constants, infinities."""
    monkeypatch.setattr(gram, "TILE", tile)
    width = 1_000 if tile == 1_000 else 200
    draw = np.random.RandomState(8)
    m = draw.normal(size=(60, width)) + draw.randint(-5, 5, width) * 1e6
    m[:, 1:] += 0.5 * (m[:, :-1] - m[:, :-1].mean(0))
    m[draw.rand(*m.shape) < 0.05] = np.nan
    m[:, 7], m[5, 9] = 4.0, np.inf
    df = spark.createDataFrame(pa.table({f"c {i}": m[:, i] for i in range(width)})).repartition(5)
    pairs = list(combinations(range(width), 2))
    out = K.pearson_pairs(df, [(f"c {b}", f"c {a}") if (a + b) % 2 else (f"c {a}", f"c {b}") for a, b in pairs])
    got = out.toPandas().set_index(["column_1", "column_2"])["pearson"]
    assert len(got) == len(pairs)
    for a, b in [(0, 1), (7, 8), (3, 9), (9, 10), (width - 2, width - 1), (2, width - 1)] + [pairs[i] for i in draw.randint(0, len(pairs), 200)]:
        value = got[(f"c {b}", f"c {a}") if (a + b) % 2 else (f"c {a}", f"c {b}")]
        rows = ~np.isnan(m[:, a]) & ~np.isnan(m[:, b])
        if 7 in (a, b) or (9 in (a, b) and rows[5]):
            assert np.isnan(value)
        else:
            assert value == pytest.approx(np.corrcoef(m[rows, a], m[rows, b])[0, 1], abs=1e-7)


def test_constant_column_has_no_correlation(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    row = K.correlation_long(df).first()
    assert row["pearson"] is None and row["spearman"] is None and row["kendall"] is None


def test_distribution_tails_match_commons_math(spark):
    math3 = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for f, a, b in ((0.5, 2, 10), (3.2, 4, 295), (1.0, 1, 1), (12.0, 5, 40), (0.01, 3, 7)):
        want = 1 - math3.FDistribution(float(a), float(b)).cumulativeProbability(f)
        assert beta_lower(np.array([b / 2]), np.array([a / 2]), np.array([b / (b + a * f)]))[0] == pytest.approx(want, rel=1e-8)
    for x, k in ((0.3, 1), (5.0, 4), (40.0, 12), (150.0, 100)):
        want = 1 - math3.ChiSquaredDistribution(float(k)).cumulativeProbability(x)
        assert gamma_upper(np.array([k / 2]), np.array([x / 2]))[0] == pytest.approx(want, rel=1e-7)
    df = spark.createDataFrame([(2.0, 3.0, 9.0), (None, 1.0, 1.0)], "x double, a double, b double")
    rows = df.select(f_sf(F.col("x"), F.col("a"), F.col("b")).alias("f"), chi2_sf(F.col("x"), F.col("a")).alias("c"), normal_sf(F.col("x")).alias("n")).collect()
    assert rows[0]["n"] == pytest.approx(1 - NormalDist().cdf(2.0)) and rows[1]["f"] is None


def test_inverse_normal(spark):
    ps = [0.0001, 0.01, 0.024, 0.3, 0.5, 0.8, 0.99, 0.99999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p")).alias("z")).collect()
    for p, r in zip(ps, got):
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_shapiro_wilk_known_value(spark):
    """The weights of eleven men from the 1965 paper: W = 0.7888, p = 0.0067."""
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("g", float(w)) for w in weights], "g string, x double")
    row = A.shapiro_wilk(df, ["g"], "x").withColumn("p", A.shapiro_p(F.col("n"), F.col("w"), F.col("z"))).first()
    assert row["w"] == pytest.approx(0.78881, abs=1e-4) and row["p"] == pytest.approx(0.006704, abs=1e-4)


def test_shapiro_wilk_accepts_normal_scores_and_constants(spark):
    rows = [("n", NormalDist().inv_cdf((i + 0.5) / 60)) for i in range(60)] + [("c", 1.0)] * 10
    out = A.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")
    got = {r["g"]: r for r in out.withColumn("p", A.shapiro_p(F.col("n"), F.col("w"), F.col("z"))).collect()}
    assert got["n"]["w"] > 0.99 and got["n"]["p"] > 0.9 and "c" not in got


def test_numeric_by_category_finds_a_shift(spark):
    noise = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("n"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    df = spark.range(3_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), noise.alias("u")).withColumn(
        "shifted", F.col("u") + F.when(F.col("g") == "a", 0.2).otherwise(0.0))
    got = {r["num_column"]: r for r in A.numeric_by_category(df, "id", ["g"], ["u", "shifted"]).collect()}
    assert got["shifted"]["conclusion"] == "Rejected" and got["shifted"]["full_groups"] == "Full"
    assert got["u"]["conclusion"] in ("Failed to Reject", None)


def test_yates_only_for_one_degree_of_freedom(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "p string, q string")
    row = A.category_by_category(df).first()
    n, ad_bc = 65, abs(10 * 5 - 20 * 30)
    assert row["chi2"] == pytest.approx(n * (ad_bc - n / 2) ** 2 / (30 * 35 * 40 * 25))
    assert row["phi"] == pytest.approx((10 * 5 - 20 * 30) / math.sqrt(30 * 35 * 40 * 25)) and row["variables"] == "Two Binary"


def scores(spark, rows):
    """rows: (id, actual, P(yes))"""
    out = []
    for i, actual, p in rows:
        pred = "yes" if p >= 0.5 else "no"
        out += [(i, "m", actual, pred, "yes", p), (i, "m", actual, pred, "no", 1 - p)]
    return spark.createDataFrame(out, "id int, model string, actual string, pred string, class string, proba double")


def values(df):
    return {r["metric"]: r["value"] for r in df.where("class is null").collect()}


def test_metrics_with_ties(spark):
    got = values(M.classification_metrics(scores(spark, [(1, "yes", 0.5), (2, "no", 0.5), (3, "yes", 0.5), (4, "no", 0.5)]), ["model"], "yes"))
    assert got["ROC AUC"] == 0.5 and got["Avg Precision"] == 0.5 and got["Recall"] == 1.0 and got["Precision"] == 0.5


def test_perfect_and_one_class(spark):
    perfect = values(M.classification_metrics(scores(spark, [(1, "yes", 0.9), (2, "no", 0.1)]), ["model"], "yes"))
    assert set(perfect.values()) == {1.0}
    single = values(M.classification_metrics(scores(spark, [(1, "no", 0.2), (2, "no", 0.3)]), ["model"], "yes"))
    assert single["ROC AUC"] is None and single["Precision"] == 0.0 and single["Accuracy"] == 1.0


def test_ranking_is_brute_force_whatever_the_buckets(spark):
    draw = np.random.RandomState(5)
    p = np.round(draw.uniform(size=200), 2)
    y = draw.uniform(size=200) < p
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y]])
    df = spark.createDataFrame([("m", float(s), bool(h)) for s, h in zip(p, y)], "model string, score double, hit boolean")
    for buckets in (1, 7, 50):
        assert M.ranking_scores(df, ["model"], buckets).first()["ROC AUC"] == pytest.approx(wins)


def test_regression_metrics_perfect(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "actual double, pred double").withColumn("model", F.lit("A 1"))
    df = df.unionByName(df.withColumn("model", F.lit("A 10")).withColumn("pred", F.col("pred") + 1))
    got = {(r["model"], r["metric"]): r["value"] for r in M.regression_metrics(df, ["model"]).collect()}
    assert got[("A 1", "R2")] == 1.0 and got[("A 1", "MedAE")] == 0.0 and got[("A 10", "MAE")] == 1.0
