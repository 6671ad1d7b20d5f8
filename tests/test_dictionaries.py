"""Category lists of any length: places, sparse one-hot codes, ordinals, labels, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators import dictionaries as D, features as X, ordering as O
from colonnade.plans.features import FeatureOptions, FeaturePlan
from colonnade.session import scratch_path

VALUES = 20_000


@pytest.fixture(scope="module")
def keyed(spark):
    """20,000 keys, a third of the rows under one of them, nulls, and keys that the fit never saw."""
    rows = spark.range(60_000).withColumn("key", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.format_string("k%05d", F.col("id") % VALUES)))
    return rows.withColumn("few", F.when(F.col("id") % 4 == 0, "a").otherwise("b")).repartition(8).persist()


def expected(rows):
    known = sorted({r["key"] for r in rows if r["key"] is not None})
    return {k: i for i, k in enumerate(known)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_hot_of_twenty_thousand_values(spark, keyed, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_VALUES", 100_000 if broadcast else 10)
    train = keyed.where("id < 50000")
    places = expected(train.collect())
    assert len(places) > X.MAX_CATEGORIES
    dictionary = D.fit_dictionary(train, ["key"])
    assert D.dictionary_sizes(dictionary) == {"key": len(places) + 1}
    new = keyed.select("id", F.when(F.col("id") % 11 == 0, "never seen").otherwise(F.col("key")).alias("key"))
    for drop_first in (True, False):
        got = D.one_hot_vectors(new, dictionary, ["key"], drop_first).join(new, "id").collect()
        assert len(got) == 60_000
        for r in got:
            place = len(places) if r["key"] is None else places.get(r["key"])
            want = [] if place is None or place < drop_first else [place - drop_first]
            assert r["key_onehot"].size == len(places) + 1 - drop_first and r["key_onehot"].indices.tolist() == want


def test_ordinals_and_labels(spark, keyed, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_VALUES", 10)
    places = expected(keyed.collect())
    dictionary = D.fit_dictionary(keyed, ["key"])
    new = keyed.withColumn("was", F.col("key")).withColumn("key", F.when(F.col("id") % 11 == 0, "never seen").otherwise(F.col("key")))
    for r in D.ordinal_codes(new.withColumn("now", F.col("key")), dictionary, ["key"]).collect():
        assert r["key"] == places.get(r["now"], -1)
    coded = D.label_names(D.label_codes(new, dictionary, "key"), dictionary, "key", "label", "name").collect()
    assert all((r["label"], r["name"]) == ((places[r["key"]], r["key"]) if r["key"] in places else (None, None)) for r in coded)
    classes = X.fit_labels(keyed, "key")
    assert classes == sorted(places)
    again = X.encode_label(keyed, "key", classes).withColumn("name", X.decode_label(F.col("label"), classes))
    assert again.where("not (name <=> key)").count() == 0 and again.agg(F.max("label")).first()[0] == len(places) - 1


def test_places_are_numbered_within_their_group(spark):
    rows = spark.createDataFrame([(g, f"{v:04d}") for g in "xyz" for v in np.random.RandomState(ord(g)).permutation(700)], "g string, v string")
    got = D.positions_in_order(rows, "g", "v").collect()
    assert len(got) == 2_100 and all(int(r["v"]) == r["position"] for r in got)


def test_rows_meet_their_value_whatever_its_share(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 2 else f"v{i % 400}", "w") for i in range(2_000)], "id int, k string, n string")
    table = rows.where("k is not null and k <> 'v8'").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("top"))
    want = {r["k"]: r["top"] for r in table.collect()}
    got = O.spread_left_join(rows, table, "k", "size").collect()
    assert len(got) == 2_000 and all(r["top"] == want.get(r["k"]) for r in got)


@pytest.mark.parametrize("encoding", ["one_hot", "ordinal"])
@pytest.mark.parametrize("missing", [True, False])
def test_plan_with_a_long_list(spark, keyed, encoding, missing):
    df = keyed.withColumn("y", F.rand(1))
    plan = FeaturePlan.fit(df, FeatureOptions("id", "y", encoding=encoding, missing_category=missing))
    assert list(plan.long) == ["key"] and list(plan.categories) == ["few"]
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    loaded = FeaturePlan.load(spark, path)
    sizes = [v.size for v in (r["features"] for r in loaded.assembled(df).limit(20).collect())]
    few = sum(f.startswith("few") for f in loaded.features)
    assert set(sizes) == {loaded.width} and loaded.width == few + (1 if encoding == "ordinal" else plan.long["key"] - 1)
    assert loaded.assembled(df).count() == 60_000


def test_columns_with_nothing_to_tell_apart(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None)], "id int, one string, none string")
    coded = D.one_hot_vectors(df, D.fit_dictionary(df, ["one", "none"]), ["one", "none"])
    assert coded.columns == ["id"] and coded.count() == 2
    empty = D.fit_dictionary(df.limit(0), ["one"])
    assert empty.count() == 0 and D.one_hot_vectors(df, empty, ["one"]).columns == ["id", "none"]
