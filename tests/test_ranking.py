"""Order-based operators against brute force, with one hot key and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import metrics, ranking, splits

RNG = np.random.default_rng(1)


def hot_frame(n=3000):
    key = np.where(RNG.random(n) < 0.4, "hot", RNG.choice(list("abcdef"), n))
    return pd.DataFrame({"key": key, "id": RNG.permutation(n), "v": RNG.integers(0, 100, n)})


def test_keep_first_and_last_with_hot_key(spark):
    pdf = hot_frame()
    df = spark.createDataFrame(pdf)
    first = ranking.keep_first(df, "key", "id").toPandas().set_index("key")["v"]
    last = ranking.keep_last(df, "key", "id").toPandas().set_index("key")["v"]
    by = pdf.sort_values("id").groupby("key")["v"]
    assert first.to_dict() == by.first().to_dict() and last.to_dict() == by.last().to_dict()


@pytest.mark.parametrize("buckets", [2, 64])
def test_running_totals(spark, buckets):
    pdf = hot_frame()
    got = ranking.running_totals(spark.createDataFrame(pdf), ["key"], "id", ["v"], buckets).toPandas()
    pdf = pdf.sort_values("id")
    pdf["want"] = pdf.groupby("key")["v"].cumsum() - pdf["v"]
    both = got.merge(pdf[["id", "want"]], on="id")
    assert len(both) == len(pdf) and (both["v_before"] == both["want"]).all()


def test_hash_rank_is_a_permutation_per_key(spark):
    pdf = hot_frame()
    got = ranking.hash_rank(spark.createDataFrame(pdf), ["key"], "id", 5, hex_digits=1).toPandas()
    for _, part in got.groupby("key"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    other = ranking.hash_rank(spark.createDataFrame(pdf), ["key"], "id", 5, hex_digits=4).toPandas()
    assert got.set_index("id")["rank"].to_dict() == other.set_index("id")["rank"].to_dict()


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


def brute_ap(y, s):
    total, ap = y.sum(), 0.0
    for t in np.unique(s):
        hit = s >= t
        ap += y[s == t].sum() / total * (y[hit].sum() / hit.sum())
    return ap


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_and_ap(spark, digits):
    n = 900
    y = RNG.integers(0, 2, n)
    s = np.round(RNG.standard_normal(n) + 0.4 * y, digits)
    g = np.where(RNG.random(n) < 0.8, "big", "small")
    got = metrics.ranking_metrics(spark.createDataFrame(pd.DataFrame({"g": g, "y": y, "score": s})), ["g"]).toPandas().set_index("g")
    for k in ("big", "small"):
        m = g == k
        assert abs(got.loc[k, "auc"] - brute_auc(y[m], s[m])) < 1e-12
        assert abs(got.loc[k, "ap"] - brute_ap(y[m], s[m])) < 1e-12


def test_holdout_of_4218_is_844(spark):
    df = spark.range(4218).select(F.col("id").cast("string").alias("subject_id"), (F.col("id") % 1000 < 411).cast("int").alias("y"))
    got = splits.stratified_holdout(df).groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    assert got == {"holdout": 844, "train": 3374}


def test_topk_trims_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_frame())
    plan = ranking.top_k(df, ["key"], [F.col("v").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
