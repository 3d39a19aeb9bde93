"""p-values against tabulated ones."""

import math

import pytest
from pyspark.sql import functions as F

from pairlens.functions.stats import incomplete_beta, log_gamma, r_two_sided, t_two_sided

#: Two-sided critical values of Student's t as printed in tables: degrees of freedom, p, t.
TABLE = [(1, 0.5, 1.0), (1, 0.05, 12.7062), (2, 0.05, 4.30265), (4, 0.05, 2.776445), (4, 0.01, 4.604095), (5, 0.1, 2.015048), (10, 0.05, 2.228139), (10, 0.001, 4.586894), (30, 0.05, 2.042272), (60, 0.01, 2.660283), (120, 0.05, 1.97993)]


def test_tabulated_t(spark):
    rows = spark.createDataFrame([(t, n, p) for n, p, t in TABLE], "t double, df bigint, p double")
    for r in rows.select("p", t_two_sided(F.col("t"), F.col("df")).alias("got"), t_two_sided(-F.col("t"), F.col("df")).alias("other")).collect():
        assert math.isclose(r["got"], r["p"], rel_tol=2e-5) and r["got"] == r["other"]


def test_large_degrees_of_freedom_are_normal(spark):
    rows = spark.createDataFrame([(z, n) for z in (0.1, 1.0, 1.959964, 3.0, 6.0) for n in (10**5, 10**7)], "t double, df bigint")
    for r in rows.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect():
        assert math.isclose(r["p"], math.erfc(r["t"] / math.sqrt(2)), rel_tol=5e-3 if r["t"] == 6 and r["df"] == 10**5 else 5e-4)


def test_r_is_the_t_it_stands_for(spark):
    rows = spark.createDataFrame([(r, n) for r in (-0.9, -0.2, 0.0, 0.05, 0.7, 0.999) for n in (1, 3, 40, 5000)], "r double, df bigint")
    t = F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r")))
    for r in rows.select(r_two_sided(F.col("r"), F.col("df")).alias("a"), t_two_sided(t, F.col("df")).alias("b")).collect():
        assert math.isclose(r["a"], r["b"], rel_tol=1e-9, abs_tol=1e-300)


def test_edges(spark):
    one = spark.range(1)
    got = one.select(
        r_two_sided(F.lit(1.0), F.lit(5)).alias("sure"), r_two_sided(F.lit(0.0), F.lit(5)).alias("none"), t_two_sided(F.lit(None).cast("double"), F.lit(5)).alias("null"),
        t_two_sided(F.lit(1.0), F.lit(0)).alias("no_df"), t_two_sided(F.lit(1e9), F.lit(100)).alias("far"),
    ).first()
    assert tuple(got) == (0.0, 1.0, None, None, 0.0)


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 3.7, 50.0, 1e6])
def test_log_gamma(spark, x):
    assert math.isclose(spark.range(1).select(log_gamma(F.lit(x))).first()[0], math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11)


def test_incomplete_beta_of_whole_parameters(spark):
    """For whole a, b it is a tail of the binomial distribution."""
    for a, b, x in ((2, 3, 0.3), (5, 1, 0.9), (1, 7, 0.02), (20, 30, 0.45)):
        n = a + b - 1
        want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert math.isclose(spark.range(1).select(incomplete_beta(F.lit(float(a)), F.lit(float(b)), F.lit(x))).first()[0], want, rel_tol=1e-10)
