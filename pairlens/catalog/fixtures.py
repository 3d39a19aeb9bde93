"""Views on the given tables in the shapes the operators expect, in Spark and in SQL.

The SQL is written separately from the DataFrame code, so both sides of a check are
independent. Views:

  emb        subject_id, label, y, embedding           one row per vector
  blocks     subject_id, gene, chunk, row_in_chunk, embedding (8 values per gene)
  cov        subject_id, age, sex, valid               from customers
  tab        subject_id, features[6]                   per customer over order lines
  ts         subject_id, t, roi, value                 events as 30 days x 5 types
  dup        subject_id, pos, value                    events, many rows per user
  cells      brain_feature, position, fold, r_train, r_val   correlations per slice of order lines
  weights    component, position, feature, gene, weight      mean embedding per label
  strat      model, modality, r_case, r_control, r_diff, null_std, p_value
  scores     fold, y, score, tied                      linear scores of the vectors
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES = [f"g{i}" for i in range(8)]


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def t_p_value_sql(rows: str, keep: str) -> str:
    """`keep` columns and the two-sided `p` of columns t and df of `rows`, by Simpson's rule on the density in the angle atan(t / sqrt(df)), up to 40 of t or of its angle."""
    steps = 20000
    angle = "atan(least(abs(t), CASE WHEN df > 1000 THEN 40 ELSE 1e9 END) / sqrt(df))"
    f = "pow(cos(i * w), df - 1)"
    return (
        f"SELECT {keep}, CASE WHEN count(i) > 0 THEN greatest(1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * sum({f} * CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * w / 3, 0) END AS p "
        f"FROM (SELECT *, {angle} / {steps} AS w FROM {rows}) LEFT JOIN range({steps + 1}) AS s(i) ON t IS NOT NULL AND df > 0 GROUP BY {keep}, t, df, w"
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("subject_id"), "label", (F.col("label") >= 5).cast("int").alias("y"), "embedding"
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    parts = F.array(*[F.struct(F.lit(g).alias("gene"), F.slice("embedding", 8 * i + 1, 8).alias("embedding")) for i, g in enumerate(GENES)])
    return e.select(
        F.col("vec_id").cast("string").alias("subject_id"),
        F.floor(F.col("vec_id") / 50).cast("int").alias("chunk"),
        (F.col("vec_id") % 50).alias("row_in_chunk"),
        F.inline(parts),
    )


def cov(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("subject_id"),
        F.col("c_acctbal").alias("age"),
        (F.col("c_nationkey") % 2).cast("double").alias("sex"),
        (F.col("c_mktsegment") != "MACHINERY").alias("valid"),
    )


def tab(spark: SparkSession, sf: str) -> DataFrame:
    # Odd divisors keep averages of two-decimal values away from rounding ties.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    agg = joined.groupBy(F.col("o_custkey").cast("string").alias("subject_id")).agg(
        (F.count(F.lit(1)) / 10).alias("f0"),
        (F.avg("l_extendedprice") / 9973).alias("f1"),
        (F.avg("l_quantity") / 9.97).alias("f2"),
        (F.avg("l_discount") / 0.1003).alias("f3"),
        (F.avg("l_tax") / 0.1003).alias("f4"),
        (F.max("l_extendedprice") / 99991).alias("f5"),
    )
    return agg.select("subject_id", F.array(*[f"f{i}" for i in range(6)]).alias("features"))


def tab_nan(spark: SparkSession, sf: str) -> DataFrame:
    """`tab` with NaN as second feature of every 17th customer."""
    broken = F.col("subject_id").cast("long") % 17 == 0
    spoiled = F.transform("features", lambda x, i: F.when(broken & (i == 1), F.lit(float("nan"))).otherwise(x))
    return tab(spark, sf).withColumn("features", spoiled)


def ts(spark: SparkSession, sf: str, constant: bool = True) -> DataFrame:
    """Zero-filled daily sums per user and event type; type 4 is switched off for every 7th user."""
    ev = table(spark, sf, "events").select("ts", "user_id", "event_type", "value")
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    sums = ev.groupBy(
        "user_id", F.datediff("ts", F.lit("2024-01-01")).alias("t"), (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("roi")
    ).agg(F.sum("value").alias("value"))
    grid = ev.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t")).select(
        "user_id", "t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("roi")
    )
    filled = grid.join(sums, ["user_id", "t", "roi"], "left")
    value = F.coalesce("value", F.lit(0.0))
    if constant:
        value = F.when((F.col("roi") == 4) & (F.col("user_id") % 7 == 0), 0.0).otherwise(value)
    return filled.select(F.col("user_id").cast("string").alias("subject_id"), "t", "roi", value.alias("value"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]  # fixed values, alphabetical


def dup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject_id"), F.col("event_id").alias("pos"), F.col("value"), F.col("event_type").alias("kind")
    )


def _corr(a: str, b: str) -> F.Column:
    return F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("brain_feature"), F.col("l_linenumber").alias("position"), (F.col("l_orderkey") % 5).cast("int").alias("fold")
    ).agg(_corr("l_quantity", "l_extendedprice").alias("r_train"), _corr("l_quantity", "l_discount").alias("r_val"))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("component"), F.posexplode("embedding").alias("position", "v"))
    means = e.groupBy("component", "position").agg(F.avg(F.col("v").cast("double")).alias("weight"))
    return means.select(
        "component",
        "position",
        F.concat(F.lit("f"), F.lpad(F.col("position").cast("string"), 2, "0")).alias("feature"),
        F.concat(F.lit("g"), F.floor(F.col("position") / 8).cast("string")).alias("gene"),
        "weight",
    )


def strat(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    case = F.col("o_custkey") % 2 == 1

    def corr_of(flag) -> F.Column:
        a, b = F.when(flag, F.col("o_totalprice")), F.when(flag, F.col("o_orderkey").cast("double"))
        return F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))

    rows = o.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("modality")).agg(
        corr_of(case).alias("r_case"),
        corr_of(~case).alias("r_control"),
        (F.stddev_pop("o_totalprice") / 1000000).alias("null_std"),
        ((F.count_if(F.col("o_totalprice") > 450000) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
    return rows.withColumn("r_diff", F.col("r_case") - F.col("r_control"))


def contrast(vector: str, k: int):
    """A score of the whole vector: its values, weighted by a pattern from -3 to 3 that depends on k."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * ((i + 1) * k % 7 - 3))
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)


def contrast_sql(k: int) -> str:
    return f"list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (i * {k} % 7 - 3)))"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    x = contrast("embedding", 1)
    return e.select(
        F.col("vec_id").cast("string").alias("subject_id"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        (F.col("label") >= 5).cast("int").alias("y"),
        x.alias("score"),
        F.round(x, 1).alias("tied"),
    )


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A large table with few distinct scores: order lines, flag R against the discount."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"),
        (F.col("l_discount") > 0.05).cast("int").alias("yhat"),
    )


# ---- the same views in SQL -------------------------------------------------------

CTES: dict[str, str] = {
    "emb": "SELECT CAST(vec_id AS VARCHAR) AS subject_id, label, CAST(label >= 5 AS INTEGER) AS y, embedding FROM embeddings",
    "blocks": (
        "SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(vec_id // 50 AS INTEGER) AS chunk, vec_id % 50 AS row_in_chunk, "
        "'g' || CAST(g AS VARCHAR) AS gene, embedding[8 * g + 1 : 8 * g + 8] AS embedding FROM embeddings, range(8) AS r(g)"
    ),
    "block_values": (
        "SELECT b.subject_id, b.gene, d, CAST(b.embedding[d] AS DOUBLE) AS v FROM blocks AS b, range(1, 9) AS r(d)"
    ),
    "cov": (
        "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_acctbal AS age, CAST(c_nationkey % 2 AS DOUBLE) AS sex, "
        "c_mktsegment <> 'MACHINERY' AS valid FROM customer"
    ),
    "tab": (
        "SELECT CAST(o_custkey AS VARCHAR) AS subject_id, count(*) / 10.0::DOUBLE AS f0, avg(l_extendedprice) / 9973 AS f1, "
        "avg(l_quantity) / 9.97::DOUBLE AS f2, avg(l_discount) / 0.1003::DOUBLE AS f3, avg(l_tax) / 0.1003::DOUBLE AS f4, max(l_extendedprice) / 99991 AS f5 "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"
    ),
    "ts_all": (
        "SELECT CAST(g.user_id AS VARCHAR) AS subject_id, g.user_id, CAST(g.t AS INTEGER) AS t, CAST(g.roi AS INTEGER) AS roi, coalesce(s.v, 0.0) AS value FROM "
        "(SELECT user_id, t, roi FROM (SELECT DISTINCT user_id FROM events), range(30) AS a(t), range(5) AS b(roi)) AS g LEFT JOIN "
        "(SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, "
        "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS roi, sum(value) AS v FROM events GROUP BY 1, 2, 3) AS s "
        "ON g.user_id = s.user_id AND g.t = s.t AND g.roi = s.roi"
    ),
    "ts": "SELECT subject_id, t, roi, CASE WHEN roi = 4 AND user_id % 7 = 0 THEN 0.0 ELSE value END AS value FROM ts_all",
    "dup": "SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id AS pos, value, event_type AS kind FROM events",
    "cells": (
        "SELECT l_returnflag AS brain_feature, l_linenumber AS position, CAST(l_orderkey % 5 AS INTEGER) AS fold, "
        "corr(l_quantity, l_extendedprice) AS r_train, corr(l_quantity, l_discount) AS r_val FROM lineitem GROUP BY 1, 2, 3"
    ),
    "weights": (
        "SELECT label AS component, CAST(d - 1 AS INTEGER) AS position, 'f' || lpad(CAST(d - 1 AS VARCHAR), 2, '0') AS feature, "
        "'g' || CAST((d - 1) // 8 AS VARCHAR) AS gene, avg(CAST(embedding[d] AS DOUBLE)) AS weight FROM embeddings, range(1, 65) AS r(d) GROUP BY label, d"
    ),
    "strat": (
        "SELECT *, r_case - r_control AS r_diff FROM (SELECT o_orderpriority AS model, o_orderstatus AS modality, "
        "corr(o_totalprice, CAST(o_orderkey AS DOUBLE)) FILTER (WHERE o_custkey % 2 = 1) AS r_case, "
        "corr(o_totalprice, CAST(o_orderkey AS DOUBLE)) FILTER (WHERE o_custkey % 2 = 0) AS r_control, "
        "stddev_pop(o_totalprice) / 1000000 AS null_std, (count(*) FILTER (WHERE o_totalprice > 450000) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value "
        "FROM orders GROUP BY 1, 2)"
    ),
    "scores": (
        "SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(vec_id % 5 AS INTEGER) AS fold, CAST(label >= 5 AS INTEGER) AS y, "
        f"{contrast_sql(1)} AS score, round({contrast_sql(1)}, 1) AS tied FROM embeddings"
    ),
    "line_scores": (
        "SELECT l_linestatus AS grp, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount AS score, CAST(l_discount > 0.05 AS INTEGER) AS yhat FROM lineitem"
    ),
}

_NEEDS = {"block_values": ["blocks"], "ts": ["ts_all"]}


def sql(views: str, body: str, **extra: str) -> str:
    """`WITH <views> <body>`; views are names of CTES, extra ones are given as keywords."""
    names: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in names:
            names.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def round_columns(df: DataFrame, *columns: str) -> DataFrame:
    from pairlens.functions import round6

    return df.withColumns({c: round6(c) for c in columns})
