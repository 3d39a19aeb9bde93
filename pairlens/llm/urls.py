"""URL filter: rules first, then a character language-model ratio, all in DataFrame operations.

The urls that a rule settles are the labels. Two variable-order Markov models, one of allowed and one of blocked urls, give each character's
probability after up to `ORDER` characters by Witten-Bell interpolation down to the uniform one. A url's score is the mean log ratio per
character; the cut is the one that tells the held-out labelled urls apart best (true plus false rate, in steps of 0.01).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pairlens.session import written

ORDER = 4
#: One labelled url of so many, by hash, calibrates the cut instead of training.
HELD_OUT = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule (verdict, host, path) that fits, else null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _grams(url: Column) -> Column:
    """Each character (and the end mark) with the `ORDER` ones before it, padded at the start."""
    marked = F.concat(F.lit("\u0001" * ORDER), url, F.lit("\u0002"))
    return F.regexp_extract_all(marked, F.lit(rf"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def _merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows joined where they lie, sorted. Spark takes a table for as large as its compressed files, also once each url is one row per
    character: left to choose, it would send all those rows through the driver's memory."""
    return left.join(right.hint("merge"), key)


def log_ratios(counts: DataFrame) -> DataFrame:
    """`gram`, `ratio`: log of the allowed model's probability of the last character over the blocked one's.

    counts: `gram` (of `ORDER` + 1 characters), `a`, `b` (its weights among allowed and blocked urls, 0 where never seen).
    """
    shorter = None
    for k in range(1, ORDER + 2):
        level = counts.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumns({"context": F.left("gram", F.lit(k - 1)), "rest": F.right("gram", F.lit(k - 1))})
        after = level.groupBy("context").agg(*(f(x).alias(f"{n}{x}") for x in "ab" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))))
        level = _merged(level, after, "context")
        if shorter is None:
            level = level.withColumns({"qa": F.lit(1 / 256), "qb": F.lit(1 / 256)})
        else:
            level = _merged(level, shorter, "rest")
        chance = {f"p{x}": F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"q{x}")) for x in "ab"}
        level = level.withColumns(chance)
        shorter = level.select(F.col("gram").alias("rest"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    return shorter.select(F.col("rest").alias("gram"), (F.log("qa") - F.log("qb")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, `host`, `path`, `rule`, `verdict` (allow or block) and `score` per row.

    rules: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest one wins and settles the verdict. Other
    urls are allowed if their score reaches the cut. A null url is scored as the empty one. Equal urls are counted and scored
    once, with their number as weight, so that a frequent url or host makes no hot group; without labels of both kinds to hold out the cut is 0.
    An empty table gives an empty result.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.groupBy(url.alias("url")).agg(F.count("*").alias("n"))
    ruled = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    held = F.conv(F.left(F.md5("url"), F.lit(8)), 16, 10).cast("bigint") % HELD_OUT == 0
    urls = written(urls.select("url", "n", ruled.alias("ruled"), held.alias("held")), "urls")

    places = urls.select("url", "n", "ruled", "held", F.explode(_grams(F.col("url"))).alias("gram"))
    weight = {x: F.sum(F.when((F.col("ruled") == v) & ~F.col("held"), F.col("n")).otherwise(0)).alias(x) for x, v in (("a", "allow"), ("b", "block"))}
    counts = written(places.groupBy("gram").agg(*weight.values()), "grams")
    scored = _merged(places.select("url", "gram"), log_ratios(counts), "gram").groupBy("url").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = written(_merged(urls, scored, "url").select("url", "n", "ruled", "held", "score"), "scores")
    cut = calibrated_cut(scored.where("held and ruled is not null"))
    judged = scored.select("url", "score", F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"))
    out = _merged(pages.select(id_col, url.alias("url")), judged, "url")
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["rule"]
    return out.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), "verdict", "score")


def calibrated_cut(labelled: DataFrame) -> float:
    """The cut (a multiple of 0.01, the lowest of equals) with the largest sum of kept allowed and dropped blocked shares."""
    bins = labelled.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(*(F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(x) for x, v in (("a", "allow"), ("b", "block"))))
    # A few thousand bins: the log of a ratio of probabilities is bounded by the smoothing.
    below, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    gain = reduce(lambda x, y: x - y, (F.coalesce(F.sum(x).over(below), F.lit(0)) / F.sum(x).over(whole) for x in "ba"))
    best = bins.withColumn("gain", gain).where("gain is not null").orderBy(F.desc("gain"), "bin").select("bin").first()
    return best[0] / 100 if best else 0.0
