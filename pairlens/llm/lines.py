"""Line dedup across documents, batch by batch, against levelled sorted runs of line hashes, in DataFrame operations.

A run is a table of hashes, bucketed and sorted by hash, so that a batch meets it by a merge join without moving it. Each batch of documents (in ascending order of
ids) merge-anti-joins all runs: the hashes that are left are new, and make the next run. Before a batch, levels that hold `FANOUT` runs are
compacted into one run of the level above; so a hash is rewritten as often as there are levels, and a batch joins few runs.

A line goes if a run has its hash, or if a smaller id in its own batch has it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import scratch_path, written

#: Runs of one level that are compacted into one; batches that one table is cut into.
FANOUT, BATCHES = 3, 6
#: Keys with at least this share of a batch's lines (so at most as many keys as its inverse) are looked up in a broadcast table: they would be hot join keys.
HOT = 1000

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space (space, \\t to \\r) at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


class LineRuns:
    """Runs of all hashes met so far, by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _store(self, hashes: DataFrame) -> str:
        """A sorted run: a table in the shared folder, a file per bucket, hashes ascending."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        dealt = hashes.repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", scratch_path(self.spark, name)).option("compression", "zstd").saveAsTable(name)
        return name

    def fresh(self, hashes: DataFrame) -> DataFrame:
        """The rows of `hashes` (by `key`) that no run has."""
        return reduce(lambda out, name: out.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti"), (n for level in self.levels for n in level), hashes)

    def add(self, hashes: DataFrame) -> DataFrame:
        """A new run of the rows of `hashes` that no run has, read back; before that, compacts levels that are full."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = self._store(reduce(DataFrame.unionByName, (self.spark.table(n).select("key") for n in self.levels[level])))
            self.levels[level] = []
            self.levels += [[]] * (level + 2 - len(self.levels))
            level += 1
            self.levels[level] = [*self.levels[level], merged]
        name = self._store(self.fresh(hashes))
        self.levels = [[*(self.levels or [[]])[0], name], *self.levels[1:]]
        return self.spark.table(name)

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _pairs(docs: DataFrame, batch: Column, min_chars: int) -> DataFrame:
    """A row per line that counts: `batch`, `key` (128-bit hash), `id`, `text_hash`, `at` (position from 0)."""
    lines = docs.select(batch.alias("batch"), "id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    return key.select("batch", F.unhex(F.md5("line")).alias("key"), "id", "text_hash", "at")


def _later(pairs: DataFrame, runs: LineRuns) -> DataFrame:
    """The rows of one batch's `pairs` whose key a run or a smaller id of the batch has; adds the batch to the runs."""
    firsts = written(pairs.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    new = runs.add(firsts.select("key", "first"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    # At most HOT rows by their definition: their lines meet them without a shuffle.
    hot = firsts.where(F.col("n") * HOT >= total).select("key").join(new, "key", "left").select("key", "first", F.lit(True).alias("hot"))
    # No first id: a run has it. A null id comes after all others; rows without id are one document.
    goes = F.col("first").isNull() & F.col("found").isNull() | F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    hot = hot.join(new.select("key", F.lit(True).alias("found")), "key", "left")
    looked = pairs.join(F.broadcast(hot), "key", "left")
    frequent = looked.where("hot").where(goes)
    rest = looked.where("hot is null").drop("first", "hot", "found").join(new.withColumn("found", F.lit(True)).hint("merge"), "key", "left").where(goes)
    return frequent.select("id", "text_hash", "at").unionByName(rest.select("id", "text_hash", "at"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """All columns of `docs` and `n_lines` (before), `n_dropped`, `kept`: the text without lines that a document with a smaller id has too.

    Texts are split at \\n. Lines count as equal by `line_key`; those with fewer than `min_chars` code points in it always stay, as do
    repeats within a document. `id_col`: an integer. A null or empty text is one empty line; `kept` is then empty. Rows of equal ids are one document; rows with a
    null id are one document after all others. An empty table gives an empty result. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    borders = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), [i / batches for i in range(1, batches)] or [0.5])).first()[0] if batches > 1 else None
    edges = F.lit(sorted(set(borders))) if borders else F.array().cast("array<bigint>")
    batch = F.when(F.col("id").isNull(), F.lit(batches - 1)).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("id"))))
    path = scratch_path(spark, "lines")
    _pairs(whole, batch, min_chars).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    pairs = spark.read.schema("key binary, id bigint, text_hash bigint, at int, batch int").parquet(path)
    runs = LineRuns(spark)
    goes = [written(_later(pairs.where(F.col("batch") == b).drop("batch"), runs), "later") for b in range(batches)]
    runs.close()
    # A document's lines are in one row anyway; so are the positions of those that go.
    gone = reduce(DataFrame.unionByName, goes).groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("id").alias("its_id"), F.col("text_hash").alias("its_hash"), "gone")
    found = whole.join(gone, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left")
    # Per position that goes: true for each line since the one before, then false; further lines stay.
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    before = F.concat(F.array(F.lit(-1)), gone)
    stays = F.flatten(F.zip_with(gone, F.slice(before, F.lit(1), F.size(gone)), lambda p, q: F.concat(F.array_repeat(F.lit(True), p - q - 1), F.array(F.lit(False)))))
    out = found.select("own", "text", stays.alias("stays"), F.size(gone).cast("bigint").alias("n_dropped"))
    kept = F.array_join(F.zip_with(F.split("text", "\n", -1), F.col("stays"), lambda line, stay: F.when(F.coalesce(stay, F.lit(True)), line)), "\n")
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept)
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).cast("bigint")
    return out.select("own.*", n_lines.alias("n_lines"), "n_dropped", kept.alias("kept"))
