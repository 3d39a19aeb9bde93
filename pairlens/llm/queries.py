"""The registered queries of this package, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import archives, language, lines, merkle, negatives, packing, pivots, simhash, sql, suffixes, toxicity, unigram, urls, whitening
from pairlens.llm.arrays import floors
from pairlens.llm.samples import id_remainder

#: Fixed values of the packing contract.
CAPACITY, END_ID = 4096, 1
#: Fixed value of the whitening contract.
WHITE_SHIFT = 1000000
#: Fixed values of the url contract: verdict, host, path prefix.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every url: by rule, else by the language-model ratio."""
    return urls.filter_urls(_table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Merkle fingerprints of every document, of an edit of it, and their likeness."""
    out = merkle.fingerprints_of_edits(_table(spark, sf, "documents"))
    return out.withColumn("edited_paragraphs", F.array_join("edited_paragraphs", ","))


def op3_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


def op4_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written as ARC, converted to WARC, read back."""
    out = archives.archive_round_trip(_table(spark, sf, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pivot_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector by integer inner product."""
    return pivots.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes left of every document once repeated 50-byte strings are gone."""
    out = suffixes.remove_repeats(_table(spark, sf, "documents"), 50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of every document by fingerprints at most 3 bits apart."""
    out = simhash.near_duplicates(_table(spark, sf, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


def op8_streaming_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document by streaming Viterbi, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = unigram.decode(unigram.encode(_table(spark, sf, "documents").select("doc_id", "text"), model), model)
    packed = F.sha2(F.array_join("ids", ","), 256)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), packed.alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("same_text"))


def op9_ppm_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by the shortest PPM code."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    trees = language.fit(docs.where(id_remainder("doc_id", 3) != 1))
    out = language.identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document by subword-bag embeddings."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(id_remainder("doc_id", 5) != 0), _table(spark, sf, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_secondary_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives; the labels of every seventh row are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf, "embeddings").select("vec_id", floors(F.col("embedding"), 256).alias("vec"), label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    out = lines.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    rows = _table(spark, sf, "embeddings").select("vec_id", floors(F.col("embedding"), 64, WHITE_SHIFT).alias("vec"))
    out = whitening.whiten(rows, 32, padding=WHITE_SHIFT)
    each = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


_ALL = (op1_url_filter, op2_merkle, op3_best_fit, op4_arc_to_warc, op5_pivot_top_k, op6_suffix_dedup, op7_simhash, op8_streaming_viterbi, op9_ppm_language, op10_subword_toxicity, op11_secondary_sort, op12_line_runs, op13_whitening)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return {
        "op1_url_filter": sql.url_filter(RULES, urls.ORDER, urls.HELD_OUT),
        "op2_merkle": sql.merkle(),
        "op4_arc_to_warc": sql.ARCHIVE,
        "op5_pivot_top_k": sql.TOP_K,
        "op6_suffix_dedup": sql.REPEATS,
        "op11_secondary_sort": sql.NEGATIVES,
        "op12_line_runs": sql.LINES,
    }
