"""From documents to packed sequences: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept and, but for the last, returns the columns of documents. What it
returns is written as Parquet and read again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import language, packing, simhash, suffixes, toxicity
from pairlens.session import written

#: Documents this likely to be toxic go.
TOXIC = 0.5
#: Uniform coding takes 8 bits a byte; what no language codes shorter is in none of them.
MAX_BITS = 8.0
#: Near-duplicates: five-word shingles with a Jaccard likeness of 0.8 or more. Of 512 fingerprint bits about 78 differ at 0.8, with a deviation of 8.
WORDS, SIMILARITY, LANES, DISTANCE = 5, 0.8, 8, 105


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with its own columns of these names put aside, and what puts them back in the table's order."""
    moved = {n: f"{n}_{'x' * max(map(len, docs.columns))}" for n in names if n in docs.columns}
    back = {v: k for k, v in moved.items()}
    return docs.withColumnsRenamed(moved), lambda out: out.drop(*moved).withColumnsRenamed(back).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic passage is at most likely clean go; trained on the labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, restored = _aside(docs, "toxicity")
    return restored(toxicity.score(rows, model).where(F.col("toxicity") < TOXIC))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that every language's model codes no shorter than no model would, go."""
    rows, restored = _aside(docs, "lang_pred", "lang_score", "lang_bits")
    out = language.identify(rows, language.fit(docs))
    return restored(out.where((F.col("lang_pred") != "und") & (F.col("lang_bits") < MAX_BITS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest id (of equal ids, the smaller hash of the text)."""
    rows, restored = _aside(docs, "row_key")
    keyed = rows.withColumn("row_key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")))
    members = simhash.near_duplicates(keyed, id_col="row_key", words=WORDS, distance=DISTANCE, lanes=LANES, similarity=SIMILARITY)
    kept = members.where("row_key = component_id").select("row_key").distinct()
    return restored(keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has too are cut; the documents stay, with what is left."""
    rows, restored = _aside(docs, "kept", "n_bytes", "spans")
    out = suffixes.remove_repeats(rows, 50, whole_characters=True)
    out = out.withColumn("text", F.col("kept").cast("string"))
    return restored(out.withColumn("n_chars", F.char_length("text").cast("bigint")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Trained models, tokenizers and XXH64 are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
