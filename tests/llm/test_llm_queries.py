"""The registered queries against their SQL or on whole small tables, and the pipeline's stages one by one."""

import check_queries
import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from fixtures import documents, rows_of, texts, words
from pyspark.sql import functions as F

import __spark_entry__
from pairlens.llm.queries import QUERIES, oracle_sql
from pairlens.session import scratch_path
from test_copies import slow_removal

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert check_queries.compare(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_entry_lists_every_operator():
    listed = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(listed)
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_other_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name in ("op7_simhash", "op8_streaming_viterbi", "op9_ppm_language", "op10_subword_toxicity"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n
    coded = QUERIES["op8_streaming_viterbi"](spark, SF)
    assert coded.where("not same_text").count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    """documents and labels in a folder of their own."""
    folder = scratch_path(spark, "tables")
    rng = np.random.default_rng(1)
    base = [(1000 + k, f"{words(700 + k, 60)} " + ("vile scoundrel " * 2 if k % 3 == 0 else "") + words(800 + k, 40)) for k in range(150)]
    near = words(2, 300).split()
    near[150] = "other"
    rows = texts() + base + [(3000, " ".join(near)), (3001, words(1, 60) + " " + words(900, 30))]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int(d % 3 == 1)) for d, _ in base]  # 1000 % 3 == 1: the documents with the insult
    assert rng is not None
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_toxic_documents_go(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert out.schema == docs.schema
    kept = {r[0] for r in out.select("doc_id").collect()}
    toxic = {d for d, t in rows if t and "scoundrel" in t}
    clean = {d for d, t in rows if d is not None and 1000 <= d < 2000} - toxic
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept & clean) >= 0.9 * len(clean)


def test_documents_without_language_go(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_unidentified(spark, docs, folder)
    assert out.schema == docs.schema
    gone = {(d, t) for d, t in rows} - {tuple(r) for r in out.select("doc_id", "text").collect()}
    assert {d for d, _ in gone} >= {5, 6, 11, 13}
    assert not any(d and d >= 1000 for d, _ in gone)


def test_one_of_each_near_duplicate_group_stays(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert out.schema == docs.schema
    kept = [r[0] for r in out.select("doc_id").collect()]
    assert kept.count(2) == 1 and 3 not in kept and 3000 not in kept
    assert all(kept.count(d) == 1 for d, t in rows if d is not None and 1000 <= d < 2000)


def test_repeated_passages_are_cut(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.cut_repeats(spark, docs, folder)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> char_length(text)").count() == 0
    lengths = sorted(((d, n - sum(e - s for s, e in spans)) for d, n, _, spans in slow_removal(rows, 50)), key=repr)
    got = rows_of(out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n")), "doc_id", "n")
    # A character that is cut in part stays whole, so a text may keep up to three bytes more at each end of a cut.
    assert [d for d, _ in got] == [d for d, _ in lengths]
    assert all(0 <= a - b <= 60 for (_, a), (_, b) in zip(got, lengths))
    assert dict(got)[3001] < len(words(900, 30).encode()) + 60


def test_run_is_its_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows_of(corpus_pipeline.run(spark, folder), *columns) == rows_of(docs, *columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "suffix_dedup", "packing"]


def test_stages_take_empty_tables_and_more_columns(spark, tables):
    folder, _ = tables
    for docs in (documents(spark, []), documents(spark, texts()[:6], extra=True)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert set(stage(spark, docs, folder).columns) == set(docs.columns)
