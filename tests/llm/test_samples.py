"""Samples bounded in rows and bytes."""

from fixtures import documents, words

from pairlens.llm import language
from pairlens.llm.samples import labelled_sample


def test_bytes_are_bounded_before_texts_are_fetched(spark):
    docs = documents(spark, [(k, f"{k:04d}" * 250) for k in range(60)] + [(100, "ä" * 9000)])
    labels = docs.selectExpr("doc_id", "case when doc_id = 100 then 'long' else 'short' end as label")
    rows = labelled_sample(docs, labels, "doc_id", "text", 50, 8001)
    assert [len(t) for label, t in rows if label == "short"] == [1000] * 8
    assert [t for label, t in rows if label == "long"] == ["ä" * 4000]


def test_language_of_long_texts_only_gets_a_tree(spark):
    docs = documents(spark, [(3 * k, words(k, 50)) for k in range(5)] + [(3 * k + 1, "0123456789 xyz " * 400) for k in range(3)])
    trees = language.fit(docs, max_bytes=5000)
    assert sorted(trees.languages) == ["de", "en"]
    got = dict(language.identify(docs, trees).select("doc_id", "lang_pred").collect())
    assert got[1] == got[4] == "en" and got[0] == "de"
