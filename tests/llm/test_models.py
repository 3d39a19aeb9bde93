"""Classifiers: held-out accuracy, exact code lengths, awkward rows."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from fixtures import documents
from pyspark.sql import functions as F

from pairlens.llm import language, toxicity
from pairlens.llm.samples import id_remainder, labelled_sample


def slow_bits(training, text):
    """Code length of one text: every byte by its own walk from the longest context down."""
    counts = {}
    for t in training:
        for i in range(len(t)):
            for k in range(min(i, language.ORDER) + 1):
                counts.setdefault(t[i - k : i], Counter())[t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, language.ORDER), -1, -1):
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            n, t = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (n + t))
                break
            bits -= math.log2(t / (n + t))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("step", [1 << 19, 7])
def test_code_lengths_match_the_walk(monkeypatch, step):
    monkeypatch.setattr(language, "STEP", step)
    texts = {"a": [b"the cat sat on the mat", b"that hat", b"x"], "b": [b"le chat est la", b"\xff\x00ab"]}
    trees = language.Trees(texts)
    cases = [b"the chat", b"", b"q", b"\x01\x02\x03\x04\x05", b"that cat sat on a hat and le chat est", b"ab\xff\x00ab"]
    want = [[slow_bits(texts[k], t) for k in ("a", "b")] for t in cases]
    assert np.allclose(trees.code_lengths(cases), want, atol=1e-3)


def test_coding_long_texts_takes_little_memory():
    trees = language.Trees({"a": [b"the cat sat on the mat"], "b": [b"le chat est la"]})
    text = b"the chat sat on a mat " * 100_000
    tracemalloc.start()
    trees.code_lengths([text, text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language.fit(docs.where(id_remainder("doc_id", 3) != 1))
    out = language.identify(docs, trees).where((id_remainder("doc_id", 3) == 1) & F.col("lang").isNotNull())
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


@pytest.mark.parametrize("extra", [False, True])
def test_language_of_awkward_rows(spark, extra):
    docs = documents(spark, extra=extra)
    out = language.identify(docs, language.fit(docs))
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == docs.count()
    for key in ((5, None), (6, ""), (11, " \t\n "), (13, "12 34 ... !!")):
        assert got[key]["lang_pred"] == "und" and got[key]["lang_score"] == 0
    assert {r["lang_pred"] for r in got.values()} <= {"und", "de", "en"}
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    none = language.identify(docs, language.fit(docs.where("lang = 'xx'")))
    assert {r[0] for r in none.select("lang_pred").distinct().collect()} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).when(F.col("id") % 7 > 0, 0).alias("label"), F.concat(F.lit("t"), "id").alias("text"))
    first = labelled_sample(rows, rows, "doc_id", "text", 40)
    assert Counter(r[0] for r in first) == {0: 40, 1: 30}
    assert first == labelled_sample(rows.repartition(5), rows, "doc_id", "text", 40)


def _speech(rng, toxic, misspelt=False):
    syllables = ["ra", "lo", "mi", "ten", "sa", "vor", "ke", "un"]
    words = ["".join(rng.choice(syllables, 3)) for _ in range(int(rng.integers(40, 300)))]
    if toxic:
        for at in rng.choice(len(words), max(1, len(words) // 60), replace=False):
            words[at] = rng.choice(["scoundrel", "blockhead"]) + ("x" if misspelt else "")
    return " ".join(words)


def test_toxicity_generalises_to_unseen_spellings():
    rng = np.random.default_rng(5)
    labels = [int(x) for x in rng.random(1200) < 0.2]
    model = toxicity.train([_speech(rng, y) for y in labels], labels)
    for misspelt in (False, True):
        truth = [int(x) for x in rng.random(300) < 0.3]
        guess = [int(model.score(_speech(rng, y, misspelt)) >= 0.5) for y in truth]
        assert np.mean(np.array(truth) == guess) > 0.95


def test_long_words_are_scored_but_not_remembered(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WORDS", 50)
    model = toxicity.Model(np.linspace(-1, 1, toxicity.BUCKETS, dtype=np.float32), 0.1)
    own = [f"w{k}" for k in range(200)] + ["longword" * 5]
    want = [sum(map(model.values.__getitem__, g := toxicity.subwords(w))) / len(g) for w in own]
    assert [model.word(w) for w in own] == want
    assert len(model.words) <= 50 and max(map(len, model.words)) <= 24


def test_one_class_gives_a_constant():
    model = toxicity.train(["a b", "c"], [0, 0])
    assert model.score("a b") == model.score("") == model.score(None) < 0.5


@pytest.mark.parametrize("extra", [False, True])
def test_toxicity_of_awkward_rows(spark, extra):
    docs = documents(spark, extra=extra)
    labelled = docs.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    out = toxicity.score(docs, toxicity.fit(docs, labelled, label_col="label", per_label=5))
    assert out.count() == docs.count()
    assert out.where("toxicity between 0 and 1").count() == docs.count()
    empty = toxicity.score(documents(spark, []), toxicity.fit(docs, labelled.where("false"), label_col="label"))
    assert empty.count() == 0
