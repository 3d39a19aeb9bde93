"""What Python workers hold and keep."""

from __future__ import annotations

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from pairlens.llm import packing, simhash, suffixes, toxicity, workers
from pairlens.llm.tokens import word_encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing_leaves_the_collector_of_cycles_on(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string").coalesce(1)

    def state(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * batch.num_rows)], names=["on"])

    assert packing.token_pieces(docs, TOKENIZER, 4096).count() == 2
    assert [r.on for r in spark.range(0, 8, 1, 8).mapInArrow(state, "on boolean").collect()] == [True] * 8


def test_other_steps_let_go_of_the_tokenizer():
    encoder = word_encoder(TOKENIZER)
    assert word_encoder(TOKENIZER) is encoder
    assert list(workers.returned(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert word_encoder(TOKENIZER) is not encoder
    workers.let_go()


def test_batches_end_at_bytes(spark):
    docs = spark.range(0, 12_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    for step in (
        lambda: simhash.fingerprints(docs),
        lambda: toxicity.score(docs, toxicity.train([], [])),
        lambda: suffixes.remove_repeats(docs.limit(0)),
        lambda: packing.token_pieces(docs, TOKENIZER, 4096),
    ):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        step()
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint").collect()
        assert max(r.n for r in sizes) < 2 * workers.BATCH_BYTES


def test_sorting_a_bucket_holds_little_beside_its_rows():
    rows = np.random.default_rng(1).integers(0, 2, (200_000, 50)).astype(np.uint8)
    rows[::3] = rows[0]
    rows[1::3, :20] = rows[1, :20]
    tracemalloc.start()
    order, common = suffixes._multikey_sort(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * rows.nbytes
    expected = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), i))
    assert order.tolist() == expected
    differ = rows[order[1:]] != rows[order[:-1]]
    assert common[1:].tolist() == np.where(differ.any(axis=1), differ.argmax(axis=1), 50).tolist() and common[0] == 0


def test_anchors_are_sought_a_few_windows_at_once(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 1 << 20).astype(np.uint8)
    ends = np.arange(1 << 11, len(data) + 1, 1 << 11)
    anchors = suffixes.Anchors(50, 24)
    tracemalloc.start()
    found = anchors.of(data, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data)
    monkeypatch.setattr(suffixes, "WINDOWS", 1000)

    def windows(position, hashes, near, far):
        """(window start, its anchor, hash) of all windows."""
        return {(p - o, p, h) for p, h, a, b in zip(*(x.tolist() for x in (position, hashes, near, far))) for o in range(a, b + 1)}

    assert windows(*found) == windows(*anchors.of(data, ends))
