"""Hard negatives against a plain version."""

import random

import numpy as np
import pytest
from fixtures import rows_of
from pyspark.sql import functions as F

from pairlens.llm import negatives
from pairlens.llm.negatives import in_windows, mine, packed, unpacked

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def slow(rows, every=10, positives=5, count=10, low=30, high=90):
    rows = [r for r in rows if None not in r and None not in r[1]]
    width = max((len(v) for _, v, _ in rows), default=0)
    pad = lambda v: list(v) + [0] * (width - len(v))
    anchors = {}
    for i, v, label in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(pad(v), pad(w))), i, m) for i, w, m in rows if i != a)
        near = [(-s, i) for s, i, m in scored if m == label][:positives]
        for p, i in near:
            fits = [(j, -s) for s, j, m in scored if m != label and low * p <= -100 * s <= high * p][:count]
            out += [(a, i, rank, j, p, n) for rank, (j, n) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vec array<bigint>, label int").repartition(3)


def random_rows(n, seed, spread=6, labels=3):
    rng = random.Random(seed)
    return [(k, [rng.randrange(-spread, spread + 1) for _ in range(5)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed, monkeypatch):
    for name, size in (("ROWS", 50), ("ANCHORS", 4), ("SLICE", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = random_rows(180, seed)
    # Ties in plenty, repeated rows and ids, a hot label, scores of 0, ragged and empty vectors, nulls.
    rows += [(200 + k, [1, 1, 0, 0, 0], 0) for k in range(60)] + [rows[10], rows[20], rows[20], (30, [9, 9, 9, 9, 9], 1), (30, [9, 9, 9, 9, 9], 2)]
    rows += [(400, [0] * 5, 0), (410, [2, 2], 1), (411, [], 1), (412, None, 1), (413, [1, None], 1), (420, [1] * 5, None), (None, [1] * 5, 1)]
    got = mine(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert rows_of(got, *COLUMNS) == slow(rows)
    assert len(slow(rows)) > 200


def test_few_rows(spark):
    one = table(spark, [(0, [1, 2], 1)])
    assert mine(one, F.col("vec_id") % 10 == 0).count() == 0
    assert mine(one.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(table(spark, [(1, [1, 2], 1), (2, [1, 2], 1)]), F.col("vec_id") % 10 == 0).count() == 0
    alone = [(0, [10], 1), (1, [10], 1), (2, [9], 2), (3, [3], 2), (4, [2], 2), (5, [10], 2)]
    assert rows_of(mine(table(spark, alone).withColumn("place", F.lit(1)).withColumn("key", F.lit("x")), F.col("vec_id") % 10 == 0), *COLUMNS) == [(0, 1, 1, 2, 100, 90), (0, 1, 2, 3, 100, 30)]


def test_byte_order_of_keys_is_the_order_wanted():
    rng = random.Random(3)
    pairs = [(rng.randrange(-3, 3), rng.choice([0, 1, -1, 2**62, -(2**62), 7]), rng.randrange(2), rng.choice([0, 5, -5, 2**63 - 1, -(2**63)])) for _ in range(500)]
    arrays = [np.array(c, dtype=np.int64) for c in zip(*pairs)]
    keys = packed(*arrays).to_pylist()
    assert [unpacked(k) for k in keys] == pairs
    assert [unpacked(k) for k in sorted(keys)] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_the_iterator_reads_no_further_than_it_must():
    """Negatives come out while the anchor's later pairs are still unread."""
    arrays = [np.array(c, dtype=np.int64) for c in zip((1, 100, 0, 7), *[(1, 90 - k, 1, 10 + k) for k in range(50)])]
    keys = packed(*arrays).to_pylist()
    left = iter(keys)
    found = in_windows(left, 5, 10, 30, 90)
    assert next(found) == (1, 7, 1, 10, 100, 90)
    assert sum(1 for _ in left) == 49
