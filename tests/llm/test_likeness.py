"""The pipeline's near-duplicates: five-word shingles at a Jaccard likeness of 0.8, found and compared whole."""

import corpus_pipeline
import numpy as np
from fixtures import documents, words

from pairlens.llm import simhash


def fork(seed, stem, tail):
    """Two texts with `stem` five-word shingles in common and `tail` of its own in each."""
    first = [f"{w}{i}" for i, w in enumerate(words(seed, stem + 4).split())]
    ends = [[f"{w}{k}x{i}" for i, w in enumerate(words(seed + 7 * k + 1, tail).split())] for k in (1, 2)]
    return [" ".join(first + e) for e in ends]


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5, 42)) for t in (a, b))
    return len(x & y) / len(x | y)


def components(spark, rows):
    options = {"words": corpus_pipeline.WORDS, "distance": corpus_pipeline.DISTANCE, "lanes": corpus_pipeline.LANES, "similarity": corpus_pipeline.SIMILARITY}
    return dict(simhash.near_duplicates(documents(spark, rows), **options).select("doc_id", "component_id").collect())


def test_likeness_of_pairs(spark):
    rows, want = [], []
    for stem, tail, share in ((120, 20, 0.75), (159, 20, 159 / 199), (160, 20, 0.8), (238, 21, 0.85)):
        for k in range(150):
            pair = fork(10_000 * stem + 31 * k, stem, tail)
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
            want.append(share)
        assert jaccard(*pair) == share
    got = components(spark, rows)
    linked = np.array([got[2 * k + 1] == 2 * k for k in range(len(want))])
    want = np.array(want)
    assert not linked[want < 0.8].any()
    assert linked[want == 0.8].mean() >= 0.98
    assert linked[want == 0.85].mean() == 1.0
    assert all(c // 2 == d // 2 for d, c in got.items())


def test_refused_link_does_not_hide_others(spark):
    """Many texts at about 0.78 of a common one, of which pairs are alike: the common one alone must not take them in."""
    rows = []
    for k in range(40):
        common = [f"c{k}w{i}" for i in range(124)]
        rows.append((3 * k, " ".join(common + [f"o{k}w{i}" for i in range(17)])))
        own = [f"p{k}w{i}" for i in range(17)]
        rows += [(3 * k + 1 + j, " ".join(common + own + [f"e{k}{j}w{i}" for i in range(3)])) for j in (0, 1)]
    texts = dict(rows)
    assert jaccard(texts[0], texts[1]) < 0.8 < jaccard(texts[1], texts[2])
    got = components(spark, rows)
    assert all(got[3 * k] == 3 * k and got[3 * k + 1] == got[3 * k + 2] == 3 * k + 1 for k in range(40))


def test_repeated_shingles_count_once(spark):
    """Alike as sets, though one text says a phrase a hundred times over."""
    body = [f"b{i}" for i in range(200)]
    phrase = [f"r{i}" for i in range(6)]
    rows = [(0, " ".join(body + phrase)), (1, " ".join(body + phrase * 100)), (2, None), (3, ""), (4, "one two")]
    texts = dict(rows)
    assert jaccard(texts[0], texts[1]) > 0.95
    assert components(spark, rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
