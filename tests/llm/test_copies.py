"""SimHash classes, substring removal and components against brute force."""

import hashlib
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import documents, rows_of, texts, words
from pyspark.sql import functions as F

from pairlens.llm import simhash, suffixes
from pairlens.llm.graph import connected_components


def slow_fingerprint(text, n=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)] if len(parts) >= n else [b" ".join(parts)] * bool(parts)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=3):
    """Smallest id by fingerprint."""
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for _, f in fps}


@pytest.mark.parametrize("extra", [False, True])
def test_simhash_matches_brute_force(spark, extra):
    rows = texts() + [(100 + i, f"{words(50, 40)} {i % 5}") for i in range(30)]
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    component = slow_components(fps)
    got = simhash.near_duplicates(documents(spark, rows, extra))
    want = sorted(((d, f, component[f]) for d, f in fps), key=repr)
    assert sorted(((d, f[0] % 2**64, c) for d, f, c in rows_of(got, "doc_id", "fp", "component_id")), key=repr) == want


def test_every_close_pair_meets():
    tuples = simhash.position_tuples(8, 5)
    assert all(any(set(t) <= set(m) for t in tuples) for m in combinations(range(8), 5))


def test_hot_posting_is_split_and_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(0)
    values = sorted({int(x) << 40 for x in rng.integers(0, 2**16, 200)})
    df = spark.createDataFrame([([v],) for v in values], "fp array<bigint>")
    links = [(a[0], b[0]) for a, b in simhash.near_links(df).collect()]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = slow_components([(v, v) for v in values])
    assert {v: roots.get(v, v) for v in values} == want


def test_wide_fingerprints_find_near_copies(spark):
    rows, pairs = [], []
    for k in range(120):
        text = words(1000 + k, 200).split()
        other = list(text)
        for at in (20, 120):  # 10 of 196 five-word shingles
            other[at] = f"new{k}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    got = dict(simhash.near_duplicates(documents(spark, rows), words=5, distance=80, lanes=8).select("doc_id", "component_id").collect())
    pairs = [got[2 * k + 1] == 2 * k for k in range(120)]
    assert np.mean(pairs) >= 0.9
    assert all(got[d] // 2 == d // 2 for d in got)


def slow_removal(rows, length):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        if d is not None:
            for s in range(len(data) - length + 1):
                w = data[s : s + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if d is not None and first[data[s : s + length]] < d:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        edge = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
        out.append((d, len(data), hashlib.sha256(kept).hexdigest(), tuple(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,token,extra", [(50, 24, False), (50, 24, True), (12, 5, False), (3, 1, False)])
def test_removal_matches_brute_force(spark, length, token, extra):
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in texts()]
    rows += [(200 - i, f"{words(90 + i % 3, 30)}\nsame line in very many texts, every time\n{words(300 + i, 5)}") for i in range(40)]
    out = suffixes.remove_repeats(documents(spark, rows, extra), length, token).withColumn("sha", F.sha2("kept", 256))
    got = sorted(((r["doc_id"], r["n_bytes"], r["sha"], tuple((s["start"], s["end"]) for s in r["spans"])) for r in out.collect()), key=repr)
    assert got == slow_removal(rows, length)
    if extra:
        assert {"uid", "lang", "source", "n_chars", "tag", "rest"} <= set(out.columns)
        assert out.agg(F.sum("uid")).first()[0] == 7 * len(rows)


def test_removal_over_step_borders(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 64)
    anchors = suffixes.Anchors(20, 8)
    data = np.frombuffer(words(5, 200).encode(), np.uint8)
    position, _, near, far = anchors.of(data, np.array([len(data)]))
    served = {int(p - o) for p, n, f in zip(position, near, far) for o in range(n, f + 1)}
    assert served == set(range(len(data) - 19))


def test_surroundings_take_little_more_than_their_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(1, 256, 1 << 20, dtype=np.uint8)
    position = np.sort(rng.integers(0, len(data), 100_000))
    back, fore = rng.integers(0, 27, len(position)), rng.integers(24, 51, len(position))
    tracemalloc.start()
    out = suffixes._surroundings(data, position, back, fore, 26, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for k in (0, 1, 8191, 8192, 50_000, 99_999):
        want = [data[min(max(position[k] + j, 0), len(data) - 1)] if -back[k] <= j < fore[k] else 0 for j in range(-26, 50)]
        assert out[k].tolist() == want
    assert most < 4 * out.nbytes


def test_whole_characters_stay_text(spark):
    rows = [(1, "é" * 60), (2, "a" + "é" * 60 + "b")]
    kept = dict(suffixes.remove_repeats(documents(spark, rows), 51, 24, whole_characters=True).select("doc_id", F.col("kept").cast("string")).collect())
    assert kept[1] == "é" * 60
    assert kept[2].startswith("a") and kept[2].endswith("b") and "�" not in kept[2]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_removal_keeps_columns_of_every_type(spark):
    passage = words(31, 30)
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(passage), F.col("id").cast("string")).alias("text"),
        F.expr("timestamp_micros(1700000000123456 + id)").alias("seen"), F.expr("map(int(id), 'a', 7 + int(id), null)").alias("by_number"),
        F.expr("array(named_struct('x', id / 3.0d, 'y', date '2020-02-29'))").alias("items"), F.expr("cast(id as decimal(30, 9)) / 7").alias("exact"),
        F.expr("unhex('00FF')").alias("raw"), F.expr("if(id % 2 = 0, double('nan'), null)").alias("odd"), F.expr("timestamp_ntz '2024-01-01 00:00:00.000001'").alias("wall"),
    )
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffixes.remove_repeats(docs)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema if f.name in others] == [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in others]
    got, want = ({r["doc_id"]: repr(r[1:]) for r in df.select("doc_id", *others).collect()} for df in (out, docs))
    assert got == want
    assert out.where("size(spans) > 0").count() == 39


def test_postings_that_span_batches_come_out_as_in_one_batch():
    rng = np.random.default_rng(4)
    part = np.sort(np.concatenate([rng.integers(0, 30, 60), np.full(500, 7)])).astype(np.int64)
    fid = rng.integers(0, 1 << 40, len(part))
    head = rng.integers(0, 3, (len(part), 2))

    def outcome(step, columns, names, sizes):
        batches, at = [], 0
        for n in sizes:
            batches.append(pa.RecordBatch.from_arrays([pa.array(c[at : at + n]) for c in columns], names=names))
            at += n
        return sorted(tuple(r.values()) for b in step(iter(batches)) for r in b.to_pylist())

    for step, columns, names in (
        (simhash._shared_postings, (part, fid), ["part", "fid"]),
        (simhash._near_postings(1), (part.astype(np.int32), head[:, 0], head[:, 1]), ["part", "h0", "h1"]),
    ):
        whole = outcome(step, columns, names, [len(part)])
        assert whole
        for n in (1, 7, 100):
            assert outcome(step, columns, names, [n, 0] * (len(part) // n + 1)) == whole
        assert outcome(step, columns, names, [0]) == []


def test_links_of_a_batch_hold_both_fingerprints():
    values = np.arange(12, dtype=np.int64).reshape(4, 3)
    got = simhash._link_batch(values, [np.array([[0, 1]]), np.array([[2, 3], [0, 3]])]).to_pylist()
    assert got == [{"a": [0, 1, 2], "b": [3, 4, 5]}, {"a": [6, 7, 8], "b": [9, 10, 11]}, {"a": [0, 1, 2], "b": [9, 10, 11]}]
    assert simhash._link_batch(values, [simhash._NO_LINKS]).num_rows == 0
