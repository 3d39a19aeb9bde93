"""Hard negatives by a secondary sort: one streaming pass over each anchor's pairs in descending order of score.

A pair is one byte string: anchor, descending score, positives before negatives, id; its byte order is the order wanted. `repartitionAndSortWithinPartitions`
deals pairs by anchor and sorts them by the whole key, on disk where they do not fit. The iterator over a partition keeps the windows of the current anchor only:
each of its first positives opens one, and each negative that follows goes to the open windows whose margins it meets.

Pairs are scored in blocks, anchors against rows, and combined before the shuffle: of a block, an anchor sends its best positives
and, once the windows' margins are known, what comes first in each window. So the pairs shuffled grow with anchors and blocks, not with anchors and rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.arrays import matrix, products
from pairlens.session import checkpointed, written

#: Rows and anchors of a block; rows scored at once.
ROWS, ANCHORS, SLICE = 8192, 2048, 1024

_KEY = ">QQBQ"
_SIGN = 1 << 63
_NONE = -(2**63)
_SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def packed(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray | int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is: anchor ascending, score descending, positives first, id ascending."""
    out = np.empty(len(anchor), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    sign = np.uint64(_SIGN)
    out["anchor"], out["id"] = anchor.astype(np.int64).view(np.uint64) ^ sign, ids.astype(np.int64).view(np.uint64) ^ sign
    out["score"], out["kind"] = ~(score.astype(np.int64).view(np.uint64) ^ sign), negative
    return pa.array([out[i : i + 1].tobytes() for i in range(len(out))], pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """Anchor, score, kind (0 positive, 1 negative) and id of a key."""
    anchor, score, kind, i = struct.unpack(_KEY, key)
    return anchor - _SIGN, (score ^ (2 * _SIGN - 1)) - _SIGN, kind, i - _SIGN


def in_windows(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys, keeping the current anchor's windows only."""
    current, windows = None, []
    for key in keys:
        anchor, score, kind, i = unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if kind == 0:
            if len(windows) < positives:
                windows.append([i, score, 0])
            continue
        for window in windows:
            if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], i, window[1], score


def _firsts(score: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Which valid entries are among the k first of their row: higher scores first, then further left."""
    if not score.shape[1]:
        return valid
    ranked = np.where(valid, score, _NONE)
    if score.shape[1] > k:
        border = np.partition(ranked, -k, axis=1)[:, -k][:, None]
        above, level = valid & (ranked > border), valid & (ranked == border)
        return above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]))
    return valid


def _blocks(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and anchors dealt to the cells of a grid of blocks; every pair meets in one cell."""
    n_rows, n_anchors = (-(-df.count() // size) or 1 for df, size in ((rows, ROWS), (anchors, ANCHORS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("a", F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchors)).cast("int")).withColumn("b", every(n_rows))
    # Rows are dealt by their place in the table, so that repeated ids are no hot block.
    right = rows.withColumn("b", F.pmod(F.xxhash64("place"), F.lit(n_rows)).cast("int")).drop("place").withColumn("a", every(n_anchors))
    return left, right, ["a", "b"]


def _scored(left: DataFrame, right: DataFrame, key: list[str], width: int, choose: Callable, emit: Callable, schema: str) -> DataFrame:
    """Pairs that `choose` takes of each block: `emit` turns (anchor rows, ids, scores) into a table."""

    def run(asking: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("vec_id")
        own, label = asking["anchor_id"].to_numpy(), asking["label"].to_numpy()
        vec = matrix(asking["vec"], width)
        limits = choose(asking)
        row, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, block.num_rows if len(own) else 0, SLICE):
            part = block.slice(start, SLICE)
            there = part["vec_id"].to_numpy()
            score = products(vec, matrix(part["vec"], width))
            same = label[:, None] == part["label"].to_numpy()
            at = np.nonzero(limits(score, same, own[:, None] == there))
            row.append(at[0]), ids.append(there[at[1]]), scores.append(score[at])
        return emit(own[np.concatenate(row)], np.concatenate(scores), np.concatenate(ids))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "vec", label_col: str = "label") -> DataFrame:
    """Hard negatives per anchor and positive: `anchor_id`, `positive_id`, `rank` (from 1), `negative_id`, `positive_score`, `negative_score`.

    rows: integer vectors (`vector_col`, array of bigint) with an integer label; anchors: condition on the rows that are anchors. Scores are integer inner
    products with the anchor; higher ones come first, ties by the smaller id. An anchor's positives are its first `positives` other rows of its label (all, if fewer).
    Each gets the first `negatives` rows of another label whose score is between `low` and `high` percent of the positive's, ends included;
    of a positive with a negative score there are none.

    Rows with a null id, label or vector take no part; shorter vectors count as padded with zeros. Repeated ids: every row counts, but for anchors of the same id; as
    an anchor the one with the smallest label and vector. Nothing to mine, or an empty table, gives an empty result. Other columns are ignored.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("bigint").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    kept = kept.where("vec_id is not null and vec is not null and label is not null and not exists(vec, x -> x is null)")
    kept = written(kept.withColumn("place", F.monotonically_increasing_id()), "rows")
    width = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    best = kept.where("asks").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vec")).alias("least")).select("anchor_id", "least.*")
    asked = checkpointed(best)
    others = kept.drop("asks")

    def closest(asking: pa.Table) -> Callable:
        return lambda score, same, own: _firsts(score, same & ~own, positives)

    def as_rows(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.Table:
        return pa.table({"anchor_id": anchor, "score": score, "vec_id": ids})

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    # A block's slices send up to `positives` each; the rank's limit applies before the shuffle.
    near = _scored(*_blocks(others, asked), width, closest, as_rows, "anchor_id bigint, score bigint, vec_id bigint")
    near = checkpointed(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    opened = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score")).alias("margins"))  # `positives` values at most

    def inside(asking: pa.Table) -> Callable:
        margin = matrix(asking["margins"], positives)
        there = np.arange(positives) < np.asarray(asking["margins"].combine_chunks().value_lengths())[:, None]

        def limits(score: np.ndarray, same: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = np.zeros(score.shape, bool)
            for w in range(positives):
                fits = ~same & there[:, w : w + 1] & (low * margin[:, w : w + 1] <= 100 * score) & (100 * score <= high * margin[:, w : w + 1])
                out |= _firsts(score, fits & ~own, negatives)
            return out

        return limits

    def as_keys(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.Table:
        return pa.table({"key": packed(anchor, score, 1, ids)})

    def positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(*(c.to_numpy() for c in batch.columns[:2]), 0, batch.column(2).to_numpy())], names=["key"])

    left, right, key = _blocks(others, checkpointed(asked.join(opened, "anchor_id")))
    keys = _scored(left, right, key, width, inside, as_keys, "key binary").unionByName(near.mapInArrow(positive_keys, "key binary"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(tasks, lambda k: zlib.crc32(k[:8]))
    mined = dealt.mapPartitions(lambda pairs: in_windows((k for k, _ in pairs), positives, negatives, low, high))
    return spark.createDataFrame(mined, _SCHEMA, verifySchema=False)
