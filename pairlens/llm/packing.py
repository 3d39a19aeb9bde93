"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces of more than half the capacity open a sequence each. The others follow in descending bands of length. In a
round the band's pieces and the slots of all gaps are range-sorted by size, and a distributed sweep finds for every slot
its closest smaller piece: +1 for a piece and -1 for a slot, summed up over the sorted rows, give every row a level, and a
slot takes the last piece before it on the same level. That is the best-fit matching: conflicts (several pieces whose
closest gap is the same) are settled by the ranks that the levels encode, every slot gets one piece at most, every piece one slot.
A gap of several times the band's longest piece offers as many slots. Gaps shrink and the round repeats: first on the sequences that are there, then
with as many new ones as the tokens left need, then with enough for all that is left.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.tokens import word_encoder
from pairlens.llm.workers import small_batches
from pairlens.session import checkpointed, written

#: Lengths of a band differ by this factor at most, down to the last band, of lengths up to `LAST`.
BAND, LAST = 4, 128
#: A round that places no more than this part of the band's pieces is the last before new sequences open.
WORTH = 0.2
#: Rows of a sweep that one task takes.
SWEEP_ROWS = 100_000
_PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids per row: `id_col`, `piece`, `start`, `length`, `ids_crc32` and, on request, `ids`.

    A document's ids are the tokenizer's and then `end_id`; a null or empty text has the end id alone. Only documents
    longer than the capacity are cut, and only at its multiples. Repeated rows give repeated pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and walking them costs a quarter of the time
        try:
            yield from pieces(batches)
        finally:  # the worker goes on to other tasks
            gc.enable()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                chunk = batch.slice(part, 512)
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, text in enumerate(chunk.column(1)):
                    packed = encoder.encode(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        own = packed[at : at + 4 * capacity]
                        of.append(row), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4"))
                columns = [chunk.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _PIECES.format(id=kind, ids=", ids array<int>" if with_ids else "").replace("doc_id", f"`{id_col}`", 1)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _match(pieces: DataFrame, slots: DataFrame, n: int) -> DataFrame:
    """Pieces (`uid`, `length`) with the `seq` and `slot` that each gets, null where it gets none.

    slots: `seq`, `slot`, `size`. n: about how many rows there are.
    """
    rows = pieces.select("uid", "length", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("slot"), F.col("length").alias("size"), F.lit(1).alias("step"))
    gaps = slots.select(F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("bigint").alias("length"), "seq", "slot", "size", F.lit(-1).alias("step"))
    tasks = -(-n // SWEEP_ROWS)
    tie = F.xxhash64("uid", "seq", "slot")
    # Pieces come before slots of the same size; the tie spreads one frequent size over many tasks.
    ordered = rows.unionByName(gaps).withColumns({"kind": -F.col("step"), "tie": tie}).repartitionByRange(tasks, "size", "kind", "tie").sortWithinPartitions("size", "kind", "tie")
    ordered = checkpointed(ordered.drop("kind", "tie"))
    totals = {r[0]: r[1] for r in ordered.groupBy(F.spark_partition_id()).agg(F.sum("step")).collect()}  # a row per task
    before, running = {}, 0
    for k in sorted(totals):
        before[k], running = running, running + totals[k]

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            step = batch.column(5).to_numpy()
            after = height + np.cumsum(step)
            height = int(after[-1]) if len(after) else height
            yield batch.append_column("level", pa.array(np.where(step > 0, after, after + 1), pa.int64()))

    levels = ordered.mapInArrow(level, "uid bigint, length bigint, seq bigint, slot bigint, size bigint, step int, level bigint")
    # On one level pieces and slots alternate, at most once per size.
    following = Window.partitionBy("level").orderBy("size", F.desc("step"))
    met = levels.withColumns({"next_seq": F.lead("seq").over(following), "next_slot": F.lead("slot").over(following)})
    return met.where("step > 0").select("uid", "length", F.col("next_seq").alias("seq"), F.col("next_slot").alias("slot"))


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """`uid`, `sequence_id`, `offset` per piece (`uid` unique, `length` from 1 to the capacity).

    A sequence is named by the piece that opened it and filled without holes from offset 0. Every piece is placed; none
    exceeds the capacity. No piece gives no row.
    """
    pieces = pieces.select("uid", "length")
    half = capacity // 2
    opened = pieces.where(F.col("length") > half)
    placed = [opened.select("uid", "length", F.col("uid").alias("seq"), F.lit(0).cast("bigint").alias("turn"))]
    gaps = opened.select(F.col("uid").alias("seq"), (capacity - F.col("length")).alias("gap")).where("gap > 0")
    turn, longest = 0, half
    while longest:
        least = longest // BAND if longest > LAST else 0
        left, phase, before = pieces.where((F.col("length") > least) & (F.col("length") <= longest)), 0, None
        while True:
            turn += 1
            pick = F.xxhash64("uid", F.lit(turn))
            n, tokens = left.agg(F.count("*"), F.sum("length")).first()
            if not n:
                break
            if before is not None and before - n <= WORTH * before:
                phase += 1
                # First as many pieces open as the tokens left fill, then one of every `whole`: it leaves room for the others, as
                # none is longer than `longest`. Which ones, a hash says (a few more where the quantile is not exact).
                whole = capacity // longest
                wanted = -(-tokens // capacity) if phase == 1 else -(-n // whole)
                last = left.agg(F.percentile_approx(pick, min(1.0, wanted / n), 100_000)).first()[0]
                chosen = pick <= last
                new = left.where(chosen)
                placed.append(new.select("uid", "length", F.col("uid").alias("seq"), F.lit(turn * capacity).cast("bigint").alias("turn")))
                gaps = gaps.unionByName(new.select(F.col("uid").alias("seq"), (capacity - F.col("length")).alias("gap")))
                left, turn = left.where(~chosen), turn + 1
            before = n
            parts = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("gap") / longest))
            slots = gaps.where(F.col("gap") > least).select("seq", "gap", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("slot"))
            slots = slots.select("seq", "slot", F.when(F.col("slot") < F.col("parts") - 1, F.lit(longest)).otherwise(F.col("gap") - (F.col("parts") - 1) * longest).cast("bigint").alias("size"))
            met = checkpointed(_match(left, slots, n + slots.count()))
            found = met.where("seq is not null")
            placed.append(found.select("uid", "length", "seq", (F.lit(turn * capacity) + F.col("slot")).alias("turn")))
            fills = found.groupBy("seq").agg(F.sum("length").alias("filled"))
            gaps = checkpointed(gaps.join(fills, "seq", "left").select("seq", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")).where("gap > 0"))
            left = met.where("seq is null").select("uid", "length")
        longest = least
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    # A sequence holds `capacity` pieces at most.
    order = Window.partitionBy("seq").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("uid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of `token_pieces` with `sequence_id` and `offset`: sequences of at most `capacity` ids, as few as best fit gives.

    A null or empty text is one piece of the end id. Null or repeated ids are kept as rows of their own; an empty table gives an
    empty result. Pieces are written once, so that no text is tokenized twice.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(best_fit(pieces, capacity), "uid").drop("uid")
