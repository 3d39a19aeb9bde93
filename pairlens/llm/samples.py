"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_remainder(id_col: str, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo `divisor`; a null id has the remainder 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def _ranked(labels: DataFrame, there: DataFrame, id_col: str, per_label: int) -> tuple[list, DataFrame]:
    """(id, label, text_hash, text_bytes, place) of the first `per_label` documents of each label, in the order of a hash of the id.

    A threshold of the hash, from the labels' counts, first leaves a few times as many ids as are wanted, whatever the table's size and its splits;
    where these are too few, as most have no document, it is raised.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col, "text_hash")
    names = [id_col, "label", "text_hash", "text_bytes"]
    known = labels.where("label is not null").select(id_col, "label")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # a row per label
    factor = 4
    while True:
        share = {label: factor * per_label / n for label, n in counts.items()}
        kept = [F.when(F.col("label") == F.lit(label), F.xxhash64(id_col) <= int(-(2**63) + 2**64 * part)) for label, part in share.items() if part < 1]
        cut = known.where(F.coalesce(*kept, F.lit(True))) if kept else known
        ranked = cut.distinct().join(there, id_col).withColumn("place", F.row_number().over(order))
        top = ranked.where(F.col("place") <= per_label).select(*names, "place").collect()  # per_label times the labels
        found = Counter(r["label"] for r in top)
        if all(share[label] >= 1 or found[label] >= per_label for label in counts):
            return top, ranked.select(names)
        factor *= 16


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, per_label: int, max_bytes: int = 1 << 24) -> DataFrame:
    """`label`, `text_part` (binary), `at` (order) of at most `per_label` documents and `max_bytes` bytes of each label, in the order of a hash of the id.

    labels: `id_col` and `label`. Rows without id, label or text are left out. Ids and lengths alone are joined and ranked, so neither texts nor a label that holds most
    rows are gathered; only the chosen ids' texts are fetched.
    A text that would exceed the bytes is skipped; a label whose texts are all longer has the beginning of the first.
    """
    keys = [F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("bigint").alias("text_bytes")]
    top, ranked = _ranked(labels, docs.where(F.col(text).isNotNull()).select(id_col, *keys), id_col, per_label)
    chosen, used, first = {}, {}, {}
    for row in sorted(top, key=lambda r: r["place"]):
        first.setdefault(row["label"], row)
        if used.get(row["label"], 0) + row["text_bytes"] <= max_bytes:
            used[row["label"]] = used.get(row["label"], 0) + row["text_bytes"]
            chosen[tuple(row)[:4]] = None
    chosen |= {tuple(row)[:4]: None for label, row in first.items() if label not in used}
    few = docs.sparkSession.createDataFrame(list(chosen), ranked.schema)
    found = docs.where(F.col(text).isNotNull()).select(id_col, F.substring(F.col(text).cast("binary"), 1, max_bytes).alias("text_part"), *keys)
    rows = found.join(F.broadcast(few), [id_col, "text_hash", "text_bytes"]).dropDuplicates([id_col, "label", "text_hash", "text_bytes"])
    return rows.select("label", "text_part", F.struct("label", F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), "text_part").alias("at"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, per_label: int, max_bytes: int = 1 << 24) -> list:
    """(label, text) of `sample_rows`, in their order."""
    rows = sample_rows(docs, labels, id_col, text, per_label, max_bytes)
    return [(r[0], r[1].decode("utf-8", "ignore")) for r in rows.orderBy("at").select("label", "text_part").collect()]
