"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, copies, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéürstlnm", k=3 + rng.randrange(vocabulary) % 7)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    passage, base = words(1, 60), words(2, 300)
    changed = base.split()
    changed[50], changed[200] = "other", "words"
    rows = [
        (0, f"{words(3, 80)}. {passage} {words(4, 40)}\nA second line, with a mark; and more.\n\nThird"),
        (1, f"{passage} {words(5, 30)}"),
        (2, base),
        (3, base),
        (4, " ".join(changed)),
        (5, None),
        (6, ""),
        (7, "x" * 49),
        (8, "x" * 50),
        (9, "x" * 130),
        (10, "y" * 30 + "x" * 60 + "z"),
        (11, " \t\n "),
        (12, "Ab"),
        (13, "12 34 ... !!"),
        (14, "Ünï code ▁ 😀 ▁▁ \u0000 end  two   three İ ΣΣ <|endoftext|> it's"),
        (15, words(6, 20000)),
        (16, passage.upper()),
        (17, f"{words(7, 12)} {passage} {words(8, 12)}"),
        (2, base + " tail"),
        (3, base),
        (None, base),
        (None, None),
    ]
    return rows


def documents(spark, rows=None, extra: bool = False):
    """The rows as documents; extra: more columns, under names that operators use for their own."""
    rows = texts() if rows is None else rows
    data = [(d, t, None if d is None else ("de", "en", None)[d % 3], f"src{(d or 0) % 2}", None if t is None else len(t)) for d, t in rows]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        names = ("id", "fp", "kept", "spans", "n_bytes", "rest", "tag", "uid", "ids", "decoded", "toxicity", "lang_pred", "lang_bits", "row_key", "component_id", "rank", "score", "url_text", "seq", "offset", "piece", "start", "length")
        df = df.select("*", *(F.lit(7).alias(n) for n in names))
    return df


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
