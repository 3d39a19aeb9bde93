"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations.

Leaves are clauses: runs of at most 32 characters up to a punctuation mark or the line's end, hashed by MD5. Paragraphs are lines, and their
digests hash their clauses' digests. A section ends with a paragraph whose digest begins with 0, 1, 2 or 3, so that an edit moves no border
elsewhere. Section digests hash their paragraphs' digests, and the root hashes the sections'. Equal roots mean equal texts; where roots differ,
the sections, paragraphs and clauses that differ locate the edit, and the share of equal leaves is the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLAUSE = r"[^.,;:!?|]{0,32}+[.,;:!?|]|[^.,;:!?|]{1,32}+"
_SECTION_END = r"(?<=(?:^| )[0-3][0-9a-f]{63}) "


def leaves(text: Column) -> Column:
    """The lines' clauses as one string: the MD5 of each clause, and a space between two lines."""
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_CLAUSE), F.lit(0)), lambda c: F.md5(c)), ""))
    return F.array_join(hashed, " ")


def paragraphs_of(leaf_digests: Column) -> Column:
    """SHA-256 over each line's clauses, in order, from `leaves`."""
    return F.transform(F.split(leaf_digests, " ", -1), lambda p: F.sha2(p, 256))


def paragraphs(text: Column) -> Column:
    """SHA-256 over the clauses of each line, in order."""
    return paragraphs_of(leaves(text))


def sections(paragraph_digests: Column) -> Column:
    """The paragraphs' digests by section, each section as one string with spaces."""
    return F.split(F.array_join(paragraph_digests, " "), _SECTION_END, -1)


def root(section_strings: Column) -> Column:
    """SHA-256 over the sections' SHA-256."""
    return F.sha2(F.array_join(F.transform(section_strings, lambda s: F.sha2(s, 256)), " "), 256)


def clauses(leaf_digests: Column) -> Column:
    """Different clauses of a text, as the first 8 hex digits of their MD5, in order, from `leaves`."""
    return F.array_distinct(F.regexp_extract_all(leaf_digests, F.lit("([0-9a-f]{8})[0-9a-f]{24}"), F.lit(1)))


def fingerprint(root_digest: Column, clause_digests: Column) -> Column:
    """The root, a colon and the clauses' digests: what equality and likeness need."""
    return F.concat(root_digest, F.lit(":"), F.array_join(clause_digests, ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two trees' leaves, 0 to 1; two texts without clauses are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _among(value: Column, ordered: Column, steps: Column) -> Column:
    """Whether `value` is in an ascending array, by bisection; `steps` are the falling powers of two up to its size."""
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(ordered, n + s - 1) < value, n + s).otherwise(n))
    return F.coalesce(F.get(ordered, below) == value, F.lit(False))


def edited_paragraphs(own: Column, other: Column) -> Column:
    """Positions (from 0) of the paragraphs of `own` that are not in `other` (arrays of paragraph digests).

    Descends from the sections: those that both texts have are skipped whole. Every paragraph is then looked up by bisection, so the work grows
    with n log n of a text's paragraphs.
    """
    changed = F.split(F.array_join(F.array_except(sections(own), sections(other)), " "), " ")
    missing = F.array_sort(F.array_except(changed, other))

    def positions(x: Column) -> Column:
        steps = F.transform(F.sequence(F.ceil(F.log2(F.size(x["missing"]) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
        bound = F.array(F.struct(x["own"].alias("own"), x["missing"].alias("missing"), steps.alias("steps")))
        return F.transform(bound, lambda y: F.filter(F.transform(y["own"], lambda p, i: F.when(_among(p, y["missing"], y["steps"]), i)), lambda i: i.isNotNull()))[0]

    # Arrays of one element bind their value to a name: it is computed once, wherever the lambda uses it.
    return F.transform(F.array(F.struct(own.alias("own"), missing.alias("missing"))), positions)[0]


def tree(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `paragraph_digests`, `section_digests`, `root`, `fingerprint`. A null text is the empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("leaf_digests", leaves(text))
    out = out.withColumn("paragraph_digests", paragraphs_of(F.col("leaf_digests")))
    out = out.withColumn("section_digests", sections(F.col("paragraph_digests"))).withColumn("root", root(F.col("section_digests")))
    out = out.withColumn("fingerprint", fingerprint(F.col("root"), clauses(F.col("leaf_digests")))).drop("leaf_digests")
    return out.withColumn("section_digests", F.transform("section_digests", lambda s: F.sha2(s, 256)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `text`, its `leaves`, and `next_text` and `next_leaves` of the next row by ascending id; after the last row comes the first.

    Ids are numbers. They are cut into as many ranges as there are shuffle partitions. A range's first row is dealt to the range before as well, so that one
    shuffle of the texts suffices. Null texts count as empty, null ids come first, rows with equal ids follow a hash of the text.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(id_col)
    borders = docs.agg(F.percentile_approx(key, [i / tasks for i in range(1, tasks)] or [0.5], 100 * tasks)).first()[0] or []
    edges = F.lit(sorted(set(borders))) if borders else F.array().cast("array<bigint>")
    bucket = F.when(key.isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= key)))
    firsts = sorted(tuple(r) for r in docs.groupBy(bucket.alias("bucket")).agg(F.min(key), F.count_if(key.isNull())).collect())  # a row per range
    starts = [(None if nulls else least, firsts[i - 1][0]) for i, (_, least, nulls) in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    heads = F.broadcast(spark.createDataFrame(starts, f"head {kind}, before int"))  # a row per range
    rows = docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), bucket.alias("bucket"))
    dealt = F.explode(F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("at"), F.lit(True).alias("guest"))))))
    rows = rows.join(heads, F.col("id").eqNullSafe(F.col("head")), "left").select("id", "text", dealt.alias("d")).select("id", "text", "d.at", "d.guest")
    # A range is a task: its number is replaced by a key that the shuffle's hash sends there.
    keys = spark.range(64 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).agg(F.min("id")).collect()  # a row per range
    key_of = [k for _, k in sorted(tuple(r) for r in keys)]
    if len(key_of) == tasks:
        rows = rows.withColumn("at", F.get(F.lit(key_of), F.col("at")))
    rows = rows.repartition(tasks, "at").withColumn("leaves", leaves(F.col("text")))  # after the shuffle: leaves outweigh the text
    order = Window.partitionBy("at").orderBy("guest", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    following = {f"next_{x}": F.lead(x).over(order) for x in ("text", "leaves")}
    return rows.withColumns(following).where("not guest").select(F.col("id").alias(id_col), "text", "leaves", *following)


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of every text, of the text with its last 1/`share` replaced by the beginning of the next, and their likeness.

    Columns `id_col`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`, and
    `edited_paragraphs`, where the Merkle branches differ. A null text is the empty one; an empty table gives an empty result.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    rows = rows.withColumns({"front": F.left("text", F.col("n_chars").cast("int") - cut), "back": F.left("next_text", cut)})
    # Whole lines of the front keep their leaves; the line that the edit enters and those after it are hashed.
    whole = F.size(F.split("front", "\n", -1)) - 1
    tail = leaves(F.concat(F.substring_index("front", "\n", -1), F.col("back")))
    edited = F.array_join(F.concat(F.slice(F.split("leaves", " ", -1), 1, whole), F.array(tail)), " ")
    rows = rows.select(id_col, "n_chars", F.sha2(F.concat("front", "back"), 256).alias("edited_sha256"), F.col("leaves").alias("text"), edited.alias("edited"), F.col("next_leaves").alias("next"))
    rows = rows.withColumns({f"{x}_p": paragraphs_of(F.col(x)) for x in ("text", "edited")} | {f"{x}_c": clauses(F.col(x)) for x in ("text", "edited", "next")})
    rows = rows.withColumns({f"{x}_s": sections(F.col(f"{x}_p")) for x in ("text", "edited")})
    return rows.select(
        id_col, "n_chars", "edited_sha256",
        fingerprint(root(F.col("text_s")), F.col("text_c")).alias("fingerprint"), fingerprint(root(F.col("edited_s")), F.col("edited_c")).alias("edited_fingerprint"),
        likeness(F.col("text_c"), F.col("edited_c")).alias("near_edited"), likeness(F.col("text_c"), F.col("next_c")).alias("near_next"),
        edited_paragraphs(F.col("text_p"), F.col("edited_p")).alias("edited_paragraphs"),
    )
