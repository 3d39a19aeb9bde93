"""Line dedup against a plain version, and its levelled runs."""

import random

import pytest
from fixtures import documents, rows_of, texts
from pyspark.sql import functions as F

from pairlens.llm.lines import LineRuns, dedup_lines, line_key

COMMON = "A line that very many documents share"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def slow(rows, least=10):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key_of(line)
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < least or first[key_of(x)] == order(d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def many(n=300):
    rng = random.Random(5)
    pool = [f"Line no. {k} of the pool, {'x' * (k % 40)}" for k in range(60)] + ["short", "", "  Ünï LINE é \t", "ünï line é", "Ünï line é  "]
    rows = [(rng.randrange(200), "\n".join([*rng.choices(pool, k=rng.randrange(8)), *([f" \t{COMMON.upper() if k % 2 else COMMON}\r"] * (k % 3))])) for k in range(n)]
    return [*rows, *texts(), (900, f"{COMMON}\n\n"), (None, COMMON), (None, f"only without id\n{COMMON}"), (None, "Only without ID"), (901, "\n".join(f"own line of a long text {k}" for k in range(20000)) + f"\n{COMMON}")]


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_equals_plain_version(spark, batches):
    rows = many()
    got = rows_of(dedup_lines(documents(spark, rows), batches=batches), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == slow(rows)


def test_nothing_to_drop_and_everything_to_drop(spark):
    rows = [(1, None), (2, ""), (3, "one line of text"), (4, "ONE line of text"), (5, "one line of text\n\tOne Line Of Text ")]
    assert rows_of(dedup_lines(documents(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept") == [(1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 0, "one line of text"), (4, 1, 1, ""), (5, 2, 2, "")]
    assert dedup_lines(documents(spark, [])).count() == 0


def test_other_columns_stay(spark):
    docs = documents(spark, many(40), extra=True).withColumns({c: F.lit(k) for k, c in enumerate(("key", "first", "n", "at", "own", "text_hash", "gone", "batch", "n_lines", "n_dropped"))})
    out = dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"kept"}
    assert out.where("key <> 0 or first <> 1 or own <> 4 or id <> 7").count() == 0
    assert out.count() == docs.count()


def test_key_is_the_contracts(spark):
    lines = ["  A B\t", "\x0b\x0cÉÀz\r", " x", "", "a\x1fB"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "i int, line string")
    assert [r[0] for r in df.orderBy("i").select(line_key(F.col("line"))).collect()] == [key_of(x) for x in lines]


def test_runs_are_compacted_and_give_each_hash_once(spark):
    runs, seen = LineRuns(spark, fanout=2), set()
    rng = random.Random(1)
    for step in range(7):
        batch = {rng.randrange(300) for _ in range(60)}
        new = runs.add(spark.createDataFrame([(str(k),) for k in batch], "key string"))
        assert {int(r[0]) for r in new.collect()} == batch - seen
        seen |= batch
        assert all(len(level) <= 2 for level in runs.levels)
    assert len(runs.levels) == 3
    stored = [int(r[0]) for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert sorted(stored) == sorted(seen)
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_not_moved_for_a_batch(spark):
    """Only the batch is shuffled; the runs are read by bucket into merge joins."""
    runs = LineRuns(spark)
    for part in range(3):
        runs.add(spark.range(part * 100, part * 100 + 100).selectExpr("cast(id as string) as key"))
    plan = runs.fresh(spark.range(50, 400).selectExpr("cast(id as string) as key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
    runs.close()
