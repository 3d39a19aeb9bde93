"""Run registered queries against their SQL in DuckDB and report differences.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from pairlens.catalog import oracle_sql, queries
from pairlens.session import build_session


def normal(value):
    if value is None:
        return None
    if isinstance(value, float) or type(value).__name__.startswith(("float", "Decimal")):
        value = float(value)
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rows_of(cols, rel.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    note = f"types spark={[(f.name, f.dataType.simpleString()) for f in spark_df.schema]} sql={kinds}"
    type_pairs = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    off = [f.name for f in spark_df.schema if type_pairs.get(f.dataType.simpleString(), kinds[f.name]) != kinds[f.name]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]} [{note}]"
    return f"values equal, types differ for {off}: {note}" if off else None


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    fns, sqls = queries(), oracle_sql()
    names = sys.argv[2:] or list(fns)
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failures, total = connect(sf), 0, time.time()
    for name in names:
        start = time.time()
        try:
            df = fns[name](spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as err:
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        failures += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:32s} {time.time() - start:6.1f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names) - failures}/{len(names)} equal, {time.time() - total:.0f}s")
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
