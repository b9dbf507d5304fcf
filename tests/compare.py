"""Run queries against their SQL equals: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(x, y) -> bool:
    if x is None or y is None:
        return (x is None or x != x) and (y is None or y != y)
    if isinstance(x, float) or isinstance(y, float):
        return x == y or (x != x and y != y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


def key(row: tuple) -> tuple:
    return tuple((v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    order = sorted(names)
    b = sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=key)
    df = query(spark, sf_dir)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} and {order}"
    a = sorted((tuple(r) for r in df.select(*order).collect()), key=key)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    return f"{len(bad)} of {len(a)} rows differ in {order}: {bad[0][0]} and {bad[0][1]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in oracles:
                said = difference(spark, sys.argv[1], queries[name], oracles[name]) or "equal"
            else:
                said = f"no SQL, {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception:
            said = "FAILED " + "\n".join(x for x in traceback.format_exc().splitlines() if not x.lstrip().startswith("at "))[-1500:]
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
