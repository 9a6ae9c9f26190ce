"""Compares queries with their SQL in DuckDB: python tests/compare.py [SF_DIR] [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(norm(r[n]) for n in names) for r in df.to_dict("records"))))


def norm(x):
    import numpy as np
    import pandas as pd

    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(norm(y) for y in x)
    if x is None or x is pd.NA or (isinstance(x, float) and x != x) or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return float(x)
    return str(x)


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, name, query, sql, d) -> str:
    got = query(spark, d)
    names = got.columns
    pdf = got.toPandas()
    # integers with nulls come as floats
    pdf = pdf.astype({c: "Int64" for c, kind in got.dtypes if kind in ("int", "bigint") and pdf[c].dtype.kind == "f"})
    if not sql:
        return f"rows only, {len(pdf)}"
    want = con.execute(sql).df()
    if sorted(names) != sorted(want.columns):
        return f"BAD columns {sorted(names)} {sorted(want.columns)}"
    a, b = rows_of(pdf), rows_of(want)
    if a == b:
        return f"ok, {len(a)}"
    odd = [(x, y) for x, y in zip(a, b) if x != y][:1]
    return f"BAD rows {len(a)} {len(b)} {odd}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[6]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(d), entry.queries(), entry.oracle_sql()
    for name in queries:
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracles.get(name), d)
        except Exception as e:  # noqa: BLE001
            said = f"BAD {type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
