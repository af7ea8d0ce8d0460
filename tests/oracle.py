"""Comparison of a query's rows with those of its SQL in DuckDB.

As a script: ``python tests/oracle.py SF_DIR [NAME...]`` runs registered queries against their SQL.
"""

from __future__ import annotations

import math
from pathlib import Path


def normal(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_integer_ratio"):
        return f"{float(value):.9g}" if int(value) != value else int(value)
    return value


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in rows)


def duck(sf_dir: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def difference(df, con, sql: str) -> str | None:  # noqa: ANN001
    """What differs, or None."""
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, theirs.fetchall())
    if a == b:
        return None
    more, less = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} and {len(b)} rows; only Spark {more}; only SQL {less}"


def main(args: list[str]) -> int:
    import sys
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__
    from sigloom.session import local_session

    spark = local_session(6)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(args[0]), __spark_entry__.queries(), __spark_entry__.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, args[0])
            why = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(why) and not why.startswith("rows only")
        print(f"{name}: {why or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
