"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    actual = rows_of(spark_df.columns, spark_df.collect())
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns: spark only {set(spark_df.columns) - set(names)}, sql only {set(names) - set(spark_df.columns)}"]
    if len(actual) != len(expected):
        return [f"rows: spark {len(actual)}, sql {len(expected)}"]
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e or [type(v) for v in a] != [type(v) for v in e]]
    columns = sorted(names)
    return [
        "; ".join(f"{c}: {x!r} / {y!r}" for c, x, y in zip(columns, a, e) if x != y or type(x) is not type(y))
        for a, e in wrong[:limit]
    ] + ([f"{len(wrong)} rows differ of {len(actual)}"] if wrong else [])


def main() -> None:
    import __spark_entry__ as entry
    from tillwatch.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                found = differences(df, con, oracle[name])
            else:
                found = [] if df.count() > 0 else ["no rows"]
        except Exception as problem:  # report and go on with the next query
            found = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.1f}s{'' if name in oracle else ' (rows)'}", flush=True)
        for line in found:
            print("     ", line)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
