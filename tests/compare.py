"""Run registered queries next to their expected-result SQL and compare the rows.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, connection, sql) -> str:
    """Empty if equal, else what differs."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    expected = rows_of(names, relation.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} expected {sorted(names)}"
    found = rows_of(spark_df.columns, spark_df.collect())
    if found == expected:
        return ""
    missing = [r for r in expected if r not in set(found)][:2]
    extra = [r for r in found if r not in set(expected)][:2]
    return f"rows {len(found)} expected {len(expected)}; missing {str(missing)[:300]}; extra {str(extra)[:300]}"


def main() -> int:
    import __spark_entry__ as entry

    from pubwatch.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    connection, sql, bad = oracle(folder), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            note = difference(df, connection, sql[name]) if name in sql else f"rows {len(df.collect())} (no SQL)"
            state = "ok  " if not note or name not in sql else "DIFF"
        except Exception as error:  # noqa: BLE001 - the report shows every failure
            state, note = "FAIL", f"{type(error).__name__}: {str(error)[:400]}"
        if state != "ok  ":
            bad.append(name)
        print(f"{state} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
    return int(bool(bad))


if __name__ == "__main__":
    raise SystemExit(main())
