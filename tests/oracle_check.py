"""Compare every named query with its SQL statement.

    python tests/oracle_check.py [sf dir] [names...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table_rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(normal(v) for v in row) for row in zip(*columns)) if all_sortable(columns) else sorted(
        (tuple(normal(v) for v in row) for row in zip(*columns)), key=repr
    )


def all_sortable(columns) -> bool:
    return all(v is not None for column in columns for v in column)


def kinds(table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "") for n in table.column_names}


def compare(spark_table, oracle_table) -> list[str]:
    problems = []
    left, right = kinds(spark_table), kinds(oracle_table)
    if left != right:
        problems.append("types: " + str({n: (left.get(n), right.get(n)) for n in left | right if left.get(n) != right.get(n)}))
    if set(left) == set(right):
        a, b = table_rows(spark_table), table_rows(oracle_table)
        if len(a) != len(b):
            problems.append(f"rows: {len(a)} against {len(b)}")
        elif a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            problems.append(f"values: {len(bad)} rows differ, first {bad[0]}")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from peerwatch.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    statements, failed = oracle_sql(), 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            start = time.time()
            got = run(spark, sf_dir).toArrow()
            mid = time.time()
            if name not in statements:
                print(f"{name:28s} {mid - start:6.2f}s rows only: {got.num_rows}", flush=True)
                continue
            want = con.execute(statements[name]).to_arrow_table()
            problems = compare(got, want)
            took = f"{mid - start:6.2f}s / {time.time() - mid:5.2f}s"
        except Exception as error:
            problems, took = [repr(error)[:1500]], "-"
        failed += bool(problems)
        print(f"{name:28s} {took} {'ok ' + str(got.num_rows) if not problems else 'FAIL ' + '; '.join(problems)[:900]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
