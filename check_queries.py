"""Compare registered queries with their SQL twins: check_queries.py [sf] [name prefix ...]."""

from __future__ import annotations

import sys
import time

import duckdb

from wartaframe.session import local_session


def rows_of(pairs, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in pairs), key=repr)


def main(sf: str, prefixes: list[str]) -> int:
    from catalog import ORACLES, QUERIES

    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    failed = 0
    for name, run in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            df = run(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"{name:28} SPARK ERROR {str(e)[:600]}", flush=True)
            continue
        if name not in ORACLES:
            print(f"{name:28} rows={len(got)} {took:.1f}s (no SQL)", flush=True)
            continue
        try:
            start = time.time()
            rel = con.execute(ORACLES[name])
            columns = [d[0] for d in rel.description]
            want = rel.fetchall()
            sql_took = time.time() - start
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"{name:28} SQL ERROR {str(e)[:600]}", flush=True)
            continue
        same_columns = sorted(df.columns) == sorted(columns)
        a, b = rows_of(got, df.columns), rows_of(want, columns)
        ok = same_columns and a == b
        failed += not ok
        kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
        sql_kinds = sorted((d[0], str(d[1])) for d in rel.description)
        print(f"{name:28} {'ok' if ok else 'DIFF'} rows={len(got)}/{len(want)} {took:.1f}s sql {sql_took:.1f}s", flush=True)
        if not ok:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print("   ", kinds, sql_kinds, str(diff)[:1500], flush=True)
        elif [k for _, k in kinds] != [_spark_kind(k) for _, k in sql_kinds]:
            print("    types", kinds, sql_kinds, flush=True)
    print("failed:", failed)
    return failed


def _spark_kind(kind: str) -> str:
    return {
        "VARCHAR": "string", "STRING": "string", "INTEGER": "int", "BIGINT": "bigint",
        "NUMBER": "?", "DOUBLE": "double", "BOOLEAN": "boolean",
    }.get(kind, kind)


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sf = arguments.pop(0) if arguments and arguments[0].startswith("0.") else "0.01"
    sys.exit(1 if main(sf, arguments) else 0)
