"""Compare a query's Spark result with its SQL on the same files. Run as a script for a whole scale factor."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "double": "DOUBLE"}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def difference(frame, con, sql: str) -> str:
    """Empty if columns, types and rows agree, in any order."""
    relation = con.sql(sql)
    types = dict(zip(relation.columns, map(str, relation.types)))
    ours = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema.fields}
    if ours != {n: t for n, t in types.items()}:
        return f"schema {sorted(ours.items())} against {sorted(types.items())}"
    columns = sorted(ours)
    left = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    place = [relation.columns.index(c) for c in columns]
    right = Counter(tuple(r[i] for i in place) for r in relation.fetchall())
    if left == right:
        return ""
    return (f"{sum(left.values())} against {sum(right.values())} rows; only here {list((left - right).items())[:2]}, "
            f"only there {list((right - left).items())[:2]}")


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from pointline.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = database(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            found = difference(run(spark, folder), con, sql[name])
        except Exception as error:  # report and go on with the next query
            found = f"failed: {str(error)[:500]}"
        if found:
            bad += 1
        print(f"{name:28s} {time.time() - began:6.2f}s {found or 'ok'}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(bool(main(sys.argv[1], sys.argv[2:])))
