"""Compare every catalogue query with its SQL in DuckDB.

``python -m parley.plans.check SF_DIR [NAME ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import SparkSession

from parley import plans
from parley.session import build_session


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


KINDS = {
    "bigint": "bigint",
    "int": "integer",
    "double": "double",
    "string": "varchar",
    "boolean": "boolean",
    "timestamp_ntz": "timestamp",
}


def comparable(value: Any) -> Any:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    return (1, repr(value))


def compare(spark: SparkSession, connection: duckdb.DuckDBPyConnection, name: str, sf: str) -> str:
    """Empty if the query and its SQL agree on names, types and rows."""
    df = plans.queries()[name](spark, sf)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    sql = plans.oracles().get(name)
    if sql is None:
        return "" if rows else "no rows"
    result = connection.execute(sql)
    theirs = {d[0]: str(d[1]).lower() for d in result.description}
    fetched = result.fetchall()
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    place = [list(theirs).index(c) for c in names]
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    wrong = {c: (kinds[c], theirs[c]) for c in names if kinds[c] != theirs[c]}
    if wrong:
        return f"types {wrong}"
    expected = sorted(tuple(comparable(r[i]) for i in place) for r in fetched)
    got = sorted(tuple(comparable(v) for v in r) for r in rows)
    if expected == got:
        return ""
    missing = sorted(set(expected) - set(got))[:2]
    extra = sorted(set(got) - set(expected))[:2]
    return f"{len(got)} rows, expected {len(expected)}; missing {missing}; extra {extra}"


def main(sf: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    failed = 0
    for name in names or plans.queries():
        start = time.time()
        try:
            problem = compare(spark, connection, name, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
