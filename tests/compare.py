"""Run registered queries next to their SQL and compare the rows.

``python tests/compare.py [sf_dir] [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def normal(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[None if v is None else str(v) for v in table[n].to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def difference(spark_rows: pa.Table, sql_rows: pa.Table) -> str | None:
    """What differs, or None."""
    if sorted(spark_rows.column_names) != sorted(sql_rows.column_names):
        return f"columns {sorted(spark_rows.column_names)} != {sorted(sql_rows.column_names)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)} rows"
    kinds = {
        f.name: (str(f.type), str(sql_rows.schema.field(f.name).type))
        for f in spark_rows.schema
        if f.type != sql_rows.schema.field(f.name).type
    }
    a, b = normal(spark_rows), normal(sql_rows)
    if a != b:
        first = next((x, y) for x, y in zip(a, b, strict=True) if x != y)
        return f"rows differ, first {first}; types {kinds}"
    return f"types differ {kinds}" if kinds else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from flowplace.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    shared = tempfile.mkdtemp(prefix="compare-")
    spark = build_session(master="local[8]", spark__checkpoint__dir=shared, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    db, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            took = time.time() - begin
            begin = time.time()
            verdict = "rows only" if name not in oracle else difference(got, db.execute(oracle[name]).to_arrow_table()) or "ok"
            print(f"{name:36s} {len(got):8d} rows {took:6.2f}s sql {time.time() - begin:6.2f}s  {verdict}", flush=True)
            bad += verdict not in ("ok", "rows only")
        except Exception as e:  # noqa: BLE001 - report every query
            bad += 1
            print(f"{name:36s} FAILED {type(e).__name__}: {str(e)[:600]!r}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
