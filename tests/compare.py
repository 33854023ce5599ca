"""Runs queries of the entry module beside their DuckDB SQL: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "DECIMAL": "decimal", "SMALLINT": "smallint", "TINYINT": "tinyint", "FLOAT": "float", "BLOB": "binary"}


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in sorted(folder.glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows_of(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> str:
    """Empty, or what differs."""
    df = query(spark, folder)
    mine, my_names = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(my_names):
        return f"columns {sorted(my_names)} against {sorted(names)}"
    kinds = {n: KINDS.get(str(c[1]).split("(")[0], str(c[1])) for n, c in zip(names, cur.description)}
    unlike = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if f.dataType.simpleString().split("(")[0] != kinds[f.name].lower() and kinds[f.name] != "list"]
    if unlike:
        print(f"  types: {unlike}")
    a, b = rows_of(my_names, mine), rows_of(names, theirs)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} rows against {len(b)}; first differences {diff}"
    return "" if a else "no rows"


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    from siltstone.session import build_session

    args, folder = sys.argv[1:], TESTDATA / "sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = Path(args[1]), args[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    con, queries, sql = connect(folder), e.queries(), e.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for n in names:
        began = time.time()
        try:
            said = compare(spark, con, queries[n], sql[n], str(folder)) if n in sql else f"rows only: {queries[n](spark, str(folder)).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{n}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
