"""Compare catalogue queries with their DuckDB SQL: columns, types, rows, values.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KIND = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} vs {sorted(rel.columns)}"]
    out = []
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for f in df.schema:
        want = KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kinds[f.name] != want:
            out.append(f"type of {f.name}: spark {want}, oracle {kinds[f.name]}")
    got = _sorted([tuple(r[c] for c in names) for r in df.collect()])
    want = _sorted(rel.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
    if len(got) != len(want):
        out.append(f"rows: spark {len(got)}, oracle {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {names} spark {bad[0][0]} oracle {bad[0][1]}")
    return out


def main() -> None:
    from tests.conftest import make_session
    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    oracles, failed = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                bad = differences(df, con, oracles[name])
                note = "ok" if not bad else "DIFF " + "; ".join(bad)
            else:
                note = f"rows {len(df.collect())}"
                bad = []
        except Exception as exc:
            bad, note = [exc], f"ERROR {str(exc)[:600]}"
        failed += [name] if bad else []
        print(f"{name:28s} {time.time() - t:6.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
