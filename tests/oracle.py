"""Runs queries and their SQL side by side: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent


def connect(sf_dir: str, but: tuple[str, ...] = ()) -> duckdb.DuckDBPyConnection:
    """The tables as views, without string columns that are named in ``but``."""
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')"
        extra = [c[0] for c in con.execute(f"DESCRIBE SELECT * FROM {source}").fetchall() if c[0] in but]
        con.execute(f"CREATE VIEW {p.stem} AS SELECT *{' EXCLUDE (' + ', '.join(extra) + ')' if extra else ''} FROM {source}")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v) -> str:
        if v is None or v is pd.NaT:
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(text(x) for x in v) + "]"
        return str(v)

    return sorted("|".join(text(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None where both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} and {sorted(want_names)}"
    a, b = canonical(got, names), canonical(want, want_names)
    if a != b:
        x, y = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(a)} and {len(b)} rows; only Spark {x}; only SQL {y}"
    return None


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    from tidemark.session import get_session

    os.environ["SPARK_LOCAL_IP"] = "127.0.0.1"
    spark = get_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    q, o, bad = e.queries(), e.oracle_sql(), 0
    con = connect(sf)
    for name in names or q:
        t = time.time()
        try:
            said = compare(spark, con, q[name], o[name], sf) if name in o else f"(no SQL) {q[name](spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:700]}"
        bad += said is not None and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'same'} [{time.time() - t:.1f} s]", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
