"""Run registered queries next to their SQL and report differences.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def normal(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


KINDS = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"}}


def compare(df, con, sql):
    """None if equal, else a short description."""
    got = df.collect()
    rel = con.sql(sql)
    want = rel.fetchall()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(rel.columns, want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if kinds[name] not in KINDS.get(kind, {kinds[name]}) and kind in KINDS:
            return f"type of {name}: {kind} != {kinds[name]}"
        if kind not in KINDS:
            return f"type of {name}: {kind}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}; e.g. {sorted(set(gr) ^ set(wr))[:4]}"
    if gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b]
        return f"{len(bad)} rows differ, e.g. {bad[:2]}"
    if not gr:
        return "no rows"
    return None


def main(sf: str, wanted: list[str]) -> int:
    from trigwatch.plans import load_all
    from trigwatch.session import local_session

    queries, oracles = load_all()
    spark = local_session()
    con = connect(sf)
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(queries)}")
    return failed


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    sys.exit(1 if main(args[0], args[1:]) else 0)
