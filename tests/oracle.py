"""Run registered queries in Spark and DuckDB side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, folder, name, queries, sqls):
    """Return (status, message, seconds)."""
    t0 = time.time()
    df = queries[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if name not in sqls:
        return "rows", f"{len(got[1])} rows", took
    cur = con.execute(sqls[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "FAIL", f"columns {got[0]} vs {want[0]}", took
    if len(got[1]) != len(want[1]):
        return "FAIL", f"rows {len(got[1])} vs {len(want[1])}: {got[1][:2]} vs {want[1][:2]}", took
    bad = [(a, b) for a, b in zip(got[1], want[1]) if repr(a) != repr(b)]
    if bad:
        loose = [(a, b) for a, b in bad if a != b]
        if loose:
            return "FAIL", f"{len(loose)} rows differ\n   spark {loose[0][0]}\n   duck  {loose[0][1]}\n   cols  {got[0]}", took
        return "type", f"equal values, other types: {bad[0][0]} vs {bad[0][1]}", took
    return "ok", f"{len(got[1])} rows", took


def main():
    from plumbline.catalog import registry
    from plumbline.session import build_session
    import importlib
    import plumbline.catalog as catalog

    folder = f"/root/testdata/{sys.argv[1]}"
    families = sys.argv[2].split(",")
    only = set(sys.argv[3].split(",")) if len(sys.argv) > 3 else None
    if families == ["all"]:
        families = catalog.FAMILIES
    for f in families:
        importlib.import_module(f"plumbline.catalog.{f}")
    spark = build_session(8)
    con = connect(folder)
    total = time.time()
    tally = {}
    for name in registry.QUERIES:
        if (only and name not in only) or (not only and registry.FAMILY[name] not in families):
            continue
        try:
            status, message, took = compare(spark, con, folder, name, registry.QUERIES, registry.SQL)
        except Exception as e:  # noqa: BLE001
            status, message, took = "ERROR", f"{type(e).__name__}: {str(e)[:900]}", 0.0
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:5} {name:34} {took:6.2f}s  {message}", flush=True)
    print(tally, f"{time.time() - total:.1f}s")


if __name__ == "__main__":
    main()
