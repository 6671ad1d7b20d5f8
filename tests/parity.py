"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

    python tests/parity.py [--sf DIR] [prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def kind(v):
    return "null" if v is None else "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def close(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if kind(a) != kind(b):
        return False
    if kind(a) == "num":
        return a == b
    return a == b


def compare(df, con, sql):
    names = sorted(df.columns)
    mine = [[plain(r[c]) for c in names] for r in df.collect()]
    rel = con.execute(sql)
    theirs_names = [x[0] for x in rel.description]
    rows = rel.fetchall()
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = [[plain(r[i]) for i in at] for r in rows]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}: {mine[:2]} / {theirs[:2]}"
    key = lambda r: [(kind(x), str(float(x)) if kind(x) == "num" else str(x)) for x in r]
    bad = [(m, t) for m, t in zip(sorted(mine, key=key), sorted(theirs, key=key)) if not all(close(x, y) for x, y in zip(m, t))]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first: {names} {bad[0][0]} / {bad[0][1]}"
    return None


def main() -> int:
    from colonnade.catalog import ORACLES, QUERIES, load_all
    from colonnade.session import build_session

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    load_all()
    spark = build_session("parity", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    failed = 0
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                state = "ok" if problem is None else "FAIL " + problem[:900]
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                state = f"rows-only {len(rows)} {rows[:1]}"[:300]
        except Exception as e:  # report and go on with the next query
            problem = state = "ERROR " + (type(e).__name__ + " " + str(e))[:700]
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
