"""Run registered queries and their SQL side by side and compare whole results.

    python tools/check.py [-d SF_DIR] [name ...]
"""

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from barloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from barloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.d}/{t}.parquet'")
    names = [n for n in QUERIES if not a.names or any(n.startswith(x) for x in a.names)]
    bad = []
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.d)
            got = rows(df.columns, df.collect())
            spent = time.time() - t0
            if n not in ORACLES:
                print(f"{n:32s} rows-only {len(got)} rows {spent:.2f}s", flush=True)
                continue
            cur = con.execute(ORACLES[n])
            names_ = [c[0] for c in cur.description]
            want = rows(names_, cur.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
            bad.append(n)
            continue
        ok = sorted(df.columns) == sorted(names_) and got == want
        kinds = ""
        if ok:
            print(f"{n:32s} ok {len(got)} rows {spent:.2f}s {kinds}", flush=True)
            continue
        bad.append(n)
        print(f"{n:32s} MISMATCH rows {len(got)} vs {len(want)}", flush=True)
        if sorted(df.columns) != sorted(names_):
            print("   columns", sorted(df.columns), sorted(names_))
            continue
        cols = sorted(df.columns)
        diffs = {}
        for g, w in zip(got, want):
            for c, x, y in zip(cols, g, w):
                if x != y:
                    diffs.setdefault(c, []).append((x, y))
        for c, d in diffs.items():
            print("   ", c, len(d), d[:3])
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()
