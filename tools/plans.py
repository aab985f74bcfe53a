"""Show what the physical plans of the registered queries contain.

    python tools/plans.py [-d SF_DIR] [-v] [name ...]
"""

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.plans.catalog import QUERIES  # noqa: E402
from barloom.session import local_session  # noqa: E402

MARKS = ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "Python", "ArrowEval", "SortAggregate")


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.001")
    ap.add_argument("-v", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    for n in QUERIES:
        if a.names and not any(n.startswith(x) for x in a.names):
            continue
        text = QUERIES[n](spark, a.d)._jdf.queryExecution().executedPlan().toString()
        marks = {m: text.count(m) for m in MARKS if m in text}
        windows = set(re.findall(r"Window \[.*\], \[([^\[\]]*)\], \[[^\[\]]*\]$", text, re.M))
        keys = sorted({re.sub(r"#\d+L?", "", w) for w in windows})
        print(f"{n:28s} scans {text.count('FileScan')} exchanges {text.count('Exchange hash')} {marks} windows {keys}", flush=True)
        if a.v:
            print(text)


if __name__ == "__main__":
    main()
