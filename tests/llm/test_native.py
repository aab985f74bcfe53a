"""Decontamination, mixing and license scan; their plans hold no Python."""

import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from barloom.llm import decontaminate, licenses, mixing, queries
from tests.llm.rows import awkward, frame, key

PYTHON = re.compile("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_contained_items(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "a b c d"), (63, "a b c d e")]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rng.choice((0, 3, 50, 3000)))]
        item = items[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "changed"
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + item + words[at:]).upper(), "", "", 0, "", 0, 0, 0))
    rows = awkward() + docs + [(400, "x a b c d e", "", "", 0, "", 0, 0, 0)] * 2
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n long")
    got = decontaminate.contained_items(frame(spark, rows), benchmark)
    have = defaultdict(set)
    for r in rows:
        have[key(r[0])] |= shingles(r[1])
    want = {(d, i, len(q), len(q & s)) for d, s in have.items() for i, t in items if (q := shingles(t)) and 100 * len(q & s) >= 80 * len(q)}
    found = got.collect()
    assert {(key(r[0]), *r[1:4]) for r in found} == want and len(found) == len(want) and (400, 63, 1, 1) in want
    assert not PYTHON.search(plan(got))
    kept = decontaminate.clean(frame(spark, rows), benchmark)
    bad = {d for d, *_ in want}
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(r[0]) for r in rows if key(r[0]) not in bad)
    assert decontaminate.contained_items(frame(spark, []), benchmark).count() == 0
    assert decontaminate.contained_items(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_large_benchmarks_are_shuffled(spark, sf, monkeypatch):
    want = sorted(map(tuple, queries.op7_decontamination(spark, sf).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, queries.op7_decontamination(spark, sf).collect())) == want


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_phrase_dedup", "op4_near_dedup", "op7_decontamination", "op9_line_dedup", "op10_license_scan"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = getattr(queries, name)(spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Sources in code-point order, null last; the excess goes round until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= above
    return target


def test_mix(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rng = random.Random(2)
    many = [(1000 + i, "w " * rng.randint(1, 90), "", rng.choice(["hot"] * 6 + ["b", "ß", "Z"]), 0, "", 0, 0, 0) for i in range(500)]
    rows = awkward() + many
    got = mixing.mix(frame(spark, rows))
    found = got.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(sizes)
    assert sorted((key(r.doc_id), r.size) for r in found) == sorted((key(r[0]), words(r[1])) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or math.floor(rate) * r.size <= r.taken <= math.ceil(rate) * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert not PYTHON.search(plan(got))


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.take(frame(spark, [])).count() == 0
    wordless = frame(spark, [(1, "", "", "a", 0, "", 0, 0, 0), (2, None, "", None, 0, "", 0, 0, 0)])
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(wordless).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    long = "some words of a program " * 30
    rows = [
        ("/a/LICENSE", mit),
        ("/a/x.py", long),
        ("/a/b/c/y.py", long),
        ("/a/b/COPYING.txt", gpl),
        ("/a/b/z.py", long + "\n" + mit),
        ("/a/b/z.py", long + "\n" + mit),
        ("/n/w.py", long),
        ("/n/v.py", None),
        ("/n/note.txt", "About a licence that nobody has heard of and that matches none of them"),
        (None, long),
        ("/m/short", mit),
        ("/m/k/t.py", ""),
    ]
    got = {(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        ("/a/LICENSE", "MIT", "MIT", None),
        ("/a/x.py", None, "MIT", "/a/LICENSE"),
        ("/a/b/c/y.py", None, "GPL-3.0", "/a/b/COPYING.txt"),
        ("/a/b/COPYING.txt", "GPL-3.0", "GPL-3.0", None),
        ("/a/b/z.py", "MIT", "MIT", None),
        ("/n/w.py", None, None, None),
        ("/n/v.py", None, None, None),
        ("/n/note.txt", None, None, None),
        (None, None, None, None),
        ("/m/short", "MIT", "MIT", None),
        ("/m/k/t.py", None, "MIT", "/m/short"),
    }
    none = licenses.scan(spark.createDataFrame([], "path string, text string"))
    assert none.count() == 0


def test_headers_and_identifiers_of_many_lines(spark):
    code = "\n\nint main() { return 0; }\n\n" + "some words of a program " * 300
    gpl = """/* frob.c - frobnicates
 * Copyright (C) 2019 A. Person
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */"""
    mit = dict(licenses.HEADERS)["MIT"].replace("Copyright (c)", "\n\nCopyright (c) 2020 A. Person\n\n").replace("conditions:", "conditions:\n\n")
    rows = [("/g/frob.c", gpl + code), ("/s/a.py", "# SPDX-License-Identifier: Apache-2.0" + code), ("/s/b.py", "// spdx-license-identifier: GPL-3.0-or-later" + code), ("/m/LICENSE", mit), ("/m/x.py", code), ("/n/y.py", "# Copyright 2020 A. Person" + code)]
    got = {(r.path, r.own_license, r.license) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        ("/g/frob.c", "GPL-3.0-or-later", "GPL-3.0-or-later"),
        ("/s/a.py", "Apache-2.0", "Apache-2.0"),
        ("/s/b.py", "GPL-3.0-or-later", "GPL-3.0-or-later"),
        ("/m/LICENSE", "MIT", "MIT"),
        ("/m/x.py", None, "MIT"),
        ("/n/y.py", None, None),
    }


def test_license_plan_has_no_python(spark, sf):
    assert not PYTHON.search(plan(queries.op10_license_scan(spark, sf)))


def test_license_identifiers_denials_and_long_texts(spark):
    code = "\n" + "\n".join(f"call number {i} does nothing" for i in range(40))
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "\n\n".join(f"Section {i} of a text\nof many pages" for i in range(300))
    rows = [
        ("/a/x.py", "# SPDX-License-Identifier: MIT OR Apache-2.0" + code),
        ("/b/x.py", "Released under the MIT License.\nSPDX-License-Identifier: GPL-3.0-only" + code),
        ("/c/x.py", "SPDX-License-Identifier: NOT-A-LICENSE" + code),
        ("/d/x.py", "This file is not licensed under the GNU General Public License, version 3." + code),
        ("/e/LICENSE", gpl),
        ("/e/x.py", code),
        ("/f/x.c", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) */" + code),
        ("/g/x.py", "SPDX-License-Identifier: MIT OR ISC\nSPDX-License-Identifier: 0BSD" + code),
        ("/h/x.py", "SPDX-License-Identifier: MIT AND NO-SUCH" + code),
        ("/i/x.py", "SPDX-License-Identifier: LicenseRef-Ours." + code),
    ]
    got = {r.path: (r.own_license, r.license) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    alone = {p: x[0] for p, x in got.items()}
    assert alone == {
        "/a/x.py": "MIT OR Apache-2.0", "/b/x.py": "GPL-3.0-only", "/c/x.py": None, "/d/x.py": None, "/e/LICENSE": "GPL-3.0", "/e/x.py": None,
        "/f/x.c": "(GPL-2.0-only WITH Classpath-exception-2.0 OR MIT)", "/g/x.py": "(MIT OR ISC) AND 0BSD", "/h/x.py": None, "/i/x.py": "LicenseRef-Ours",
    }
    assert got["/e/x.py"] == (None, "GPL-3.0")


def test_license_identifiers_agree_with_sql(spark, tmp_path):
    heads = ["SPDX-License-Identifier: MIT OR Apache-2.0", "x SPDX-License-Identifier: NOPE", "Released under the MIT License.\nSPDX-License-Identifier: GPL-3.0+", "Released under the MIT License.", "This is not licensed under the MIT License.", "SPDX-License-Identifier: ISC\nSPDX-License-Identifier: MIT or ISC", "plain"]
    rows = [(i, h + tail, "s", "l") for i, (h, tail) in enumerate((h, t) for h in heads for t in ("", "\nand many other words in a line that says nothing"))]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({licenses.oracle()})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
