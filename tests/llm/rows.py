"""Small documents with the awkward cases, and brute-force forms that several tests share."""

import random

NONE = 2**63 - 1

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, node long, block long"


def key(i):
    return NONE if i is None else i


def awkward():
    """Null ids and texts, empty and long texts, ties, repeated rows, one letter throughout, blank lines."""
    lines = "one two\nthree four\n\nfive six"
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    texts = [
        (None, "x y " * 40),
        (None, "x y " * 40),
        (None, None),
        (1, None),
        (2, ""),
        (3, "a " * 300),
        (3, "a " * 300),
        (4, "a\n" * 300),
        (5, "zé" * 40),
        (6, "q" + "zé" * 40),
        (7, lines),
        (8, "start\n" + lines + "\nend"),
        (9, "start\n" + lines + "\nend"),
        (10, " \n\n \t\n"),
        (11, long),
        (12, "before " + long[5000:9000] + " after"),
        (13, "u\nv\nw\nu\nv\nw\nu\nv\nw"),
        (14, "\x00 \x0b nul and tab\t"),
        (15, "word"),
        (16, "WORD"),
    ]
    return [(d, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "k", i, 5, 0) for i, (d, t) in enumerate(texts)]


def frame(spark, rows=None, columns=COLUMNS):
    return spark.createDataFrame(awkward() if rows is None else rows, columns)


def covered(rows, width, own=False):
    """(id, atoms, whether each atom is in a window that a smaller id has - or, with ``own``, that stands before in it)."""
    least = {}
    for d, t in rows:
        for i in range(len(t) - width + 1):
            w = tuple(t[i : i + width])
            least[w] = min(least.get(w, NONE), key(d))
    for d, t in rows:
        gone, seen = [False] * len(t), set()
        for i in range(len(t) - width + 1):
            w = tuple(t[i : i + width])
            if least[w] < key(d) or (own and w in seen):
                gone[i : i + width] = [True] * width
            seen.add(w)
        yield d, t, gone


def near_classes(rows, size, percent):
    """Set sizes and smallest linked id of (id, text) rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), NONE), key(d))
    return [(d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
