"""Archives: round trip, and what the reader salvages from damaged ones."""

import gzip
import random
import uuid

import duckdb

from barloom.llm import queries, warc
from barloom.sources.stage import stage_root


def make(n=6, size=300):
    return [warc.record(i, f"http://h/{i}", (f"page {i} " * size).encode(), warc.base32_sha1((f"page {i} " * size).encode()), None) for i in range(n)]


def ids(found):
    return [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]


def gaps(found):
    return [x for x in found if isinstance(x, warc.Gap)]


def test_members_are_gzip_and_end_with_zero():
    for data in (b"", b"x", b"y" * 100_000):
        m = warc.member(data)
        assert m[-1] == 0 and gzip.decompress(m) == data
    assert warc.EMPTY_MEMBER[-1] == 0 and gzip.decompress(warc.EMPTY_MEMBER) == b""


def test_whole_archives_have_no_gaps():
    for data in (b"".join(make()), b"".join(warc.member(r) for r in make()), b""):
        found = list(warc.salvage(data))
        assert not gaps(found) and len(found) == (6 if data else 0)


def test_damage_costs_only_the_records_it_hits():
    plain = make()
    for pack in (lambda r: r, warc.member):
        parts = [pack(r) for r in plain]
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        data = bytearray(b"".join(parts))
        middle = starts[2] + len(parts[2]) // 2
        data[middle] ^= 0xFF
        found = list(warc.salvage(bytes(data)))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
        assert [(x.offset, x.length) for x in gaps(found)] == [(starts[2], len(parts[2]))]
        # the end is cut off, the beginning is garbage
        found = list(warc.salvage(b"garbage" + b"".join(parts)[: starts[5] + 20]))
        assert ids(found) == [f"<urn:page:{i}>" for i in range(5)]
        assert [(x.offset, x.length) for x in gaps(found)] == [(0, 7), (starts[5] + 7, 20)]


def test_every_byte_is_a_record_or_a_gap():
    data = bytearray(b"".join(warc.member(r) for r in make()))
    for k in range(0, len(data), 97):
        broken = bytes(data[:k]) + bytes([data[k] ^ 0x55]) + bytes(data[k + 1 :])
        spans = sorted({(x.offset, x.length) for x in warc.salvage(broken)})
        assert sum(n for _, n in spans) == len(data)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def one_member(records):
    return gzip.compress(b"".join(records), 1, mtime=0)


def test_a_bad_record_costs_its_member_no_other():
    """Six records in one member, one of them changed before it was packed."""
    plain = make()
    starts = [sum(map(len, plain[:i])) for i in range(7)]
    for i in range(6):
        bad = bytearray(b"".join(plain))
        bad[starts[i] + len(plain[i]) - 30] ^= 0x01
        data = one_member([bytes(bad)])
        found = list(warc.salvage(data + warc.member(plain[0])))
        assert ids(found) == [f"<urn:page:{j}>" for j in range(6) if j != i] + ["<urn:page:0>"]
        assert [(x.offset, x.length, x.inner, x.inner_length) for x in gaps(found)] == [(0, len(data), starts[i], len(plain[i]))]
        first = next(x for x in found if isinstance(x, warc.Record))
        assert first.length is None and first.inner == starts[1 if i == 0 else 0]


def test_damaged_heads_inside_a_member():
    plain = make()
    for place, byte in ((0, b"X"), (len(plain[0]) - 2, b"X"), (plain[0].find(b"Content-Length: 2") + 16, b"9"), (plain[0].find(b": "), b"; ")):
        first = plain[0][:place] + byte + plain[0][place + len(byte) :]
        found = list(warc.salvage(one_member([first, *plain[1:]])))
        assert ids(found) == [f"<urn:page:{j}>" for j in range(1, 6)] and len(gaps(found)) == 1


def test_a_cut_or_broken_member_gives_what_came_before():
    plain = make(6, 20)
    data = one_member(plain)
    after = warc.member(plain[5])
    found = list(warc.salvage(data[:-40]))
    assert ids(found) == [f"<urn:page:{j}>" for j in range(5)] and gaps(found)[-1].reason == "member without end"
    found = list(warc.salvage(data[:-6] + after + after))  # cut, and another file behind it
    assert ids(found)[-2:] == ["<urn:page:5>"] * 2 and ids(found)[:5] == [f"<urn:page:{j}>" for j in range(5)]
    broken = bytearray(data)
    broken[-8] ^= 0xFF  # the check sum alone
    found = list(warc.salvage(bytes(broken) + after))
    assert ids(found) == [f"<urn:page:{j}>" for j in (*range(6), 5)] and len(gaps(found)) == 1
    for k in range(len(data) // 2, len(data), 7):  # any byte: earlier records stay, nothing wrong is made up
        broken = bytes(data[:k]) + bytes([data[k] ^ 0x55]) + bytes(data[k + 1 :])
        found = list(warc.salvage(broken + after))
        good = {x.block for x in warc.salvage(b"".join(plain))}
        assert all(x.block in good for x in found if isinstance(x, warc.Record) and x.checked) and "<urn:page:0>" in ids(found) and ids(found)[-1] == "<urn:page:5>"


def test_time_grows_with_the_archive():
    """64 MB in many members, and as one: read in one pass."""
    import time

    rng = random.Random(1)
    pages = [warc.record(i, None, body, warc.base32_sha1(body), None) for i in range(2000) for body in [rng.randbytes(32 << 10)]]
    for data in (b"".join(map(warc.member, pages)), one_member(pages)):
        began = time.process_time()
        n = sum(isinstance(x, warc.Record) for x in warc.salvage(data))
        assert n == 2000 and len(data) > 60 << 20 and time.process_time() - began < 6


def test_round_trip_of_awkward_pages(spark):
    rows = [(3, "http://a b/", "same", 1), (1, None, "same", 1), (2, "u", None, 1), (5, "u", "", 1), (4, "u", "é" * 50, 1), (4, "u", "é" * 50, 1), (None, "u", "same", 1), (None, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long")
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    got = {}
    for r in warc.round_trip(pages, path).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to, r.payload_digest))
    digest = {h: warc.base32_sha1(h.encode()) for h in ("same", "", "é" * 50)}
    assert got[1] == [(4, "response", None, digest["same"])]
    assert got[3] == [(4, "revisit", 1, digest["same"])]
    assert got[2] == [(0, "response", None, digest[""])] and got[5] == [(0, "revisit", 2, digest[""])]
    assert got[4] == [(100, "response", None, digest["é" * 50])] * 2
    assert sorted(got[None]) == sorted([(4, "revisit", 1, digest["same"]), (0, "revisit", 2, digest[""])])
    assert warc.read_archives(spark, path).filter("kind = 'gap'").count() == 0
    text = {r.page_id: r.payload for r in warc.read_archives(spark, path, payload=True).collect() if r.record_type == "response"}
    assert text[1] == b"same" and text[4] == ("é" * 50).encode()


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, f"{stage_root(spark)}/{uuid.uuid4().hex}").count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(queries.ORACLES["op2_warc"]).fetchall()
    got = queries.op2_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
