import gzip
import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import prose
from twinlens.llm import archives
from twinlens.llm.archives import base32, index_archives, read_payloads, write_archives
from twinlens.session import scratch_path

DDL = "side string, path long, url string, html string, record_type string, sha int"
ROWS = [
    (None, 5, "http://x/a b", "one"), ("target", 3, "http://x/é\n", "one"), ("source", 3, None, "one"), (None, None, "http://x", "one"), (None, 9, "u", None),
    (None, 8, "u", ""), ("source", 1, "u", "twice"), ("source", 1, "u", "twice"), (None, None, "a", "no path"), (None, None, "b", "no path"),
    (None, 2, "u", "é日本語 \r\n\r\n WARC/1.1"), (None, 4, "u", prose(1, 60_000)), (None, 7, "u", "\x1f\x8b\x08")
]
ROWS += [("source", 1000 + (i * 7919) % 500, f"http://h/{i}", "hot") for i in range(400)] + [("source", 5000 + i, f"http://h/{i}", f"page {i}") for i in range(150)]


def pages(spark, rows):
    """A page table with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL)


def brute(rows):
    groups = {}
    for i, (side, path, url, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((path is None, path or 0, side is not None, side or "", url is not None, url or "", i))
    first = {min(g)[-1]: None for g in groups.values()}
    out = []
    for i, (side, path, url, html) in enumerate(rows):
        raw = (html or "").encode()
        lead = rows[min(groups[html or ""])[-1]][1]
        kind = "response" if i in first else "revisit"
        out.append((side, path, len(raw), base32(hashlib.sha1(raw).digest()), kind, lead if kind == "revisit" else None))
    return sorted(out, key=repr)


def number(text):
    return None if text is None else int(text)


@pytest.mark.parametrize(("archive_bytes", "range_bytes"), [(1 << 30, 1 << 26), (4000, 700), (1 << 30, 301)])
def test_records_equal_brute_force(spark, archive_bytes, range_bytes):
    listing = write_archives(pages(spark, ROWS), scratch_path(spark, "archives"), archive_bytes=archive_bytes)
    assert listing.groupBy().sum("records").first()[0] == len(ROWS)
    found = index_archives(listing, range_bytes)
    rows = found.collect()
    assert sorted(((r["side"], number(r["path"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in rows), key=repr) == brute(ROWS)
    assert all(r["intact"] for r in rows)
    whole = read_payloads(found).collect()
    assert sorted(r["payload"].decode() for r in whole if r["payload"] is not None) == sorted({r[3] or "" for r in ROWS})


def test_archives_are_plain_gzip_with_one_member_a_record(spark):
    listing = write_archives(pages(spark, ROWS[:8]), scratch_path(spark, "archives")).collect()
    text = b"".join(gzip.open(r["archive"].removeprefix("file:")).read() for r in listing)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == 8
    assert b"WARC-Target-URI: http://x/a%20b\r\n" in text and b"http://x/%C3%A9%0A\r\n" in text
    assert b"WARC-Refers-To-Target-URI: u\r\n" in text and b"Content-Length: 3\r\n\r\none" in text


def test_an_empty_table_and_an_empty_listing(spark):
    listing = write_archives(pages(spark, []), scratch_path(spark, "archives"))
    assert listing.collect() == [] and index_archives(listing).collect() == []


def member(payload, level=6, date="1970-01-01T00:00:00Z", kind="resource"):
    block = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: u\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), len(payload)) + payload + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(block) + packer.flush()


def stored(spark, tmp_path, data):
    place = tmp_path / "some.warc.gz"
    place.write_bytes(data)
    return spark.createDataFrame([(f"file:{place}", len(data))], "archive string, bytes long")


@pytest.mark.parametrize("size", [97, 500, 1999, 1 << 20])
def test_archives_inside_payloads_are_not_taken_for_records(spark, tmp_path, size):
    made = random.Random(3)
    inner = b"".join(member(made.randbytes(made.randrange(40, 200)), 0, kind="inner") for _ in range(20))
    # A level of 0 leaves the inner members as they are, magic and all.
    outer = [member(inner, 0), member(b"x" * 300), member(inner + made.randbytes(300) + inner, 0), member(b""), member(made.randbytes(5000))]
    found = index_archives(stored(spark, tmp_path, b"".join(outer)), size).orderBy("offset").collect()
    ends = [sum(map(len, outer[: i + 1])) for i in range(len(outer))]
    assert [(r["offset"], r["next"], r["record_type"]) for r in found] == [(a, b, "resource") for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("size", [101, 1000, 1 << 20])
def test_damage_loses_one_record_only(spark, tmp_path, size):
    made = random.Random(5)
    parts = [member(made.randbytes(400)) for _ in range(9)]
    parts[4] = parts[4][:200] + b"\0" * 40 + parts[4][240:]
    tail = member(made.randbytes(400))[:-30]
    rows = index_archives(stored(spark, tmp_path, b"".join(parts) + tail), size).orderBy("offset").collect()
    starts = [sum(map(len, parts[:i])) for i in range(10)]
    whole = [r["offset"] for r in rows if r["record_type"] == "resource"]
    assert whole == [s for i, s in enumerate(starts) if i not in (4, 9)]
    assert [r["offset"] for r in rows if r["record_type"] == "damaged"] in ([starts[4], starts[9]], [starts[9]], [starts[4]], [])


def test_pieces_may_end_inside_the_magic(monkeypatch):
    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, pos):
            return self.data[pos : pos + n]

    data = b"\x1f\x8b" * 50 + member(b"found") + member(b"too")
    for piece in (3, 4, 5, 64):
        monkeypatch.setattr(archives, "PIECE", piece)
        source = archives.Source(File(data), len(data))
        assert archives.next_record(source, 0, len(data)) == 100
        rows = list(archives.scan_range(source, 1, len(data), None))
        assert [r[2]["payload_bytes"] for r in rows[:-1]] == [5, 3] and rows[-1] == (100, len(data), None)
