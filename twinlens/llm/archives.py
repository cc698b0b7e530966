"""Web archives (WARC) of captured pages: written once per distinct payload, and read back in byte ranges.

Each record is a gzip member of its own. A range task looks for the gzip magic, takes a candidate for a record if a WARC
head decodes from it, and owns the records that start inside its range. A payload may hold whole members of another
archive, so where a range began is compared with where the range before it ended, and a range that began wrongly is read
again from the right place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import keep, schema
from twinlens.session import _file_system

SALTS = 64
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 64 << 20
PIECE = 1 << 20
HEAD_BYTES = 1 << 16
MOST_TASKS = 20_000
# Fixed values of the file formats.
MAGIC = b"\x1f\x8b\x08"
GZIP = 31
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT, DAMAGED = "response", "revisit", "damaged"

LISTING = schema(("archive", "string"), ("bytes", "long"), ("records", "long"))
_FOUND = (
    ("record_type", "string"), ("side", "string"), ("path", "string"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"),
    ("refers_to", "string"), ("intact", "boolean"),
)
_SCANNED = schema(("archive", "string"), ("start", "long"), ("end", "long"), ("bytes", "long"), ("is_range", "boolean"), ("offset", "long"), ("next", "long"), *_FOUND)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(':'.join(map(str, parts)).encode()).digest()[:16])}>"


def _uri(url: str) -> str:
    """The address as a head line can hold it: no blanks, no control and no non-ASCII characters."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(row: dict, date: str) -> bytes:
    """One record as a gzip member, from a row of `write_archives`."""
    head = {"WARC-Type": row["record_type"]}
    if row["record_type"] == REVISIT:
        head["WARC-Record-ID"] = _record_id(row["sha"].hex(), row["row"])
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(row["sha"].hex())}
        if row["first_url"] is not None:
            head["WARC-Refers-To-Target-URI"] = _uri(row["first_url"])
        if row["first_path"] is not None:
            head["X-Refers-To-Path"] = quote(row["first_path"], safe="/")
    else:
        head["WARC-Record-ID"] = _record_id(row["sha"].hex())
    head["WARC-Date"] = date
    for name, value in (("WARC-Target-URI", row["url"] and _uri(row["url"])), ("X-Capture-Side", row["side"] and quote(row["side"])), ("X-Capture-Path", row["path"] and quote(row["path"], safe="/"))):
        if value is not None:
            head[name] = value
    payload = b"" if row["record_type"] == REVISIT else row["html"].encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['length']}\r\n\r\n".encode() + payload
    head["WARC-Payload-Digest"] = "sha1:" + base32(row["sha1"])
    head |= {"WARC-Block-Digest": "sha1:" + base32(hashlib.sha1(block).digest()), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _store(place: str):
    """The file system of a place that the session has qualified, and the place in it."""
    from pyarrow import fs

    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place[5:].lstrip("/")
    return fs.FileSystem.from_uri(place)


def _write(folder: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(folder)
        out, size, records, name = None, 0, 0, ""

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [records]}, schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    # Each attempt of a task has a name of its own; only what the listing names is ever read.
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = record(batch.slice(i, 1).to_pylist()[0], date)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    return write


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write captured pages as archives into `folder` and return the listing: `archive, bytes, records`.

    `pages` holds `side`, `path` (any orderable type), `url` and `html`; other columns are ignored. Each row becomes one
    record, its payload the html in UTF-8 (null: empty). Of rows with equal payloads the one with the smallest path is a
    `response`; the others are a `revisit` of it and hold no payload. A null path comes after all others; ties are settled
    by side and url (nulls first), and of rows equal in all of it one is the response. Null sides, paths and urls leave
    their head line out. The tables have no time of capture, so `date` is every record's.

    `folder` must be one that all executors reach. A task that is run again writes new files; those the listing does not
    name are never read. Payloads are compared by SHA-256; only distinct ones are shuffled, revisits are built from
    narrow rows, joined with salt so that a payload of a third of all pages is dealt to many tasks. An empty table writes
    nothing and lists nothing.
    """
    spark = pages.sparkSession
    system, place = _file_system(spark, folder)
    system.mkdirs(place)
    whole = system.makeQualified(place).toString()
    sha = F.unhex(F.sha2("html", 256)).alias("sha")
    raw = pages.select(F.col("side").cast("string").alias("side"), "path", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    order = [F.col("path").isNull().alias("late"), F.col("path"), F.col("side"), F.col("url")]
    about = [F.unhex(F.sha1("html")).alias("sha1"), F.octet_length("html").cast("long").alias("length")]
    slim = keep(raw.select(sha, *about, "side", "path", "url", F.monotonically_increasing_id().alias("row")))
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    firsts = slim.groupBy("sha", "salt").agg(F.min(F.struct(*order, "row")).alias("first"))
    # At most SALTS values a payload; each salt that occurs gets its copy of the payload's first row.
    firsts = firsts.groupBy("sha").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts")).select("sha", "first", F.explode("salts").alias("salt"))
    again = slim.join(firsts, ["sha", "salt"]).filter(F.col("row") != F.col("first.row"))
    text = lambda c: F.col(c).cast("string")
    revisits = again.select(
        F.lit(REVISIT).alias("record_type"), "sha", "sha1", "length", "side", text("path").alias("path"), "url", "row",
        text("first.path").alias("first_path"), F.col("first.url").alias("first_url"), F.lit(None).cast("string").alias("html"),
    )
    heads = raw.groupBy(sha).agg(F.min(F.struct(*order)).alias("first"), F.first("html").alias("html"))
    nothing = F.lit(None).cast("string")
    responses = heads.select(
        F.lit(RESPONSE).alias("record_type"), "sha", *about, F.col("first.side").alias("side"), text("first.path").alias("path"), F.col("first.url").alias("url"),
        F.lit(None).cast("long").alias("row"), nothing.alias("first_path"), nothing.alias("first_url"), "html",
    )
    return keep(responses.unionByName(revisits).mapInArrow(_write(whole, date, archive_bytes), LISTING))


class Damaged(ValueError):
    """A member that does not decode to its end, or holds no record."""


class Source:
    """A file read in pieces of a MB, the last one kept."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.low, self.held = file, size, 0, b""

    def piece(self, pos: int) -> memoryview:
        """Bytes from `pos` on, at least one unless the file ends there."""
        if not self.low <= pos < self.low + len(self.held):
            self.low, self.held = pos, self.file.read_at(min(PIECE, max(0, self.size - pos)), pos)
        return memoryview(self.held)[pos - self.low :]


class Member:
    """The decoded bytes of one gzip member, a part at a time; `end` is set when all are out."""

    def __init__(self, source: Source, pos: int) -> None:
        self.source, self.pos, self.end = source, pos, None
        self.unpack = zlib.decompressobj(GZIP)

    def more(self) -> bytes:
        """The next decoded bytes; none when the member is over."""
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail
            if not data:
                data = self.source.piece(self.pos)
                if not len(data):
                    raise Damaged("the file ends inside a record")
                self.pos += len(data)
            try:
                out = self.unpack.decompress(data, PIECE)
            except zlib.error as error:
                raise Damaged(str(error)) from error
            if out:
                return out
        self.end = self.pos - len(self.unpack.unused_data)
        return b""

    def until(self, held: bytes, stop: bytes) -> tuple[bytes, bytes]:
        """What stands before `stop`, a head of bounded size, and the decoded bytes after it."""
        while (at := held.find(stop)) < 0:
            more = self.more() if len(held) < HEAD_BYTES else b""
            if not more:
                raise Damaged("a head does not end")
            held += more
        return held[:at], held[at + len(stop) :]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def read_head(source: Source, pos: int) -> tuple[Member, dict[str, str], bytes]:
    member = Member(source, pos)
    held = b""
    while len(held) < len("WARC/1.") and (more := member.more()):
        held += more
    if not held.startswith(b"WARC/1."):
        raise Damaged("no record starts here")
    head, rest = member.until(held, b"\r\n\r\n")
    return member, _fields(head), rest


def read_record(source: Source, pos: int, payload: list[bytes] | None = None) -> tuple[dict, int]:
    """The record at `pos` as a row, and where the next one starts. The payload's bytes go to `payload` if it is given."""
    member, head, held = read_head(source, pos)
    try:
        left = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no length") from None
    http: dict[str, str] = {}
    if head.get("content-type", "").startswith("application/http"):
        before = member.until(held, b"\r\n\r\n")
        http, left, held = _fields(before[0]), left - len(before[0]) - 4, before[1]
    digest, size = hashlib.sha1(), 0
    if left and not held:
        held = member.more()
    while held and left > size:
        part = held[: left - size]
        digest.update(part)
        size += len(part)
        if payload is not None:
            payload.append(part)
        held = held[len(part) :] or (member.more() if size < left else b"")
    if size != left:
        raise Damaged("a record is shorter than its length")
    while member.end is None:
        member.more()
    told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = head.get("warc-type")
    decoded = lambda name: unquote(head[name]) if name in head else None
    row = {"record_type": kind, "side": decoded("x-capture-side"), "path": decoded("x-capture-path"), "url": head.get("warc-target-uri")}
    if kind == REVISIT:
        length = http.get("content-length", "")
        row |= {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": told, "refers_to": decoded("x-refers-to-path"), "intact": told is not None}
    else:
        found = base32(digest.digest())
        row |= {"payload_bytes": size, "payload_digest": found, "refers_to": None, "intact": told in (None, found)}
    return row, member.end


def next_record(source: Source, pos: int, end: int) -> int | None:
    """The first place from `pos` on and before `end` where the magic stands and a record's head decodes."""
    while pos < end:
        piece = bytes(source.piece(pos))
        if len(piece) < len(MAGIC) and pos + len(piece) < source.size:
            source.held = b""
            continue
        at = piece.find(MAGIC)
        if at < 0:
            pos += max(1, len(piece) - len(MAGIC) + 1)
            continue
        pos += at
        if pos >= end:
            return None
        try:
            read_head(source, pos)
            return pos
        except Damaged:
            pos += 1
    return None


def scan_range(source: Source, start: int, end: int, begin: int | None) -> Iterator[tuple[int | None, int | None, dict | None]]:
    """Offset, next offset and row of each record that starts in the range; last, without a row, where the first one began and the place after the last.

    `begin` is where the first one starts if that is known. After damage the scan goes on at the next candidate, and
    where nothing certain follows, the place after the last is unknown.
    """
    first = pos = begin if begin is not None else 0 if start == 0 else next_record(source, start, end)
    sure = begin is not None or start == 0
    while pos is not None and pos < end:
        try:
            row, after = read_record(source, pos)
        except Damaged:
            # A member that others led to is a record lost; what only looked like one is none.
            if sure:
                yield pos, None, {"record_type": DAMAGED, "intact": False}
            elif first == pos:
                first = None
            pos, sure = next_record(source, pos + 1, end), False
            first = pos if first is None else first
            continue
        yield pos, after, row
        pos, sure = after, True
        if pos >= source.size:
            break
    yield first if first is not None and first < end else None, pos, None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _SCANNED.names
    types = pa.schema([(f.name, {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[f.dataType]) for f in _SCANNED.fields])
    rows: list[dict] = []

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=types)
        rows.clear()
        return out

    for batch in batches:
        for task in batch.to_pylist():
            system, place = _store(task["archive"])
            with system.open_input_file(place) as file:
                source = Source(file, task["bytes"])
                for offset, after, row in scan_range(source, task["start"], task["end"], task["begin"]):
                    rows.append(task | {"is_range": row is None, "offset": offset, "next": after} | (row or {}))
                    if len(rows) >= 4096:
                        yield packed()
    yield packed()


def _scanned(ranges: DataFrame) -> DataFrame:
    tasks = max(1, min(MOST_TASKS, ranges.count()))
    return keep(ranges.repartition(tasks).mapInArrow(_scan, _SCANNED))


def index_archives(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives, from byte ranges read in parallel.

    `listing` holds `archive` and `bytes`, as `write_archives` returns it; other columns are ignored. Returns `archive,
    offset, next, record_type, side, path, url, payload_bytes, payload_digest, refers_to, intact`: the digest is the
    bare base32 SHA-1, of the payload as decoded for whole records and as told by a revisit; `intact` says whether the
    payload has the digest its head tells. Kinds other than responses and revisits are returned as they are; a record that does not decode
    is a row of type `damaged` with its offset, and reading goes on at the next one. `path` and `side` are text, null where
    the record has none. An archive listed twice is read once. An empty listing, or an empty file, returns no rows.

    A range that starts inside a payload which itself holds archive members may begin at one of those. So the beginning
    of each range is compared with the end of the ranges before it, and wrong ones are read again until all agree.
    """
    files = listing.filter("bytes > 0").groupBy("archive").agg(F.max("bytes").alias("bytes"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("archive", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    found = _scanned(ranges.withColumn("begin", F.lit(None).cast("long")))
    earlier = Window.partitionBy("archive").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        due = found.filter("is_range").withColumn("begin", F.max("next").over(earlier))
        # No record may begin in a range that an earlier record covers. The first wrong range is right after this round, and stays so.
        right_place = F.when(F.col("begin") < F.col("end"), F.col("begin"))
        wrong = keep(due.filter((F.col("begin") >= F.col("start")) & ~F.col("offset").eqNullSafe(right_place)).select("archive", "start", "end", "bytes", "begin"))
        if wrong.isEmpty():
            break
        right = found.join(wrong.select("archive", "start"), ["archive", "start"], "left_anti")
        found = keep(right.unionByName(_scanned(wrong)))
    return found.filter(~F.col("is_range")).select("archive", "offset", "next", *[n for n, _ in _FOUND])


def _payloads(names: list[str]):
    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened, source = None, None
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                archive, offset, kind = (row.column(c)[0].as_py() for c in ("archive", "offset", "record_type"))
                html = None
                if kind not in (REVISIT, DAMAGED):
                    if archive != opened:
                        system, place = _store(archive)
                        file = system.open_input_file(place)
                        opened, source = archive, Source(file, file.size())
                    parts: list[bytes] = []
                    read_record(source, offset, parts)
                    html = b"".join(parts)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([html], pa.binary())], names=[*names, "payload"])

    return payloads


def read_payloads(records: DataFrame) -> DataFrame:
    """Add `payload`, the bytes of each record of `index_archives`; null for revisits and damaged records.

    Rows are read in the order given, so sort by archive and offset within partitions if they have been shuffled. A
    column `payload` of the input is replaced.
    """
    rows = records.drop("payload")
    return rows.mapInArrow(_payloads(rows.columns), schema(*[(f.name, f.dataType) for f in rows.schema], ("payload", "binary")))
