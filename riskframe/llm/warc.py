"""WARC archives of web pages, and a reader that salvages damaged ones.

Writing: pages are spread over archives by a hash of the page, each page is one gzip member
holding one record. Payloads of ``MIN_REVISIT`` bytes or more that occur more than once are
stored with the smallest page_id; the other pages get revisit records that refer to it. A
task writes to a name of its own and renames the finished file, so a repeated task leaves
no half-written archive, and only archives named by finished tasks are read.

Reading: the file is read in pieces. A member is accepted when it inflates to its end, its
checksum holds, and the records in it have a version line, headers and as many block bytes as
they state, with the stated digest: md5, sha1, sha256, sha384 or sha512, in base 16 or 32. A
digest of another kind is not verified and the record accepted. After a failed check the reader
searches for the next member header or version line that leads to a valid record; the bytes
skipped are logged as a quarantined gap. A damaged member gives the records before the damage
and, as far as it inflates, those after the next version lines inside it. Its other bytes are
logged as a gap of inflated bytes inside it, and if it does not inflate to its end, the rest of
its bytes in the file as one too. Records outside gzip members are recovered too. Headers may be
of any length; a Content-Length that is no number of up to 18 digits fails the record, a Page-ID
that is no 64-bit integer comes back null.

Null html counts as an empty payload, null urls are left out of the record and come back
null. A null page_id comes back null; it never names a response that others revisit if the
group has other ids. Repeated pages (same id and payload) are all responses and share a record id. Other columns are not read. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
import hashlib
import re
from urllib.parse import quote, unquote
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.staging import new_path, stage

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20
_LENGTH = re.compile(r"[0-9]{1,18}")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

RECORD = "archive string, offset long, kind string, record_id string, page_id long, url string, refers_to string, " \
    "payload binary, payload_digest string, gap_bytes long, reason string"



def record(page_id: int | None, url: str | None, payload: bytes, digest: str, name: str, original: str | None) -> bytes:
    """One WARC record; with ``original`` a revisit without payload."""
    block = _HTTP + (b"" if original else payload)
    head = [
        ("WARC-Type", "revisit" if original else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # Only what cannot stand in a header line is changed, and comes back by unquoting.
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~ ")))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if original:
        head += [("WARC-Refers-To", original), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


_DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")


def digest_holds(stated: str, block: bytes) -> bool | None:
    """Whether a stated digest is the block's; None for an unknown algorithm or encoding."""
    algorithm, _, value = stated.partition(":")
    name, value = algorithm.strip().lower().replace("-", ""), value.strip()
    if name not in _DIGESTS:
        return None
    own = hashlib.new(name, block, usedforsecurity=False).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    value = value.rstrip("=").upper()
    b32 = base64.b32encode(own).decode().rstrip("=")
    return value == b32 if len(value) == len(b32) else None


def _head(raw: bytes, at: int) -> tuple[dict, int, bool]:
    """Header fields of the record at ``at``, where its block starts (0 if the headers do not end
    here), and whether more bytes could still end them.

    Headers have no size limit. A line that is no header ends the search, so it never goes
    beyond the next version line.
    """
    head: dict = {}
    line = raw.find(b"\r\n", at) + 2
    while True:
        end = raw.find(b"\r\n", line)
        if end < 0:
            return head, 0, True
        if end == line:
            return head, line + 2, False
        k, sep, v = raw[line:end].partition(b":")
        if not sep:
            return head, 0, False
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
        line = end + 2


def page_number(stated: str | None) -> int | None:
    """The page id that a header states; None when it states no 64-bit integer."""
    if stated is None or not re.fullmatch(r"-?[0-9]{1,19}", stated):
        return None
    n = int(stated)
    return n if -(1 << 63) <= n < 1 << 63 else None


def parse(raw: bytes, at: int = 0) -> tuple[dict | None, int]:
    """Record at ``at`` and the position after it; (None, reason code) when it fails."""
    if not raw.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n"), at):
        return None, 1
    head, start, _ = _head(raw, at)
    if not start or not _LENGTH.fullmatch(head.get("content-length", "")):
        return None, 2
    n = int(head["content-length"])
    block = raw[start:start + n]
    if len(block) < n or raw[start + n:start + n + 4] != b"\r\n\r\n":
        return None, 3
    holds = digest_holds(head.get("warc-block-digest", ""), block)
    if holds is False:
        return None, 4
    body = block.find(b"\r\n\r\n")
    head["verified"] = holds is True
    head["payload"] = block[body + 4:] if body >= 0 else block
    return head, start + n + 4


REASONS = {0: "damaged member", 1: "no version line", 2: "damaged headers", 3: "short record", 4: "digest differs"}


def salvage(read, size: int) -> Iterator[tuple[int, dict | None, int, str]]:
    """(offset, record or None, gap bytes, reason) from ``read(offset, n)`` in file order.

    Memory holds one member, or one record outside members, and one piece. A position that fails is left for the next
    start further on, so a damaged length can never swallow later records.
    """
    at = gap = 0
    reason = ""
    while at < size:
        found, after, code = _try(read, at, size)
        if found:
            if gap < at:
                yield gap, None, at - gap, reason
            for r, lost, why in found:
                yield at, r, lost, why
            gap = after
            if code is None:
                at = after
                continue
            # The break may lie behind the start of the next member.
            reason, at = REASONS[code], _next_start(read, at + 1, size)
            continue
        reason = reason if gap < at else REASONS[code]
        at = _next_start(read, at + 1, size)
    if gap < size:
        yield gap, None, size - gap, reason


def _next_start(read, at: int, size: int) -> int:
    while at < size:
        piece = read(at, _READ)
        m = _START.search(piece)
        if m:
            return at + m.start()
        # Starts may lie across two pieces.
        at += max(1, len(piece) - 9) if at + len(piece) < size else len(piece)
    return size


def _inflate(read, at: int, size: int, piece: bytes) -> tuple[bytes, int, str]:
    """The bytes of the member at ``at`` as far as they inflate, the position after them, and
    how it ended: "whole", "cut" (by the end of the file), "broken" or "checksum"."""
    z, out, pos = zlib.decompressobj(31), [], at
    while True:
        before = z.copy()
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            break
        pos += len(piece)
        if z.eof:
            return b"".join(out), pos - len(z.unused_data), "whole"
        if pos >= size:
            return b"".join(out), size, "cut"
        piece = read(pos, _READ)
    # An error loses the output of its call, so the piece is taken again in ever smaller steps.
    how = "broken"
    for step in (4096, 64, 1):
        while True:
            z = before.copy()
            try:
                made = z.decompress(piece[:step])
            except zlib.error as e:
                how = "checksum" if "incorrect" in str(e) and "check" in str(e) and "header" not in str(e) else "broken"
                break
            out.append(made)
            before, piece, pos = z, piece[step:], pos + step
    return b"".join(out), pos, how


def _inside(raw: bytes, trusted: bool) -> tuple[list[tuple[dict | None, int, str]], int]:
    """(record or None, gap bytes, reason) of a member's bytes in order, and the first reason code.

    Only records with a verified digest count when the bytes are not ``trusted``.
    """
    inner = gap = 0
    out, first = [], None
    reason = ""
    while inner < len(raw):
        one, after = parse(raw, inner)
        if one is not None and (trusted or one["verified"]):
            if gap < inner:
                out.append((None, inner - gap, reason))
            out.append((one, 0, ""))
            inner = gap = after
            continue
        code = 0 if one is not None else after
        first = code if first is None else first
        reason = reason if gap < inner else REASONS[code]
        m = _VERSION_LINE.search(raw, inner + 1)
        inner = m.start() if m else len(raw)
    if gap < len(raw):
        out.append((None, len(raw) - gap, reason))
    return out, first or 0


def _try(read, at: int, size: int) -> tuple[list[tuple[dict | None, int, str]], int, int | None]:
    """(record or None, gap bytes, reason) of the member or bare record at ``at``, the position
    after it, and a reason code if it is damaged there; an empty list if it holds no record."""
    first = read(at, 1 << 16)
    if first.startswith(b"\x1f\x8b\x08"):
        raw, after, how = _inflate(read, at, size, first)
        found, code = _inside(raw, how != "checksum")
        if not any(r for r, _, _ in found):
            return [], at, code if how == "whole" else 0
        return found, after, None if how == "whole" else 0
    if first.startswith(b"WARC/1."):
        raw = first
        head, start, open_end = _head(raw, 0)
        while open_end and len(raw) < size - at:
            raw = read(at, 4 * len(raw))
            head, start, open_end = _head(raw, 0)
        if not start or not _LENGTH.fullmatch(head.get("content-length", "")):
            return [], at, 2
        need = start + int(head["content-length"]) + 4
        if need > size - at:
            return [], at, 3
        one, after = parse(raw if len(raw) >= need else read(at, need))
        return ([(one, 0, "")], at + after, None) if one else ([], at, after)
    return [], at, 1


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    part = TaskContext.get().partitionId()
    done: list[tuple[str, int, int]] = []
    out, name, at, n = None, "", 0, 0

    def close() -> None:
        nonlocal out
        if out is not None:
            out.close()
            final = f"{base}/{name}.warc.gz"
            fs.move(f"{base}/{name}.open", final)
            done.append((f"{folder}/{name}.warc.gz", at, n))
            out = None

    for batch in batches:
        for r in batch.to_pylist():
            if out is None or at >= ARCHIVE_BYTES:
                close()
                name, at, n = f"pages-{part:06d}-{uuid.uuid4().hex}", 0, 0
                out = fs.open_output_stream(f"{base}/{name}.open", compression=None)
            raw = member(record(r["page_id"], r["url"], r["payload"], r["digest"], r["name"], r["original"]))
            out.write(raw)
            at += len(raw)
            n += 1
    close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
         pa.array([d[2] for d in done], pa.int64())], names=["archive", "bytes", "records"],
    )


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                   html: str = "html", partitions: int | None = None) -> DataFrame:
    """Write the pages; returns (archive, bytes, records), the list of finished archives."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("original_page"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("digest").alias("shared"), "original_page")
    )
    # Groups of copies: few or many, so the join is left to the planner.
    linked = rows.join(first, F.col("digest") == F.col("shared"), "left")
    return stage(
        linked.select(
            "page_id", "url", "payload", "digest",
            F.col("shared").isNotNull().alias("copied"), "original_page",
        )
        .select(
            "page_id", "url", "payload", "digest",
            _name(F.col("page_id"), F.col("digest")).alias("name"),
            F.when(F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("original_page")),
                   _name(F.col("original_page"), F.col("digest"))).alias("original"),
        )
        .mapInArrow(lambda b: _write(b, folder), "archive string, bytes long, records long"),
        "archives",
    )


def _name(page_id, digest):
    """A record id made of the page and its payload, in the form of a version 5 UUID."""
    h = F.sha1(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3),
        F.lit("-"), cut(21, 12), F.lit(">"),
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, local = _filesystem(path)
            rows: list[tuple] = []
            held = 0
            with fs.open_input_file(local) as f:
                size = f.size()
                for at, r, gap, reason in salvage(lambda o, n: f.read_at(n, o) if o < size else b"", size):
                    if r is None:
                        rows.append((path, at, "gap", None, None, None, None, None, None, gap, reason))
                    else:
                        where = r.get("warc-target-uri")
                        rows.append((
                            path, at, r.get("warc-type"), r.get("warc-record-id"), page_number(r.get("page-id")),
                            None if where is None else unquote(where), r.get("warc-refers-to"), r["payload"],
                            r.get("warc-payload-digest", "").removeprefix("sha256:"), None, None,
                        ))
                        held += len(r["payload"])
                    if held > (8 << 20) or len(rows) >= 2000:
                        yield _records(rows)
                        rows, held = [], 0
            if rows:
                yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(),
             pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of the archives in the column ``archive``; one task reads whole files."""
    spark = archives.sparkSession
    paths = archives.select("archive")
    spread = paths.repartition(spark.sparkContext.defaultParallelism * 4, "archive")
    return spread.mapInArrow(_read, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """One row per page read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are measured on the payload that was read; a revisit takes them from the
    record it refers to, and has nulls when that record was lost.
    """
    facts = stage(
        records.where(F.col("kind").isin("response", "revisit")).select(
            "record_id", "page_id", F.col("kind").alias("record_type"), F.col("refers_to").alias("original"),
            F.octet_length("payload").cast("bigint").alias("n"), F.sha2("payload", 256).alias("digest"),
        ),
        "records",
    )
    full = facts.where("record_type = 'response'").select(
        F.col("record_id").alias("original"), F.col("page_id").alias("refers_to"),
        F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
    ).dropDuplicates(["original"])
    again = facts.where("record_type = 'revisit'").join(full, "original", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    own = facts.where("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    return own.unionByName(again)
