"""Web archives: legacy ARC files converted to WARC, and WARC records written to and read from archives.

An ARC file begins with a version block; its version says which fields the header line of each record has. The converter
cuts records by their declared lengths and synthesises what WARC asks for: a record identifier (name-based, so a second
run gives the same), a timestamp, a record type, block and payload digests. Records whose payload is that of another
become revisits of it; that decision is made over all records by a grouping on the digest.

Old archives are seldom whole. What can't be read becomes a row with a ``problem`` in place of an error that ends the job,
and reading goes on at the next header line or member.

Archives are rows of a table: a number and some megabytes of concatenated gzip members, one a record. Spark's own writer
commits them, so a task that runs again leaves no half-written archive, and any store that Spark can write will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize
from quayside.llm import tokens as T

ARCHIVE_BYTES = 4 << 20
#: Fields of a record's header line by ARC version, and the first lines of a version block.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_SPACE = re.compile(rb"[\x00-\x20\x7f]")
_LENGTH = re.compile(rb"[0-9]{1,18}")
_DATE = re.compile(rb"[0-9]{1,14}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_NAMES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[k] for k in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: bytes, date: str, mime: str, block: bytes, name: str, offset: int) -> bytes:
    """One record; white space and control bytes of the URL are percent-encoded, as the header line needs."""
    clean = _SPACE.sub(lambda m: b"%%%02X" % m.group(0)[0], url) or b"about:blank"
    fields = {"ip": b"0.0.0.0", "date": date.encode(), "type": mime.encode(), "status": b"200", "checksum": b"-", "location": b"-", "offset": str(offset).encode(), "filename": name.encode(), "length": str(len(block)).encode()}
    return b" ".join(clean if k == "url" else fields[k] for k in ARC_FIELDS[version]) + b"\n" + block + b"\n"


def _header(line: bytes, fields: list[bytes]) -> list[bytes] | None:
    """Fields of a header line, or None. Blanks beyond those that the version has belong to the URL or, as in ``text/html;
    charset=utf-8``, to the content type."""
    parts = line.rstrip(b"\r").split(b" ")
    extra, date, kind = len(parts) - len(fields), fields.index("date"), fields.index("type")
    if extra < 0 or not _LENGTH.fullmatch(parts[-1]):
        return None
    dated = (k for k in range(extra + 1) if _DATE.fullmatch(parts[k + date]))
    of_url = next(dated, None)
    if of_url is None:
        return parts if not extra else None
    of_type = extra - of_url
    url, mime = b" ".join(parts[: of_url + 1]), b" ".join(parts[of_url + kind : of_url + kind + 1 + of_type])
    return [url, *parts[of_url + 1 : of_url + kind], mime, *parts[of_url + kind + 1 + of_type :]]


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file but its version block. ``truncated`` marks one whose declared length goes beyond the end.

    A line that is no header line of the file's version, where one should stand, gives a record whose ``problem`` says so
    (None elsewhere) and whose block is what is passed over up to the next header line. A missing or unknown version block
    gives one such record for the whole file.
    """
    at, fields, passed = 0, None, None

    def lost(upto: int) -> dict:
        return {"url": "", "date": "", "type": "", "block": data[passed:upto], "truncated": False, "problem": "not a header line of the version"}

    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        if fields is None:
            parts = data[at:end].rstrip(b"\r").split(b" ")
            body = data[end + 1 : end + 2]
            if not parts[0].startswith((b"filedesc://", b"dns:filedesc")) or not _LENGTH.fullmatch(parts[-1]) or body not in (b"1", b"2"):
                yield {"url": "", "date": "", "type": "", "block": data, "truncated": False, "problem": "no version block of a known version"}
                return
            fields, at = ARC_FIELDS[int(body)], end + 1 + int(parts[-1])
            continue
        parts = _header(data[at:end], fields)
        if parts is None:
            passed, at = at if passed is None else passed, end + 1
            continue
        if passed is not None:
            yield lost(at)
            passed = None
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        yield dict(zip(fields, (p.decode("utf-8", "replace") for p in parts))) | {"block": block, "truncated": len(block) < length, "problem": None}
        at = end + 1 + length
    if passed is not None:
        yield lost(len(data))


def warc_date(arc: str) -> str:
    """``yyyymmddhhmmss`` (or its head) as an ISO timestamp; anything else as the epoch."""
    digits = arc if re.fullmatch("[0-9]{4,14}", arc) else "19700101000000"
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def synthesise(record: dict) -> dict:
    """What WARC asks of an ARC record: type, identifier, date, HTTP head and payload, digests."""
    block, url = record["block"], record["url"]
    http = block.startswith(b"HTTP/")
    head, mark, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    kind = "response" if http else "resource"
    name = f"{url} {record['date']} {base32_sha1(block)}"
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "type": kind, "uri": url, "date": warc_date(record["date"]), "mime": record["type"],
        "head": head + mark, "payload": payload, "payload_digest": base32_sha1(payload), "truncated": record["truncated"], "problem": record["problem"],
    }


_RECORD = "record_id string, type string, uri string, date string, mime string, head binary, payload binary, payload_digest string, truncated boolean, problem string"
_RECORD_PA = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _RECORD.split(", "))])


def convert_arc(arcs: DataFrame, column: str = "arc") -> DataFrame:
    """WARC records of ARC files in a binary column, all as responses or resources so far. Null and empty files have none;
    what can't be read is a record with a ``problem``. Repeated files are read each; other columns are not looked at."""

    T.bound_batches(arcs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [synthesise(r) for r in parse_arc(data.as_py() or b"")]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_PA)

    return arcs.select(T.column(column).alias("arc")).mapInArrow(run, _RECORD)


def mark_revisits(records: DataFrame, rank: F.Column, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers_to``: of those with equal payloads of at least ``least_bytes``, the record of the highest
    ``rank`` stays and the others refer to it; rows that share the highest rank all stay. A null rank is the lowest. An empty table
    gives no rows; further columns stay, whatever their names."""
    held, top = (T.unused_name(name, records.columns) for name in ("rank", "best"))
    ranked = records.withColumn(held, rank)
    best = F.max(F.struct(F.col(held).isNotNull().alias("known"), F.col(held).alias("rank"), "record_id")).alias(top)
    best = ranked.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(best)
    joined = ranked.join(best.hint("shuffle_merge"), "payload_digest", "left")
    other = F.col(top).isNotNull() & ~F.col(held).eqNullSafe(F.col(f"{top}.rank"))
    return joined.withColumn("refers_to", F.when(other, F.col(f"{top}.record_id"))).select(*(T.column(c) for c in records.columns if c != "refers_to"), "refers_to")


def _warc_record(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['type']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['refers_to']}>"]
    if r["truncated"]:
        lines.append("WARC-Truncated: length")
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"Content-Type: {'application/http; msgtype=response' if r['head'] else r['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(records: DataFrame, name: str = "warc", level: int = 4) -> DataFrame:
    """Write records as archives (rows ``archive long, warc binary``) into the scratch folder and return that table."""

    T.bound_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in (r for a in range(0, batch.num_rows, 256) for r in batch.slice(a, 256).to_pylist()):
                member = _gzip(_warc_record(row), level)
                held.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["warc"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["warc"])

    return materialize(records.mapInArrow(run, "warc binary").select(F.monotonically_increasing_id().alias("archive"), "warc"), name, compression="none")


#: Bytes of one unpacked record; a longer one is given up to there, with a problem.
MEMBER_BYTES = 128 << 20
_STEP = 1 << 13
_MEMBER = b"\x1f\x8b\x08"


def _members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Each gzip member's bytes. After a damaged one, with what could be read of it, the next mark of a member is sought. Of
    a member of more than MEMBER_BYTES no more is kept, but its end is found all the same."""
    at = 0
    while at < len(data):
        start, parts, size, problem = at, [], 0, None
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(data):  # a step at a time, as what a member leaves unused is copied
                part = d.decompress(data[at : at + _STEP])
                if size < MEMBER_BYTES:
                    parts.append(part[: MEMBER_BYTES - size])
                size += len(part)
                at = min(at + _STEP, len(data))
            at -= len(d.unused_data)
        except zlib.error:
            problem = "damaged member"
        if not d.eof and problem is None:
            problem = "member without an end"
        if problem:
            at = data.find(_MEMBER, start + 1)
            at = len(data) if at < 0 else at
        elif size > MEMBER_BYTES:
            problem = "member larger than MEMBER_BYTES"
        yield b"".join(parts), problem


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names lower-cased), block and problem (None: none) of each gzip member's record; the block's length
    and digest are checked."""
    for raw, problem in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        known = re.fullmatch("[0-9]{1,18}", length)
        block = rest[: int(length)] if known else b""
        if not problem and (not lines[0].startswith("WARC/") or not known or "warc-type" not in fields):
            problem = "not a WARC record"
        if not problem and len(block) < int(length):
            problem = "block shorter than its length"
        if not problem and fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            problem = "block differs from its digest"
        yield fields, block, problem


_READ = "record_id string, type string, uri string, date string, refers_to string, head binary, payload binary, payload_digest string, problem string"
_READ_PA = pa.schema([(n, pa.binary() if t == "binary" else pa.string()) for n, t in (x.split() for x in _READ.split(", "))])


def read_archives(archives: DataFrame, column: str = "warc", *, payloads: bool = True) -> DataFrame:
    """Records of archives in a binary column (a table of archives, or files read with ``binaryFile``). A payload's digest
    is computed anew from its bytes; a revisit has the digest of its header and no payload. A record that can't be read
    whole has a ``problem`` and what could be read. Null and empty archives have no records; repeated ones are read each;
    other columns are not looked at."""
    keep_payload = payloads

    T.bound_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for f, block, problem in parse_warc(data.as_py() or b""):
                    head, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    revisit = f.get("warc-type") == "revisit"
                    rows.append({
                        "record_id": f.get("warc-record-id", "").strip("<>"), "type": f.get("warc-type"), "uri": f.get("warc-target-uri"), "date": f.get("warc-date"),
                        "refers_to": f.get("warc-refers-to", "").strip("<>") if revisit else None, "head": head + mark, "payload": None if revisit else payload if keep_payload else b"",
                        "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload), "problem": problem,
                        "payload_bytes": None if revisit else len(payload),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_PA.append(pa.field("payload_bytes", pa.int64())))

    return archives.select(T.column(column).alias("warc")).mapInArrow(run, _READ + ", payload_bytes long")


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, date: str = "20240101000000") -> DataFrame:
    """Pages as legacy ARC files (``arc`` binary), versions 1 and 2 in turn; the page's number is a header of its HTTP
    response. Null pages are empty, null URLs ``about:blank``, null numbers leave the header out."""

    T.bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            html = T.filled(batch.column(2))
            url = T.filled(batch.column(1))
            for a, b in T.slices(html, ARCHIVE_BYTES):
                version, name = 1 + k % 2, f"part-{k}.arc"
                parts = [arc_version_block(version, name, date)]
                size = len(parts[0])
                for number, u, h in zip(batch.column(0).slice(a, b - a).to_pylist(), url.slice(a, b - a).to_pylist(), html.slice(a, b - a).to_pylist()):
                    mark = b"" if number is None else b"X-Page-Number: %d\r\n" % number
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n" + h.encode()
                    parts.append(arc_record(version, u.encode(), date, "text/html", block, name, size))
                    size += len(parts[-1])
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["arc"])

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, "arc binary")


def page_number(head: str = "head") -> F.Column:
    digits = F.regexp_extract(F.decode(F.col(head), "ISO-8859-1"), r"X-Page-Number: (-?\d+)", 1)
    return F.when(digits != "", digits.cast("long"))


def op2_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through ARC files into WARC archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = convert_arc(pages_to_arc(pages))
    archives = write_archives(mark_revisits(records.where("problem is null"), page_number()))
    read = read_archives(archives, payloads=False).select("record_id", page_number().alias("page_id"), "type", "payload_bytes", "payload_digest", "refers_to")
    whole = read.where("type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("of_page"), F.max("payload_bytes").alias("of_bytes"))
    back = read.join(whole.hint("shuffle_merge"), "refers_to", "left")
    return back.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))
