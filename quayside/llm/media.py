"""Media columns: ISO base media containers in a binary column, described without decoding their payload.

``store`` writes any bytes as a track of 8-bit raw samples: a file type box, a movie box with the sample tables and a
media data box. ``probe`` walks the nested boxes of any such container, decodes the sample tables (times, sizes, chunks,
sync samples) and the runs of movie fragments, and gives codec, duration and the byte ranges of the keyframes of each
track; ``samples`` reads the payload back by those tables alone.

Containers come from anywhere: counts are cut down to what the boxes can hold before anything is made of them, samples that
take no place in a box stay one run, however many are declared, so what is held grows with the container's bytes alone,
and a table that gives more payload than the container has bytes gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import tokens as T

SAMPLE_BYTES = 4096  # bytes of payload that make a chunk
RATE = 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes, rate: int = RATE, chunk: int = SAMPLE_BYTES) -> bytes:
    """Container whose one track holds ``payload`` as 8-bit samples, one sample a byte, in chunks; no time of writing is
    kept, so equal payloads give equal bytes."""
    n = len(payload)
    chunks = -(-n // chunk)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    last = n - (chunks - 1) * chunk if chunks else 0
    runs = [] if not chunks else [(1, chunk, 1)] if last == chunk else ([(1, chunk, 1)] if chunks > 1 else []) + [(chunks, last, 1)]

    def movie(base: int) -> bytes:
        wide = base + n >= 1 << 32
        offsets = base + np.arange(chunks, dtype=np.int64) * chunk
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", 1 if n else 0), struct.pack(">II", n, 1) if n else b""),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", 1, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), media)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n & 0xFFFFFFFF, 0, 0, 0x0100, 0), _IDENTITY, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, n & 0xFFFFFFFF, 0x10000, 0x0100), _IDENTITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if n + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(movie(0)) + head
    base = len(ftyp) + len(movie(base)) + head  # a wide table may lengthen it once
    return ftyp + movie(base) + _box(b"mdat", payload)


def boxes(data: memoryview) -> Iterator[tuple[str, int, int, int]]:
    """(path, start, body start, body end) of every box, nested ones after their parent, at any depth. A path has the two
    outermost boxes, ``*`` for all between and the box itself. A box that says it is longer than its parent, or shorter
    than its head, ends the walk of that parent."""
    open_ = [(0, len(data), "")]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, start, body, start + size
        open_.append((start + size, end, path))
        if kind in _NESTED:
            deep = name.count("/")
            open_.append((body, start + size, name if deep < 3 else f"{path}/*" if deep == 3 else path))


def _table(data: memoryview, at: tuple[int, int] | None, width: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a full box that begins with a count; a count beyond the box's end is cut down to what is there."""
    if at is None or at[1] - at[0] < 8:
        return np.zeros((0, width), np.int64)
    n = struct.unpack_from(">I", data, at[0] + 4)[0]
    item = np.dtype(kind).itemsize * width
    n = min(n, (at[1] - at[0] - 8) // item)
    return np.frombuffer(data, kind, n * width, at[0] + 8).reshape(n, width).astype(np.int64)


def _numbers(data: memoryview, at: tuple[int, int], count: int, skip: int = 0) -> list[int]:
    """As many 32-bit numbers of a full box's body (after version and flags) as asked for and there."""
    count = max(0, min(count, (at[1] - at[0] - 4 - skip) // 4))
    return list(struct.unpack_from(f">{count}I", data, at[0] + 4 + skip))


def _track(view: memoryview, at: dict[str, tuple[int, int]]) -> dict:
    """Codec, handler, time scale, duration and sample tables of one ``trak`` box."""
    stsd, mdhd, hdlr, tkhd = (at.get(k) for k in ("stsd", "mdhd", "hdlr", "tkhd"))
    codec = bytes(view[stsd[0] + 12 : stsd[0] + 16]).decode("latin-1").strip() if stsd and stsd[1] - stsd[0] >= 16 else ""
    handler = bytes(view[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1") if hdlr and hdlr[1] - hdlr[0] >= 12 else ""
    scale = struct.unpack_from(">I", view, mdhd[0] + (20 if view[mdhd[0]] else 12))[0] if mdhd and mdhd[1] - mdhd[0] >= 24 else 0
    number = struct.unpack_from(">I", view, tkhd[0] + (20 if view[tkhd[0]] else 12))[0] if tkhd and tkhd[1] - tkhd[0] >= 24 else 0
    times = _table(view, at.get("stts"), 2)
    stsz = at.get("stsz")
    fixed, n = struct.unpack_from(">II", view, stsz[0] + 4) if stsz and stsz[1] - stsz[0] >= 12 else (0, 0)
    sizes = np.zeros(0, np.int64) if fixed or not n else np.frombuffer(view, ">u4", min(n, (stsz[1] - stsz[0] - 12) // 4), stsz[0] + 12).astype(np.int64)
    chunk = _table(view, at["co64"], 1, ">u8")[:, 0] if "co64" in at else _table(view, at.get("stco"), 1)[:, 0]
    runs = _table(view, at.get("stsc"), 3)
    # A run of chunks goes on up to the next one's first chunk.
    run = np.searchsorted(np.maximum.accumulate(runs[:, 0]), np.arange(1, len(chunk) + 1), side="right") - 1
    per = np.where(run >= 0, runs[run, 1], 0) if len(runs) else np.zeros(len(chunk), np.int64)
    reached = np.minimum(np.cumsum(per), n if fixed else len(sizes))
    per = np.diff(reached, prepend=0)
    if fixed:
        t = {"offsets": chunk, "sizes": np.minimum(per, len(view) // fixed + 1) * fixed, "counts": per}
    else:
        of = np.repeat(np.arange(len(chunk)), per)
        sums = np.concatenate(([0], np.cumsum(sizes)))
        t = {"offsets": chunk[of] + sums[: len(of)] - sums[(reached - per)[of]], "sizes": sizes[: len(of)], "counts": np.ones(len(of), np.int64)}
    sync = _table(view, at["stss"], 1)[:, 0] if "stss" in at else None
    ticks = int((times[:, 0].astype(float) * times[:, 1]).sum()) if len(times) and times.max() >= 1 << 31 else int((times[:, 0] * times[:, 1]).sum())
    whole = np.full(len(t["offsets"]), sync is None)
    return t | {"codec": codec, "handler": handler, "scale": scale, "number": number, "ticks": ticks, "n_samples": int(n), "sync": sync, "whole": whole}


def _fragment(view: memoryview, at: list[tuple[str, int, int]], moof: int, defaults: dict[int, list[int]]) -> tuple[int, dict[str, np.ndarray], int]:
    """Track number, runs of samples (``offsets``, ``sizes``, ``counts``, ``whole``) and ticks of one ``traf`` box."""
    number, base, duration, size, flags, ticks = 0, moof, 0, 0, 0, 0
    parts, at_byte = [], moof
    for kind, a, b in at:
        if b - a < 8:
            continue
        said = struct.unpack_from(">I", view, a)[0] & 0xFFFFFF
        if kind == "tfhd":
            number = struct.unpack_from(">I", view, a + 4)[0]
            duration, size, flags = defaults.get(number, [0, 0, 0])
            place = a + 8
            if said & 1 and place + 8 <= b:
                base, place = struct.unpack_from(">Q", view, place)[0] & (1 << 62) - 1, place + 8
            place += 4 * bool(said & 2)
            more = _numbers(view, (place - 4, b), 3)
            duration = more.pop(0) if said & 8 and more else duration
            size = more.pop(0) if said & 16 and more else size
            flags = more.pop(0) if said & 32 and more else flags
        elif kind == "trun":
            place, count = a + 8, struct.unpack_from(">I", view, a + 4)[0]
            at_byte = at_byte if parts else base
            if said & 1 and place + 4 <= b:
                at_byte, place = base + struct.unpack_from(">i", view, place)[0], place + 4
            first = flags
            if said & 4 and place + 4 <= b:
                first, place = struct.unpack_from(">I", view, place)[0], place + 4
            fields = [k for k in (0x100, 0x200, 0x400, 0x800) if said & k]
            if fields:
                count = min(count, (b - place) // (4 * len(fields)))
                rows = np.frombuffer(view, ">u4", count * len(fields), place).reshape(count, len(fields)).astype(np.int64)
                column = lambda k, value: rows[:, fields.index(k)] if k in fields else np.full(count, value, np.int64)  # noqa: E731, B023
                sizes, marks, each = column(0x200, size), column(0x400, flags), np.ones(count, np.int64)
                ticks += int(column(0x100, duration).sum())
            else:
                # Samples without fields of their own take no place in the box; they must then have bytes of the container.
                count = min(count, len(view) // size if size else 0)
                each = np.array([1, count - 1] if said & 4 and count > 1 else [count] * (count > 0), np.int64)
                sizes, marks = each * size, np.full(len(each), flags, np.int64)
                ticks += count * duration
            if len(each) and said & 4 and 0x400 not in fields:
                marks[0] = first
            reached = np.cumsum(sizes)
            parts.append({"offsets": at_byte + reached - sizes, "sizes": sizes, "counts": each, "whole": (marks & 0x10000) == 0})
            at_byte += int(reached[-1]) if len(reached) else 0
    return number, {k: np.concatenate([p[k] for p in parts]) for k in _RUNS} if parts else {}, ticks


_RUNS = ["offsets", "sizes", "counts", "whole"]


def tracks(data: bytes) -> list[dict]:
    """Codec, handler, time scale, duration and samples of each track, those of movie fragments included.

    Samples of one size in a chunk stay one run: ``offsets``, ``sizes`` and ``counts`` are per chunk for tables with a fixed
    size, else per sample (count 1). Keyframes are
    all samples of the runs that are ``whole``, and those that ``sync`` numbers from 1, if it is not None.
    """
    view = memoryview(data)
    found: list[dict[str, tuple[int, int]]] = []
    defaults: dict[int, list[int]] = {}
    parts: list[tuple[int, list[tuple[str, int, int]]]] = []
    moof = 0
    for name, start, a, b in boxes(view):
        if name == "/moov/trak":
            found.append({})
        elif name.startswith("/moov/trak/") and found:
            found[-1].setdefault(name.rpartition("/")[2], (a, b))
        elif name == "/moov/mvex/trex":
            number, *rest = (_numbers(view, (a, b), 5) + [0] * 5)[:5]
            defaults[number] = rest[1:]
        elif name == "/moof":
            moof = start
        elif name == "/moof/traf":
            parts.append((moof, []))
        elif name in ("/moof/traf/tfhd", "/moof/traf/trun") and parts:
            parts[-1][1].append((name[-4:], a, b))
    out = [_track(view, at) for at in found]
    by_number: dict[int, dict] = {}
    for t in out:
        by_number.setdefault(t["number"], t | {"more": [], "of": t})
    for start, at in parts:
        number, runs, ticks = _fragment(view, at, start, defaults)
        if number in by_number and runs and len(runs["offsets"]):
            by_number[number]["more"].append(runs)
            by_number[number]["of"]["n_samples"] += int(runs["counts"].sum())
            by_number[number]["of"]["ticks"] += ticks
    for held in by_number.values():
        for k in _RUNS:
            held["of"][k] = np.concatenate([held["of"][k], *(runs[k] for runs in held["more"])])
    return out


def keyframe_ranges(track: dict) -> list[tuple[int, int]]:
    """Byte ranges of the keyframes, neighbouring ones merged."""
    run = np.flatnonzero(track["whole"])
    starts, ends = track["offsets"][run], (track["offsets"] + track["sizes"])[run]
    if track["sync"] is not None:
        reached = np.cumsum(track["counts"])
        sync = track["sync"][track["sync"] > 0]
        at = np.searchsorted(reached, sync)
        sync, at = sync[at < len(reached)], at[at < len(reached)]
        one = track["sizes"][at] // np.maximum(track["counts"][at], 1)  # samples of a run have one size
        begin = track["offsets"][at] + (sync - 1 - (reached - track["counts"])[at]) * one
        order = np.argsort(np.concatenate((at, run)), kind="stable")
        starts, ends = np.concatenate((begin, starts))[order], np.concatenate((begin + one, ends))[order]
    if not len(starts):
        return []
    new = np.concatenate(([True], starts[1:] != ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[new].tolist(), ends[last].tolist()))


def samples(data: bytes, track: dict) -> bytes:
    """The payload of a track, by its tables; none if they give more bytes than the container has."""
    spans = [(o, min(o + s, len(data))) for o, s in zip(track["offsets"].tolist(), track["sizes"].tolist()) if 0 <= o < len(data)]
    return b"".join(data[a:b] for a, b in spans) if sum(b - a for a, b in spans) <= len(data) else b""


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (struct of the columns of ``docs``), ``n_bytes`` of the text in UTF-8 (null: empty) and ``media``: the
    container of those bytes, filled up with bytes 0 to a positive multiple of 64."""

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text):
                raw = [t.encode() for t in text.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], names=["doc", "n_bytes", "media"])

    packed = T.row_and_text(docs, text_col)
    return packed.mapInArrow(run, T.schema(packed, "doc", "n_bytes long, media binary"))


_RANGES = "array<struct<start:bigint,end:bigint>>"
_PROBE = f"codec string, time_scale long, duration double, n_samples long, keyframes {_RANGES}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tracks array<struct<codec:string,handler:string,time_scale:bigint,duration:double,n_samples:bigint,keyframes:{_RANGES}>>"
_RANGE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("time_scale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGE)]))
_KINDS = {
    "codec": pa.string(), "time_scale": pa.int64(), "duration": pa.float64(), "n_samples": pa.int64(), "keyframes": _RANGE, "payload_bytes": pa.int64(), "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "tracks": _TRACKS,
}
_NO_TRACK = {"codec": "", "time_scale": 0, "duration": 0.0, "n_samples": 0, "keyframes": []}


def describe(data: bytes) -> dict:
    """What ``probe`` says of one container."""
    found = tracks(data)
    every = [
        {"codec": t["codec"], "handler": t["handler"], "time_scale": t["scale"], "duration": t["ticks"] / t["scale"] if t["scale"] else 0.0, "n_samples": t["n_samples"], "keyframes": [{"start": a, "end": b} for a, b in keyframe_ranges(t)]}
        for t in found
    ]
    main = next((i for i, t in enumerate(found) if t["handler"] == "vide"), 0)
    body = samples(data, found[main]) if found else b""
    return (every[main] if found else _NO_TRACK) | {
        "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-64:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "tracks": every,
    }


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of ``media`` as ``row`` (a struct) and what the containers of ``column`` say of their main track:
    the first video track, else the first track. ``tracks`` has all of them.

    Null, empty or broken containers give an empty codec, no samples and no ranges. Repeated rows are reported each; an
    empty table gives no rows; columns keep their names inside ``row``, whatever they are.
    """
    T.bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                rows = [describe(m.as_py() or b"") for m in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _KINDS.items())], names=["row", *_KINDS])

    packed = media.select(F.struct(*(T.column(c) for c in media.columns if c != column)).alias("row"), T.column(column).alias("media"))
    return packed.mapInArrow(run, T.schema(packed, "row", _PROBE))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """All documents stored as media and read back."""
    held = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    seen = probe(held)
    spans = F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string")))
    feature = F.concat_ws("|", "codec", F.col("n_samples").cast("string"), F.format_string("%.6f", "duration"), F.array_join(spans, ";"))
    return seen.select(F.col("row.doc.doc_id").alias("doc_id"), F.col("row.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
