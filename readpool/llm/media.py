"""Media columns: index ISO media containers (nested boxes and sample tables) without decoding payloads.

`media_columns` adds to a table with a binary column the container's brand, its tracks with codec, duration
and dimensions, and the byte range of every keyframe. `text_movies` is the writer used by the query: it
stores bytes losslessly as 8-bit monochrome frames.

Defined results: a null blob has status `null`; bytes without a whole `moov` or `moof` box have status `no_media` and no
tracks; where one was found, a later box that runs past its parent, a sample table that does or makes no sense (counts beyond
what the blob can hold, chunks out of order), or boxes nested deeper than MAX_DEPTH give status `truncated`, and what was read
before is kept. Work and memory for a blob are bounded by its length. Texts: null and empty ones are one frame of padding;
repeated rows are rows of their own with equal values; a text of any length is one movie; other columns stay, whatever their
names, but for `out_col`, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpool.llm import common

FRAME = 576  # 24 x 24 samples of 8 bits
WIDTH = HEIGHT = 24
TIMESCALE = 25
GOP = 12
SAMPLES_PER_CHUNK = 32
PAD = 255

#: The boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 64  # of nested boxes: deeper ones give status `truncated`

TRACK = (
    "struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,width:int,height:int,"
    "n_samples:bigint,keyframes:array<struct<sample:bigint,time:bigint,start:bigint,size:bigint>>>"
)
MEDIA = f"struct<status:string,brand:string,timescale:bigint,duration:bigint,tracks:array<{TRACK}>>"


# --- writing ---------------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_movie(payload: bytes) -> bytes:
    """A movie of one raw 8-bit track; `payload` is a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    chunks, tail = divmod(n, SAMPLES_PER_CHUNK)
    runs = ([(1, SAMPLES_PER_CHUNK, 1)] if chunks else []) + ([(chunks + 1, tail, 1)] if tail else [])
    chunks += bool(tail)
    keys = range(1, n + 1, GOP)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16),
        struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1),
    )

    def moov(first: int) -> bytes:
        starts = range(first, first + chunks * SAMPLES_PER_CHUNK * FRAME, SAMPLES_PER_CHUNK * FRAME)
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, n)),
            full_box(b"co64", struct.pack(f">I{chunks}Q", chunks, *starts)),
        )
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        hdlr = full_box(b"hdlr", bytes(4), b"vide", bytes(13))
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = ftyp + moov(len(ftyp) + len(moov(0)) + 8)
    return head + box(b"mdat", payload)


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % FRAME if data else FRAME)


# --- reading ---------------------------------------------------------------------------------------------


class Truncated(Exception):
    pass


DAMAGE = (struct.error, IndexError, KeyError, ValueError, OverflowError)  # what reading tables that make no sense ends with


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, start and end of the body) of each box between two offsets."""
    while start < end:
        if end - start < 8:
            raise Truncated
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Truncated
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            raise Truncated
        yield kind, start, body, start + size
        start += size


def numbers(data: memoryview, at: int, end: int, count: int, dtype: str) -> np.ndarray:
    if count * np.dtype(dtype).itemsize > end - at:
        raise Truncated
    return np.frombuffer(data, dtype, count, at).astype(np.int64)


def repeated(data: memoryview, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a run-length table, such as stts."""
    (n,) = struct.unpack_from(">I", data, at)
    x = numbers(data, at + 4, end, 2 * n, ">u4").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def walk(data: memoryview) -> dict:
    """All that a container's boxes say; `samples` of a track is an array of (start, size, time, is keyframe)."""
    out = {"status": "no_media", "brand": None, "timescale": None, "duration": None, "tracks": []}
    defaults: dict[int, tuple[int, int, int]] = {}
    reach = [0]  # where the data of the last run of the fragment ends

    def header(at: int, end: int) -> tuple[int, int, int]:
        """(time scale, duration, offset after them) of mvhd and mdhd."""
        wide = data[at] == 1
        if end - at < (32 if wide else 20):
            raise Truncated
        return (*struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12)), at + (32 if wide else 20))

    def visit(start: int, end: int, track: dict | None, depth: int, moof: int) -> None:
        for kind, head, at, stop in boxes(data, start, end):
            if kind == b"trak":
                track = {"tables": {}, "samples": []}
                out["tracks"].append(track)
            if kind in (b"moov", b"moof"):
                out["status"], moof = "ok", head
                reach[0] = head
            if kind == b"traf":
                track = None
            if kind in CONTAINERS:
                if depth == MAX_DEPTH:
                    raise Truncated
                visit(at, stop, track, depth + 1, moof)
                continue
            if kind == b"ftyp" and stop - at >= 4:
                out["brand"] = bytes(data[at : at + 4]).decode("latin-1")
            elif kind == b"mvhd":
                out["timescale"], out["duration"], _ = header(at, stop)
            elif kind == b"trex" and stop - at >= 24:
                track_id, _, *rest = struct.unpack_from(">5I", data, at + 4)
                defaults[track_id] = tuple(rest)
            elif kind == b"tfhd" and stop - at >= 8:
                flags, track_id = struct.unpack_from(">II", data, at)
                track = next((t for t in out["tracks"] if t.get("track_id") == track_id), None)
                if track is None:
                    track = {"track_id": track_id, "tables": {}, "samples": []}
                    out["tracks"].append(track)
                # Without a base of its own, a track's data follow those of the track before in the fragment.
                p, base, (dur, size, flag) = at + 8, moof if flags & 0x20000 else reach[0], defaults.get(track_id, (0, 0, 0))
                for bit, form in ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")):
                    if flags & bit:
                        (x,) = struct.unpack_from(form, data, p)
                        p += struct.calcsize(form)
                        base, dur, size, flag = x if bit == 1 else base, x if bit == 8 else dur, x if bit == 16 else size, x if bit == 32 else flag
                track["fragment"], reach[0] = [base, dur, size, flag], base
            elif track is None:
                continue
            elif kind == b"tkhd":
                wide = data[at] == 1
                (track["track_id"],) = struct.unpack_from(">I", data, at + (20 if wide else 12))
                w, h = struct.unpack_from(">II", data, stop - 8)
                track["width"], track["height"] = w >> 16, h >> 16
            elif kind == b"mdhd":
                track["timescale"], track["duration"], _ = header(at, stop)
            elif kind == b"hdlr" and stop - at >= 12:
                track.setdefault("handler", bytes(data[at + 8 : at + 12]).decode("latin-1"))
            elif kind == b"stsd" and stop - at >= 16:
                track["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"trun":
                fragment_run(track, at, stop)
            elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
                track["tables"][kind] = (at + 4, stop)

    def fragment_run(track: dict, at: int, stop: int) -> None:
        flags, n = struct.unpack_from(">II", data, at)
        base, dur, size, flag = track.get("fragment", [0, 0, 0, 0])
        p = at + 8
        begin, first = reach[0], flag  # without an offset, where the run before ends
        if flags & 1:
            begin = base + struct.unpack_from(">i", data, p)[0]
            p += 4
        if flags & 4:
            (first,) = struct.unpack_from(">I", data, p)
            p += 4
        fields = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
        if n > len(data):  # a run without fields says no sizes, so only this bounds it
            raise Truncated
        x = numbers(data, p, stop, n * len(fields), ">u4").reshape(n, len(fields))
        column = {b: x[:, i] for i, b in enumerate(fields)}
        sizes = column.get(0x200, np.full(n, size))
        durations = column.get(0x100, np.full(n, dur))
        marks = column.get(0x400, np.full(n, flag)).copy()
        if n and flags & 4 and 0x400 not in column:
            marks[0] = first
        time = track.get("time", 0)
        track["time"], reach[0] = time + int(durations.sum()), begin + int(sizes.sum())
        track["samples"].append((begin + np.cumsum(sizes) - sizes, sizes, time + np.cumsum(durations) - durations, (marks & 0x10000) == 0))

    try:
        visit(0, len(data), None, 0, 0)
    except (Truncated, *DAMAGE):
        out["status"] = "truncated" if out["status"] == "ok" else out["status"]
    for track in out["tracks"]:
        try:
            track["samples"].insert(0, table_samples(data, track["tables"]))
        except (Truncated, *DAMAGE):
            if track["tables"]:
                out["status"] = "truncated"
        track["samples"] = tuple(np.concatenate(c) for c in zip(*track["samples"], strict=True)) if track["samples"] else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
    return out


def table_samples(data: memoryview, tables: dict) -> tuple[np.ndarray, ...]:
    """Start, size, time and keyframe mark of each sample, from the tables of an stbl box."""
    if b"stz2" in tables:
        at, end = tables[b"stz2"]
        bits, n = struct.unpack_from(">II", data, at)
        if bits == 4:
            raw = numbers(data, at + 8, end, (n + 1) // 2, ">u1")
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
        else:
            sizes = numbers(data, at + 8, end, n, ">u1" if bits == 8 else ">u2")
    else:
        at, end = tables[b"stsz"]
        each, n = struct.unpack_from(">II", data, at)
        if each and n > len(data) // each + 1:  # n is bounded by the blob in every case
            raise Truncated
        sizes = np.full(n, each, np.int64) if each else numbers(data, at + 8, end, n, ">u4")
    wide = b"co64" in tables
    at, end = tables[b"co64" if wide else b"stco"]
    (n_chunks,) = struct.unpack_from(">I", data, at)
    chunks = numbers(data, at + 4, end, n_chunks, ">u8" if wide else ">u4")
    at, end = tables[b"stsc"]
    (n_runs,) = struct.unpack_from(">I", data, at)
    runs = numbers(data, at + 4, end, 3 * n_runs, ">u4").reshape(-1, 3)
    if n == 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
    # The chunk of each sample, from where the samples of each run of chunks begin; no more than n are laid out.
    spans = np.diff(np.append(runs[:, 0], n_chunks + 1))
    if not len(runs) or runs[0, 0] != 1 or (spans < 0).any():
        raise Truncated
    upto = np.cumsum(np.minimum(spans.astype(float) * runs[:, 1], n).astype(np.int64))
    if upto[-1] < n:
        raise Truncated
    at_ = np.arange(n)
    run = np.searchsorted(upto, at_, side="right")
    chunk = runs[run, 0] - 1 + (at_ - np.append(0, upto)[run]) // runs[run, 1]
    before = np.cumsum(sizes) - sizes
    first = np.zeros(n_chunks, np.int64)
    head = np.flatnonzero(np.diff(chunk, prepend=-1))
    first[chunk[head]] = before[head]
    starts = chunks[chunk] + before - first[chunk]
    counts, deltas = repeated(data, *tables[b"stts"])
    last = np.minimum(np.cumsum(counts.astype(float)), n).astype(np.int64)
    durations = np.repeat(deltas, np.diff(last, prepend=0))
    durations = np.pad(durations, (0, n - len(durations)))
    key = np.ones(n, bool)
    if b"stss" in tables:
        at, end = tables[b"stss"]
        (k,) = struct.unpack_from(">I", data, at)
        marked = numbers(data, at + 4, end, k, ">u4") - 1
        key = np.zeros(n, bool)
        key[marked[(marked >= 0) & (marked < n)]] = True
    return starts, sizes, np.cumsum(durations) - durations, key


def described(blob: bytes | None) -> dict:
    """The value of the MEDIA column."""
    if blob is None:
        return {"status": "null", "brand": None, "timescale": None, "duration": None, "tracks": []}
    return described_index(walk(memoryview(blob)))


def described_index(found: dict) -> dict:
    """The value of the MEDIA column, from what `walk` found."""
    tracks = []
    for t in found["tracks"]:
        starts, sizes, times, key = t["samples"]
        at = np.flatnonzero(key)
        tracks.append(
            {k: t.get(k) for k in ("track_id", "handler", "codec", "timescale", "duration", "width", "height")}
            | {
                "n_samples": len(starts),
                "keyframes": [dict(zip(("sample", "time", "start", "size"), x, strict=True)) for x in zip((at + 1).tolist(), times[at].tolist(), starts[at].tolist(), sizes[at].tolist(), strict=True)],
            }
        )
    return found | {"tracks": tracks}


def payload_of(blob: bytes, found: dict) -> bytes:
    """The bytes of the first track's samples, in order, read through its sample tables."""
    if not found["tracks"]:
        return b""
    starts, sizes, _, _ = found["tracks"][0]["samples"]
    ends = starts + sizes
    cut = np.flatnonzero(starts[1:] != ends[:-1])  # adjacent samples are one range
    a, b = starts[np.append(0, cut + 1)] if len(starts) else [], ends[np.append(cut, len(ends) - 1)] if len(starts) else []
    return b"".join(blob[i:j] for i, j in zip(a, b, strict=True))


# --- operators -------------------------------------------------------------------------------------------


def media_columns(df: DataFrame, blob_col: str = "media", out_col: str = "media_info") -> DataFrame:
    """`df` with column `out_col` (type MEDIA); a column of that name is replaced."""
    from pyspark.sql.types import _parse_datatype_string

    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*kept).schema.add(out_col, _parse_datatype_string(MEDIA))
    arrow = _media_arrow()

    def run(batches):
        for b in batches:
            blobs = b.column(b.schema.get_field_index(blob_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array([described(x) for x in blobs], arrow)], [*kept, out_col])

    return df.mapInArrow(run, schema)


def _media_arrow() -> pa.DataType:
    i, s = pa.int64(), pa.string()
    key = pa.struct([("sample", i), ("time", i), ("start", i), ("size", i)])
    track = pa.struct([("track_id", i), ("handler", s), ("codec", s), ("timescale", i), ("duration", i), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", i), ("keyframes", pa.list_(key))])
    return pa.struct([("status", s), ("brand", s), ("timescale", i), ("duration", i), ("tracks", pa.list_(track))])


def text_movies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as UTF-8 (null: empty), padded to whole frames, as a movie."""

    def run(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_movie(padded(x)) for x in raw], pa.binary())], [id_col, "n_bytes", "media"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select(id_col).schema.add("n_bytes", "long").add("media", "binary"))


def feature(found: dict) -> str:
    """What the index says of a container, in one line."""
    if not found["tracks"]:
        return found["status"]
    t = found["tracks"][0]
    starts, sizes, times, key = t["samples"]
    at = np.flatnonzero(key)
    ranges = hashlib.sha256(np.stack([starts[at], sizes[at]], 1).astype("<i8").tobytes()).hexdigest()[:16]
    return f"codec={(t.get('codec') or '').strip()};size={t.get('width')}x{t.get('height')};timescale={t.get('timescale')};duration={t.get('duration')};samples={len(starts)};keyframes={len(at)};ranges={ranges}"


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long, keyframes array<struct<start:bigint,size:bigint>>"


def movie_features(movies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of what text_movies stored, read back through the container's sample tables."""

    def run(batches):
        for b in batches:
            out = []
            for n, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = walk(memoryview(blob))
                payload, track = payload_of(blob, found), described_index(found)["tracks"][0]
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(found), track["codec"], track["duration"] / track["timescale"], len(track["keyframes"]), [{"start": k["start"], "size": k["size"]} for k in track["keyframes"]]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, *(x.split()[0] for x in FEATURES.split(", "))])

    kind = movies.schema[id_col].dataType.simpleString()
    return movies.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {kind}, {FEATURES}")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movie_features(text_movies(common.table(spark, sf_dir, "documents")))
