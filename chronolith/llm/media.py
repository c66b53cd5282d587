"""Media columns: ISO base media containers as binary columns and back.

`pack` stores a payload losslessly in a container (ftyp, moov with one track, mdat):
24 x 24 grey frames of 8-bit samples, codec 'raw ', sync samples every few frames,
frames gathered in chunks. `media_columns` reads any container: it walks the nested
boxes, decodes the sample tables (stts, stsc, stsz or stz2, stco or co64, stss; in movie
fragments tfhd and trun, with the defaults of trex) and returns
codec, duration and the byte ranges of keyframes. It never decodes payloads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = 576
SIDE = 24
TIMESCALE = 25
SYNC_EVERY = 8
PER_CHUNK = 16
ROWS = 64

#: Levels of boxes that are walked; known files have fewer than ten.
DEEPEST = 32

#: Boxes that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """`data` with bytes 255 up to a positive multiple of `unit`."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def container(payload: bytes, sync_every: int = SYNC_EVERY, per_chunk: int = PER_CHUNK) -> bytes:
    """A container whose samples are the payload's frames; its length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mvhd = full_box(b"mvhd", struct.pack(">4I", 0, 0, TIMESCALE, n), struct.pack(">IH10x", 1 << 16, 1 << 8), matrix, bytes(24), struct.pack(">I", 2))
    tkhd = full_box(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, n, 0, 0, 0, 0), matrix, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3)
    mdhd = full_box(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, n, 0x55C4, 0))
    hdlr = full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
    entry = box(b"raw ", struct.pack(">6xH16x2H2I4xH32s2H", 1, SIDE, SIDE, 72 << 16, 72 << 16, 1, b"", 40, 0xFFFF))
    sync = range(1, n + 1, sync_every)
    chunks, rest = divmod(n, per_chunk)
    runs = [(1, per_chunk)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    count = chunks + bool(rest)

    def moov(start: int) -> bytes:
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, n, 1)),
            full_box(b"stss", struct.pack(f">{len(sync) + 1}I", len(sync), *sync)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", a, b, 1) for a, b in runs)),
            full_box(b"stsz", struct.pack(">2I", FRAME, n)),
            full_box(b"co64", struct.pack(f">I{count}Q", count, *(start + i * per_chunk * FRAME for i in range(count)))),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), dinf, stbl)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    mdat = box(b"mdat", payload)
    return ftyp + moov(len(ftyp) + len(moov(0)) + len(mdat) - len(payload)) + mdat


def walk(data, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte, end) of every box's body, depth first; a damaged size ends its level, and levels below DEEPEST aren't entered."""
    path: list[bytes] = []
    levels = [(start, len(data) if end is None else end)]
    while levels:
        start, end = levels.pop()
        del path[len(levels) :]
        while start + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, start)
            head = 8
            if size == 1 and start + 16 <= end:
                size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
            elif size == 0:
                size = end - start
            if size < head or start + size > end:
                break
            yield (*path, kind), start + head, start + size
            if kind in CONTAINERS and len(levels) < DEEPEST:
                levels.append((start + size, end))
                path.append(kind)
                start, end = start + head, start + size
            else:
                start += size


def _numbers(data, at: int, end: int, n: int, width: int = 4) -> np.ndarray:
    if at + n * width > end:
        raise ValueError("a sample table ends early")
    return np.frombuffer(data, f">u{width}", n, at).astype(np.int64)


def _count(data, at: int, end: int) -> int:
    if at + 8 > end:
        raise ValueError("a sample table ends early")
    return struct.unpack_from(">I", data, at + 4)[0]


def _sizes(data, at: int, end: int, kind: bytes) -> np.ndarray | tuple[int, int]:
    """Sample sizes of stsz or stz2; a constant size as (size, number), which takes no memory yet."""
    if at + 12 > end:
        raise ValueError("a sample table ends early")
    size, n = struct.unpack_from(">2I", data, at + 4)
    if kind == b"stsz":
        return (size, n) if size else _numbers(data, at + 12, end, n)
    width = size & 0xFF
    if width in (8, 16):
        return _numbers(data, at + 12, end, n, width // 8)
    if width != 4:
        raise ValueError("stz2 has fields of 4, 8 or 16 bits")
    both = _numbers(data, at + 12, end, (n + 1) // 2, 1)
    return np.stack([both >> 4, both & 15], axis=1).ravel()[:n]


class _Fields:
    """Reads a box's unsigned numbers one after the other, those that its flags announce."""

    def __init__(self, data, at: int, end: int):
        self.data, self.at, self.end = data, at + 4, end
        self.flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF

    def take(self, form: str, flag: int = 0, default=None):
        if flag and not self.flags & flag:
            return default
        size = struct.calcsize(">" + form)
        if self.at + size > self.end:
            raise ValueError("a box ends early")
        self.at += size
        return struct.unpack_from(">" + form, self.data, self.at - size)[0]


def _fragment_run(f: _Fields, traf: dict, room: int) -> dict:
    """Starts, sizes, durations and sync flags of a trun box's samples."""
    n = f.take("I")
    start = traf["base"] + f.take("i", 0x1, traf["next"] - traf["base"])
    first = f.take("I", 0x4)
    columns = [c for c, flag in (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("shift", 0x800)) if f.flags & flag]
    if n > room:
        raise ValueError("more samples than bytes")
    x = _numbers(f.data, f.at, f.end, n * len(columns)).reshape(n, len(columns))
    of = lambda c: x[:, columns.index(c)] if c in columns else np.full(n, traf[c] or 0, np.int64)
    sizes, flags = of("size"), of("flags").copy()
    if first is not None and n:
        flags[0] = first
    starts = start + np.cumsum(sizes) - sizes
    traf["next"] = int(start + sizes.sum())
    return {"starts": starts, "sizes": sizes, "ticks": int(of("duration").sum()), "sync": (flags & 0x10000) == 0}


def parse(data) -> list[dict]:
    """codec, timescale, duration, sample offsets and sizes, and sync samples of each track that has sample tables.

    Samples of movie fragments (moof) come after those of the track's own tables.
    Counts are checked against their box and against the file before anything is
    allocated, and every sample must lie inside the file: ValueError, struct.error or
    IndexError otherwise.
    """
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    moof, traf, room = 0, None, len(data)
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            moof = at - 8
        elif kind == b"trex":
            f = _Fields(data, at, end)
            own, _ = f.take("I"), f.take("I")
            defaults[own] = {"duration": f.take("I"), "size": f.take("I"), "flags": f.take("I")}
        elif kind == b"tfhd":
            f = _Fields(data, at, end)
            own = f.take("I")
            usual = defaults.get(own, {"duration": 0, "size": 0, "flags": 0})
            base = f.take("Q", 0x1, moof)
            f.take("I", 0x2)
            traf = {"track": own, "base": base, "next": base, "duration": f.take("I", 0x8, usual["duration"]), "size": f.take("I", 0x10, usual["size"]), "flags": f.take("I", 0x20, usual["flags"])}
        elif kind == b"trun" and traf is not None:
            own = next((t for t in tracks if t.get("id") == traf["track"]), None)
            run = _fragment_run(_Fields(data, at, end), traf, room)
            room -= len(run["sizes"])
            if own is not None:
                own.setdefault("runs", []).append(run)
        if kind == b"trak":
            tracks.append({})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            wide = data[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"stsd":
            t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            t["times"] = _numbers(data, at + 8, end, 2 * _count(data, at, end)).reshape(-1, 2)
        elif kind == b"stss":
            t["sync"] = _numbers(data, at + 8, end, _count(data, at, end))
        elif kind == b"stsc":
            t["chunks"] = _numbers(data, at + 8, end, 3 * _count(data, at, end)).reshape(-1, 3)
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(data, at, end, kind)
        elif kind in (b"stco", b"co64"):
            t["offsets"] = _numbers(data, at + 8, end, _count(data, at, end), 8 if kind == b"co64" else 4)
    out = []
    for t in tracks:
        if not {"codec", "timescale", "chunks", "sizes", "offsets"} <= t.keys():
            continue
        sizes = t["sizes"]
        room -= sizes[1] if isinstance(sizes, tuple) else len(sizes)
        if room < 0:
            raise ValueError("more samples than bytes")
        sizes = np.full(sizes[1], sizes[0], np.int64) if isinstance(sizes, tuple) else sizes
        firsts = np.append(t["chunks"][:, 0], len(t["offsets"]) + 1)
        per = np.repeat(t["chunks"][:, 1], np.diff(firsts)) if len(t["chunks"]) else np.zeros(0, np.int64)
        if len(per) > len(t["offsets"]):
            raise ValueError("more chunks than offsets")
        last = np.cumsum(np.minimum(per, len(data) + 1))
        sizes = sizes[: last[-1] if len(last) else 0]
        chunk = np.searchsorted(last, np.arange(len(sizes)), "right")
        ahead = np.cumsum(sizes) - sizes
        first = last - np.minimum(per, len(data) + 1)
        starts = t["offsets"][chunk] + ahead - ahead[first[chunk]] if len(sizes) else np.zeros(0, np.int64)
        sync = t["sync"] - 1 if "sync" in t else np.arange(len(sizes))
        sync = sync[(sync >= 0) & (sync < len(sizes))]
        ticks = sum(a * b for a, b in t["times"].tolist()) if "times" in t and len(t["times"]) else 0 if "runs" in t else t["duration"]
        for run in t.get("runs", []):
            sync = np.concatenate([sync, len(sizes) + np.flatnonzero(run["sync"])])
            starts, sizes, ticks = np.concatenate([starts, run["starts"]]), np.concatenate([sizes, run["sizes"]]), ticks + run["ticks"]
        if len(sizes) and (starts.min() < 0 or sizes.min() < 0 or starts.max() > len(data) or (starts + sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        out.append({"codec": t["codec"], "timescale": t["timescale"], "duration": ticks, "starts": starts, "sizes": sizes, "sync": sync})
    return out


def payload_of(data, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order; neighbouring samples are read as one range."""
    starts, sizes = track["starts"], track["sizes"]
    if not len(starts):
        return b""
    cuts = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    a, b = np.r_[0, cuts], np.r_[cuts, len(starts)] - 1
    return b"".join(bytes(data[i:j]) for i, j in zip(starts[a], starts[b] + sizes[b], strict=True))


def _pieces(batches, size: int = ROWS):
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _add(df: DataFrame, source: str, added: str, types: list[pa.DataType], f) -> DataFrame:
    names = [x.split(" ")[0] for x in added.split(", ")]  # no ", " inside a type
    kept = [f"`{c}`" for c in df.columns if c not in names]
    inner = df.select(*kept)
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields), added])

    def run(batches):
        for b in _pieces(batches):
            rows = [f(x) for x in b.column(source)]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return inner.mapInArrow(run, schema)


def pack(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with n_bytes long and media binary: the container of each whole text in UTF-8 (null: empty), padded to whole frames."""

    def one(x):
        data = x.as_py().encode() if x.is_valid else b""
        return len(data), container(pad(data))

    return _add(df, text, "n_bytes long, media binary", [pa.int64(), pa.binary()], one)


def media_columns(df: DataFrame, media: str = "media", digests: bool = False) -> DataFrame:
    """`df` with codec string, duration double (seconds), n_samples long, n_keyframes long and keyframes array<struct<start,end>> of each container's first track.

    A value that is null, damaged, or holds no complete track gets nulls: a count that its
    box or the file can't hold, or a sample outside the file, is damage. Fragmented files
    get the samples of all their fragments. Extra columns pass through, those named like
    the new ones are replaced. With `digests`, also
    payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes) of the
    samples' stored bytes, found through the sample tables.
    """
    import hashlib

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long" if digests else ""
    types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), kind] + [pa.int64(), pa.string(), pa.int64()] * digests

    def one(x):
        data = x.as_buffer() if x.is_valid else None
        try:
            tracks = parse(memoryview(data)) if data is not None else []
        except (ValueError, OverflowError, struct.error, IndexError):
            tracks = []
        if not tracks:
            return (None,) * len(types)
        t = tracks[0]
        keys = [{"start": int(t["starts"][i]), "end": int(t["starts"][i] + t["sizes"][i])} for i in t["sync"]]
        row = [t["codec"], t["duration"] / t["timescale"] if t["timescale"] else None, len(t["sizes"]), len(keys), keys]
        if digests:
            p = payload_of(memoryview(data), t)
            row += [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])]
        return row

    return _add(df, media, "codec string, duration double, n_samples long, n_keyframes long, keyframes array<struct<start:bigint,end:bigint>>" + more, types, one)


def feature() -> Column:
    """The media columns in one string."""
    first = F.element_at("keyframes", 1)
    return F.format_string("codec=%s;seconds=%.2f;samples=%d;keyframes=%d;first=%d-%d;last=%d-%d", F.trim("codec"), "duration", "n_samples", "n_keyframes", first["start"], first["end"], F.element_at("keyframes", -1)["start"], F.element_at("keyframes", -1)["end"])
