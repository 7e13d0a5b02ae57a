"""Media columns: ISO base media containers, read by their boxes and sample tables alone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text, with_id_type

#: Depth of boxes in boxes, and of what a file's tables may claim against its bytes, beyond which it counts as malformed.
DEEPEST = 32
#: Flags of a sample that no decoder can start at, of a fragment's defaults and of its runs, as the container format has them.
NOT_SYNC, HAS_BASE, HAS_ENTRY, HAS_DURATION, HAS_SIZE, HAS_FLAGS = 0x10000, 0x1, 0x2, 0x8, 0x10, 0x20
RUN_AT, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
#: Boxes that hold boxes, as the container format has them.
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: A stored sample is a grey frame of 8 x 8 samples of 8 bits; each GROUP-th is marked as a key frame.
SIDE, FRAME, GROUP, CHUNK, TIMESCALE, STEP = 8, 64, 16, 8, 1000, 40


def boxes(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes that lie side by side. A size of 1 is followed
    by 64 bits of size; a size of 0 goes to the end. Raises ValueError where a box leaves its holder."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise ValueError("a box leaves its holder")
        yield kind, at + head, at + size
        at += size


@dataclass
class Track:
    """What the sample tables of a track say; samples are (offset, size) in the file."""

    number: int = 0
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ticks: int = 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges (first, end) of the key frames."""
        return list(zip(self.offsets[self.keys].tolist(), (self.offsets[self.keys] + self.sizes[self.keys]).tolist(), strict=True))


def _words(data: memoryview, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    """n big-endian numbers; ValueError where the table is cut short."""
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _table(data: memoryview, at: int, width: int) -> np.ndarray:
    """A full box's table of rows of ``width`` numbers."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    return _words(data, at + 8, n * width).reshape(n, width)


def _sample_offsets(chunks: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples lie one after another in their chunk; ``runs`` tells how many a chunk has, from which chunk on."""
    if not len(runs) or not len(chunks):
        return np.zeros(0, np.int64)
    lasts = np.append(runs[1:, 0] - 1, len(chunks))
    held = np.maximum(0, np.minimum(lasts, len(chunks)) - runs[:, 0] + 1)
    if held.sum() > len(chunks):
        raise ValueError("runs of chunks overlap")
    per = np.repeat(runs[:, 1], held)
    if len(per) != len(chunks) or per.sum() != len(sizes):
        raise ValueError("chunks and sizes disagree")
    first = np.cumsum(per) - per
    before = np.cumsum(sizes) - sizes
    return np.repeat(chunks - before[np.minimum(first, len(sizes) - 1)], per) + before


def _sizes(data: memoryview, at: int, end: int, compact: bool) -> np.ndarray:
    """A table of sample sizes. One that claims more samples than the file has bytes is malformed."""
    head, n = struct.unpack_from(">II", data, at + 4)
    if n > len(data):
        raise ValueError("more samples than bytes")
    if not compact:
        return np.full(n, head, np.int64) if head else _words(data, at + 12, n)
    bits = head & 0xFF
    if bits in (8, 16):
        return _words(data, at + 12, n, f">u{bits // 8}")
    if bits != 4:
        raise ValueError("a width of sizes that does not exist")
    pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
    return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)


def _fragment(data: memoryview, start: int, a: int, z: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Adds the samples of a track's part of a fragment, whose first byte is ``start``."""
    track, base, after = None, start, None
    duration = size = flags = 0
    for kind, b, e in boxes(data, a, z):
        if kind == b"tfhd":
            said, number = struct.unpack_from(">I", data, b)[0] & 0xFFFFFF, struct.unpack_from(">I", data, b + 4)[0]
            if (track := tracks.get(number)) is None:
                raise ValueError("a fragment of no track")
            duration, size, flags = defaults.get(number, (0, 0, 0))
            at = b + 8
            if said & HAS_BASE:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(said & HAS_ENTRY)
            read = [struct.unpack_from(">I", data, at + 4 * sum(bool(said & f) for f in (HAS_DURATION, HAS_SIZE, HAS_FLAGS) if f < bit))[0] if said & bit else None for bit in (HAS_DURATION, HAS_SIZE, HAS_FLAGS)]
            duration, size, flags = (new if new is not None else old for new, old in zip(read, (duration, size, flags), strict=True))
        elif kind == b"trun":
            if track is None:
                raise ValueError("a run before its header")
            said, n = struct.unpack_from(">I", data, b)[0] & 0xFFFFFF, struct.unpack_from(">I", data, b + 4)[0]
            at, first = b + 8, base if after is None else after
            if said & RUN_AT:
                first, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first_flags = None
            if said & RUN_FIRST:
                first_flags, at = struct.unpack_from(">I", data, at)[0], at + 4
            fields = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if said & f]
            if n > len(data):
                raise ValueError("more samples than bytes")
            rows = _words(data, at, n * len(fields)).reshape(n, len(fields)) if fields else np.zeros((n, 0), np.int64)
            column = lambda f, default: rows[:, fields.index(f)] if f in fields else np.full(n, default, np.int64)  # noqa: E731, B023
            sizes, marks = column(RUN_SIZE, size), column(RUN_FLAGS, flags).copy()
            if n and first_flags is not None:
                marks[0] = first_flags
            track.keys = np.append(track.keys, len(track.sizes) + np.flatnonzero(marks & NOT_SYNC == 0))
            track.offsets = np.append(track.offsets, first + np.cumsum(sizes) - sizes)
            track.sizes = np.append(track.sizes, sizes)
            track.ticks += int(column(RUN_DURATION, duration).sum())
            after = first + int(sizes.sum())


def read_tracks(data: bytes) -> list[Track]:
    """All tracks of a file, from its boxes, sample tables and fragments; media data is stepped over, never decoded.

    ValueError where boxes lie deeper than DEEPEST, leave their holder or claim what the file can't hold.
    """
    view, tracks, defaults = memoryview(data), [], {}
    parts: list[tuple[int, int, int]] = []

    def walk(at: int, end: int, track: Track | None, raw: dict, depth: int, fragment: int) -> None:
        if depth > DEEPEST:
            raise ValueError("boxes lie too deep")
        for kind, a, z in boxes(view, at, end):
            if kind == b"trak":
                own, tables = Track(), {}
                walk(a, z, own, tables, depth + 1, fragment)
                if "sizes" in tables:
                    own.sizes = tables["sizes"]
                    own.offsets = _sample_offsets(tables.get("chunks", np.zeros(0, np.int64)), tables.get("runs", np.zeros((0, 3), np.int64)), own.sizes)
                    own.keys = tables["keys"] - 1 if "keys" in tables else np.arange(len(own.sizes))
                    if len(own.keys) and not (0 <= own.keys.min() and own.keys.max() < len(own.sizes)) or len(own.offsets) != len(own.sizes):
                        raise ValueError("key frames or chunks and sizes disagree")
                if own.kind != "vide":
                    own.width = own.height = 0
                tracks.append(own)
            elif kind == b"traf":
                parts.append((fragment, a, z))
            elif kind in HOLDERS:
                walk(a, z, track, raw, depth + 1, a - 8 if kind == b"moof" else fragment)
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", view, a + 4)
                defaults[number] = tuple(rest)
            elif track is None:
                continue
            elif kind == b"tkhd":
                track.number = struct.unpack_from(">I", view, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"hdlr":
                track.kind = bytes(view[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"mdhd":
                wide = data[a] == 1
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
            elif kind == b"stsd":
                if struct.unpack_from(">I", view, a + 4)[0]:
                    codec, b, _ = next(boxes(view, a + 8, z))
                    track.codec = codec.decode("latin-1").strip()
                    if z - b >= 28:
                        track.width, track.height = struct.unpack_from(">HH", view, b + 24)
            elif kind == b"stts":
                track.ticks = sum(n * each for n, each in _table(view, a, 2).tolist())
            elif kind == b"stsc":
                raw["runs"] = _table(view, a, 3)
            elif kind in (b"stsz", b"stz2"):
                raw["sizes"] = _sizes(view, a, z, kind == b"stz2")
            elif kind == b"stco":
                raw["chunks"] = _table(view, a, 1)[:, 0]
            elif kind == b"co64":
                n = struct.unpack_from(">I", view, a + 4)[0]
                raw["chunks"] = _words(view, a + 8, n, ">u8")
            elif kind == b"stss":
                raw["keys"] = _table(view, a, 1)[:, 0]

    walk(0, len(view), None, {}, 0, 0)
    by = {t.number: t for t in tracks}
    for start, a, z in parts:
        _fragment(view, start, a, z, by, defaults)
    return tracks


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def write_container(payload: bytes) -> bytes:
    """A file with ``payload`` (a multiple of 64 bytes) as grey frames, its sample tables behind it."""
    n = len(payload) // FRAME
    start = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    data = box(b"mdat", payload)
    at = len(start) + len(data) - len(payload)
    chunks = np.arange(at, at + len(payload), CHUNK * FRAME)
    wide = at + len(payload) >= 2**32
    rest = n % CHUNK
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(len(chunks), rest, 1)] * bool(rest)
    keys = np.arange(1, n + 1, GROUP)
    ticks = n * STEP
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    tables = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, STEP)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
        full(b"hdlr", bytes(4), b"vide", bytes(13)),
        box(b"minf", full(b"vmhd", bytes(8)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url "))), tables),
    )
    head = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), unity, struct.pack(">II", SIDE << 16, SIDE << 16), version=1)
    movie = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join([start, data, box(b"moov", movie, box(b"trak", head, media))])


def stored_samples(data: bytes, track: Track) -> bytes:
    """The track's samples as stored, in order; runs that lie together are taken as one slice."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    if (track.offsets < 0).any() or ends.max() > len(data):
        raise ValueError("a sample lies outside the file")
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(ends)) - 1
    return b"".join(data[a:z] for a, z in zip(track.offsets[firsts].tolist(), ends[lasts].tolist(), strict=True))


def feature(tracks: list[Track]) -> str:
    """codec:widthxheight:seconds:samples:keys:bytes in keys:CRC-32 of the key ranges, by track, joined by ';'."""
    out = []
    for t in tracks:
        ranges = np.stack([t.offsets[t.keys], t.sizes[t.keys]], 1).astype("<i8").tobytes() if len(t.sizes) else b""
        seconds = (t.duration or t.ticks) / t.timescale if t.timescale else 0.0
        out.append(f"{t.codec}:{t.width}x{t.height}:{seconds:.3f}:{len(t.sizes)}:{len(t.keys)}:{int(t.sizes[t.keys].sum()) if len(t.sizes) else 0}:{zlib.crc32(ranges)}")
    return ";".join(out)


def media_columns(df: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """One row for each track of each container in a binary column: id, track, codec, width, height,
    seconds, samples, key_ranges (array of first byte and end), error.

    A file without tracks, a null or empty one, and one that does not parse give one row without a
    track; ``error`` says why. Only boxes and tables are read, also those of fragments; only tracks of pictures have a width and height.
    Repeated rows and null ids are kept.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = with_id_type(df, "track int, codec string, width int, height int, seconds double, samples long, key_ranges array<struct<first:bigint,end:bigint>>, error string", id_col)
    out = to_arrow_schema(schema)

    def rows(key, data):
        if not data:
            return [(key, None, None, None, None, None, None, None, "empty")]
        try:
            found = read_tracks(data)
            if not found:
                raise ValueError("no track")
            return [
                (key, k, t.codec, t.width, t.height, (t.duration or t.ticks) / t.timescale if t.timescale else None, len(t.sizes), [{"first": a, "end": z} for a, z in t.key_ranges()], None)
                for k, t in enumerate(found)
            ]
        except (ValueError, struct.error, IndexError, StopIteration, OverflowError) as e:
            return [(key, None, None, None, None, None, None, None, str(e) or "malformed")]

    def run(batches):
        for batch in batches:
            got = [r for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows(k, d)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], f.type) for i, f in enumerate(out)], schema=out)

    return df.select(id_col, content_col).mapInArrow(run, schema)


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as UTF-8 stored in a container and read back through its sample tables.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The
    payload is padded with zero bytes to a positive multiple of 64, so null and empty texts have 64 of
    them. One narrow pass. Repeated rows and null ids are kept; other columns are ignored.
    """
    schema = with_id_type(df, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", id_col)

    def rows(key, text):
        raw = text.encode()
        stored = write_container(raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\0"))
        tracks = read_tracks(stored)
        back = stored_samples(stored, tracks[0])
        return [(key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(tracks))]

    return per_text(df, rows, schema, id_col, text_col)
