"""Media columns over ISO base media files (nested length-prefixed boxes).

:func:`mux` stores bytes losslessly as frames of a raw 8-bit grey video track; :func:`demux` walks the
boxes of any such file and decodes the sample tables, which give codec, duration and the byte ranges
of samples and keyframes without touching the payload. :func:`media_columns` does both per document.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Production parameters: frames of 24 by 24 samples of 8 bits, 24 frames a second, a keyframe every 8 frames, 16 frames a chunk.
WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
TIMESCALE, FRAME_TICKS = 24_000, 1_000
KEY_EVERY, CHUNK_FRAMES = 8, 16

#: Fixed values of the container format: boxes that hold boxes, and the unity transformation matrix.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An ISO media file whose samples, in order, are ``payload``; its length must be a positive multiple of FRAME."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("the payload must be a positive multiple of a frame")
    ticks = frames * FRAME_TICKS
    full_chunks, last = divmod(frames, CHUNK_FRAMES)
    chunks = full_chunks + bool(last)
    runs = [(1, CHUNK_FRAMES)] if full_chunks else []
    runs += [(full_chunks + 1, last)] if last else []
    keys = range(1, frames + 1, KEY_EVERY)
    entry = _box(b"raw ", struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"", 40, -1))

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        data_info = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), data_info, table),
        )
        track_head = _full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 0, 0), UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=3)
        movie_head = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", movie_head, _box(b"trak", track_head, media))

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
    long = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(kind) + len(movie(0)) + len(head)
    first = len(kind) + len(movie(first)) + len(head)  # the offsets may have become 64-bit ones
    return b"".join((kind, movie(first), head, payload))


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes between two places, not nested. A box that runs over the end raises ValueError."""
    at, end = start, len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError("a box runs over its parent")
        yield kind, body, at + size
        at += size


def _walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from _walk(data, a, b, (*path, kind))


def _track(data: memoryview, start: int, end: int) -> dict:
    """What the boxes of one track say; sample places come from the tables alone."""
    found = {path[-1]: (a, b) for path, a, b in _walk(data, start, end)}

    def words(kind: bytes, code: str = "I", skip: int = 0) -> list[int]:
        a, _ = found[kind]
        (n,) = struct.unpack_from(">I", data, a + 4 + skip)
        return list(struct.unpack_from(f">{n}{code}", data, a + 8 + skip))

    a, _ = found[b"mdhd"]
    timescale, ticks = struct.unpack_from(">20xIQ" if data[a] else ">12xII", data, a)
    a, _ = found[b"stsd"]
    kind, body, _ = next(boxes(data, a + 8, found[b"stsd"][1]))
    width, height = struct.unpack_from(">24xHH", data, body)
    a, _ = found[b"stsz"]
    fixed, n = struct.unpack_from(">4xII", data, a)
    if fixed * n > len(data):
        raise ValueError("more samples than the file can hold")
    sizes = [fixed] * n if fixed else words(b"stsz", skip=4)
    a, _ = found[b"stts"]
    (entries,) = struct.unpack_from(">I", data, a + 4)
    pairs = struct.unpack_from(f">{2 * entries}I", data, a + 8)
    times = sum(c * d for c, d in zip(pairs[::2], pairs[1::2], strict=True))
    chunks = words(b"co64", "Q") if b"co64" in found else words(b"stco")
    a, _ = found[b"stsc"]
    (entries,) = struct.unpack_from(">I", data, a + 4)
    flat = struct.unpack_from(f">{3 * entries}I", data, a + 8)
    runs = list(zip(flat[::3], flat[1::3], strict=False))
    ranges: list[tuple[int, int]] = []
    for (first, each), (after, _) in zip(runs, [*runs[1:], (len(chunks) + 1, 0)], strict=True):
        for chunk in chunks[first - 1 : after - 1]:
            for size in sizes[len(ranges) : len(ranges) + each]:
                ranges.append((chunk, size))
                chunk += size
    if any(a + size > len(data) for a, size in ranges):
        raise ValueError("a sample runs over the file")
    if len(ranges) != n:
        raise ValueError("the sample tables disagree")
    keys = words(b"stss") if b"stss" in found else range(1, n + 1)
    return {"codec": kind.decode("latin-1"), "width": width, "height": height, "duration": (times or ticks) / timescale, "samples": ranges, "keyframes": [ranges[k - 1] for k in keys]}


def demux(data: bytes) -> list[dict]:
    """The tracks of a file: codec, size, duration in seconds, (offset, size) of its samples and of its keyframes.

    Payload bytes are not read, nor fragments (moof), compact sizes (stz2) and edit lists. Broken nesting or tables raise ValueError (struct.error where a table is cut short).
    """
    view = memoryview(data)
    return [_track(view, a, b) for path, a, b in _walk(view, 0, len(view)) if path == (b"moov", b"trak")]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<offset:long,size:long>>, media binary"


def padded(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of FRAME."""
    return text + b"\xff" * ((-len(text)) % FRAME if text else FRAME)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each text as a media file, reads it back, and returns its columns; ``media`` is null unless asked for.

    An empty or null text is one frame of padding. Equal texts have equal values: nothing else enters the file.
    """
    names = [f.split(" ")[0] for f in SCHEMA.replace("array<struct<offset:long,size:long>>", "x").split(", ")]
    places = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), places, pa.binary()]

    def work(batches):
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.encoded(batch), strict=True):
                media = mux(padded(text))
                (track,) = demux(media)
                payload = b"".join(media[a : a + n] for a, n in track["samples"])
                keys = track["keyframes"]
                feature = f"{track['codec'].strip()};{track['width']}x{track['height']};{track['duration']:.6f};" + ",".join(f"{a}+{n}" for a, n in keys)
                rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"], track["duration"], [{"offset": a, "size": n} for a, n in keys], media if keep_media else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return common.texts(docs).mapInArrow(work, SCHEMA)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through :func:`media_columns`, without the media bytes."""
    return media_columns(common.documents(spark, sf_dir)).drop("media", "keyframes")
