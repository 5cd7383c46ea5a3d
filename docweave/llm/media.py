"""Media columns: ISO base media containers walked without decoding payloads.

``inspect`` walks the nested boxes of a file, decodes each track's sample
tables (stsd, stts, stsc, stsz, stco/co64, stss) and gives codec, duration
and the byte range of every keyframe. ``build`` writes such a file around
raw 8-bit samples, so any bytes can be stored and read back through the
sample tables.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One frame is 32 x 18 grey samples of 8 bits.
WIDTH, HEIGHT = 32, 18
FRAME = WIDTH * HEIGHT
TIMESCALE, TICKS = 25, 1
#: Rows of media and payload in an Arrow batch, whose bytes of a column must stay under 2 GB.
ROWS = 64
#: Frames in a chunk of the sample tables.
CHUNK = 64
#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to the next positive multiple of a frame."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def build(payload: bytes, frame: int = FRAME) -> bytes:
    """A container that holds ``payload``, whole frames, as one raw grey video track.

    Equal payloads give equal files: times are zero. Raw frames are all
    sync samples, so there is no stss box. Offsets are 64 bits wide beyond
    4 GB.
    """
    n = len(payload) // frame
    assert n and n * frame == len(payload)
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] if n >= CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK * frame for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 40, -1))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, TICKS)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
            _full(b"stsz", struct.pack(">II", frame, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), dinf, stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * TICKS, 0x55C4, 0)),
            _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * TICKS), b"\0" * 16, _UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * TICKS, 0x10000, 0x100), b"\0" * 10, _UNITY, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    size = len(movie(0))
    first = len(ftyp) + size + len(head)
    moov = movie(first)
    if len(moov) != size:  # the offsets became wide
        moov = movie(first + len(moov) - size)
    return b"".join((ftyp, moov, head, payload))


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of each keyframe's bytes."""
        return list(zip(self.offsets[self.sync].tolist(), self.sizes[self.sync].tolist()))

    def read(self, data: bytes) -> bytes:
        """All samples' bytes in order, by the sample tables."""
        ends = self.offsets + self.sizes
        breaks = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        firsts = np.concatenate(([0], breaks)) if len(ends) else []
        lasts = np.concatenate((breaks - 1, [len(ends) - 1])) if len(ends) else []
        return b"".join(data[self.offsets[a] : ends[b]] for a, b in zip(firsts, lasts))


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(kind, body start, box end) of the boxes in a range; ValueError if one leaves it."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, start + size
        start += size


def _table(data: bytes, at: int, end: int, kind: str, columns: int) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    width = np.dtype(kind).itemsize
    if at + 8 + n * columns * width > end:
        raise ValueError("sample table leaves its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def inspect(data: bytes) -> list[Track]:
    """The tracks of a container. Payload bytes are not read.

    ValueError for a broken file and for one whose samples are in fragments,
    which its sample tables don't tell.
    """
    tracks: list[Track] = []
    tables: list[dict[bytes, np.ndarray]] = []

    def walk(start: int, end: int) -> None:
        for kind, at, stop in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
                tables.append({})
            if kind in CONTAINERS:
                walk(at, stop)
            elif tracks:
                leaf(kind, at, stop)

    def leaf(kind: bytes, at: int, stop: int) -> None:
        track, own = tracks[-1], tables[-1]
        try:
            if kind == b"mdhd":
                wide = data[at] == 1
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            elif kind == b"hdlr" and not track.kind:
                track.kind = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
                track.codec = data[at + 12 : at + 16].decode("latin-1")
                if track.kind == "vide":
                    track.width, track.height = struct.unpack_from(">HH", data, at + 40)
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", data, at + 4)
                if size * n > len(data):
                    raise ValueError("more samples than the file can hold")
                own[kind] = np.full(n, size, np.int64) if size else _table(data, at + 4, stop, ">u4", 1)[:, 0]
            elif kind == b"stz2":
                bits, n = struct.unpack_from(">xxxBI", data, at + 4)
                if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > stop:
                    raise ValueError("sample table leaves its box")
                packed = np.frombuffer(data, ">u2" if bits == 16 else np.uint8, (n * min(bits, 8) + 7) // 8, at + 12)
                own[b"stsz"] = (np.column_stack((packed >> 4, packed & 15)).ravel()[:n] if bits == 4 else packed).astype(np.int64)
            elif kind == b"trun":
                raise ValueError("samples in fragments aren't read")
            elif kind == b"stco":
                own[b"chunk"] = _table(data, at, stop, ">u4", 1)[:, 0]
            elif kind == b"co64":
                own[b"chunk"] = _table(data, at, stop, ">u8", 1)[:, 0]
            elif kind in (b"stsc", b"stts"):
                own[kind] = _table(data, at, stop, ">u4", 3 if kind == b"stsc" else 2)
            elif kind == b"stss":
                own[kind] = _table(data, at, stop, ">u4", 1)[:, 0] - 1
        except struct.error as e:
            raise ValueError(f"cut box {kind!r}") from e

    walk(0, len(data))
    for track, own in zip(tracks, tables):
        sizes = own.get(b"stsz", np.empty(0, np.int64))
        chunk, runs = own.get(b"chunk", np.empty(0, np.int64)), own.get(b"stsc", np.empty((0, 3), np.int64))
        if len(sizes):
            if not len(chunk) or not len(runs):
                raise ValueError("samples without chunks")
            until = np.append(runs[1:, 0], len(chunk) + 1)
            per = np.repeat(runs[:, 1], until - runs[:, 0])
            if len(per) != len(chunk) or per.sum() < len(sizes):
                raise ValueError("chunk runs don't fit the samples")
            of = np.repeat(np.arange(len(chunk)), per)[: len(sizes)]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(of, np.arange(len(chunk)))
            track.offsets = chunk[of] + before - before[np.minimum(first, len(sizes) - 1)][of]
            if (track.offsets + sizes).max() > len(data):
                raise ValueError("a sample lies beyond the file")
        track.sizes = sizes
        track.sync = own.get(b"stss", np.arange(len(sizes)))
        if len(track.sync) and (track.sync.min() < 0 or track.sync.max() >= len(sizes)):
            raise ValueError("a keyframe isn't a sample")
        if not track.duration and b"stts" in own:
            track.duration = int((own[b"stts"][:, 0] * own[b"stts"][:, 1]).sum())
    return tracks


SCHEMA = "media binary, n_bytes long, codec string, width int, height int, timescale long, duration long, samples long, keyframes array<struct<offset:long,length:long>>, payload binary"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``SCHEMA``): each whole text in a container, and what reading that gives back.

    Null text counts as empty and gives one frame of padding. Equal texts
    give equal containers. A row is worked on alone, so repeated rows, very
    long texts (64-bit offsets) and empty tables need no case of their own.
    """
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.replace("<offset:long,length:long>", "").split(", ")}
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    media = build(pad(raw))
                    (t,) = inspect(media)
                    payload = t.read(media)
                    row = (media, len(raw), t.codec, t.width, t.height, t.timescale, t.duration, len(t.sizes), [{"offset": a, "length": n} for a, n in t.keyframes()], payload)
                    for k, v in zip(out, row):
                        out[k].append(v)
                cols = [part.column(0)] + [
                    pa.array(v, pa.binary() if k in ("media", "payload") else pa.string() if k == "codec" else pa.int32() if k in ("width", "height") else pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])) if k == "keyframes" else pa.int64())
                    for k, v in out.items()
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *out])

    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(work, f"`{id_col}` {kind}, {SCHEMA}")


def digests(media: DataFrame, id_col: str = "doc_id", tail: int = 32) -> DataFrame:
    """Digest columns of ``store_texts``: built-in functions over the stored and read bytes."""
    ends = F.expr(f"substring(payload, -{tail}, {tail})")
    ranges = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["length"].cast("string"))))
    return media.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(ends).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")), F.format_string("size=%dx%d", "width", "height"), F.format_string("duration=%d/%d", "duration", "timescale"), F.format_string("samples=%d", "samples"), F.format_string("keyframes=%d", F.size("keyframes")), F.concat(F.lit("ranges="), F.sha2(ranges, 256))).alias("feature"),
    )


