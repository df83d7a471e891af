"""Media columns: ISO media files in a binary column, described and read back by their sample tables without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: A text is stored as grey video of 8-bit pixels: frames of SIDE x SIDE, FRAME bytes, RATE a second, CHUNK of them in a chunk, the first of every GROUP a keyframe.
SIDE, RATE, CHUNK, GROUP = 8, 25, 16, 12
FRAME = SIDE * SIDE

# Fixed values of the container format: the boxes that hold other boxes, and the unity matrix of its headers.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Broken(ValueError):
    """Bytes that are no whole media file."""


# --- writing ---


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join((head, *parts))


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def counted(*values: int, size: int = 4) -> bytes:
    return struct.pack(">I", len(values)) + np.array(values, f">u{size}").tobytes()


def store(payload: bytes) -> bytes:
    """A media file whose samples are ``payload``, a positive multiple of FRAME bytes, pixel by pixel; equal payloads give equal files."""
    frames = len(payload) // FRAME
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload is no positive multiple of {FRAME} bytes")
    start = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isomqt  ")
    data = box(b"mdat", payload)
    first = len(start) + len(data) - len(payload)
    offsets = range(first, first + len(payload), CHUNK * FRAME)
    wide = offsets[-1] >= 1 << 32
    last = frames - CHUNK * (len(offsets) - 1)
    spread = [1, min(CHUNK, frames), 1] + ([len(offsets), last, 1] if 1 < len(offsets) and last < CHUNK else [])
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, b"", 40, -1)
    tables = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
        full_box(b"stts", struct.pack(">III", 1, frames, 1)),
        full_box(b"stss", counted(*range(1, frames + 1, GROUP))),
        full_box(b"stsc", struct.pack(f">I{len(spread)}I", len(spread) // 3, *spread)),
        full_box(b"stsz", struct.pack(">II", FRAME, frames)),
        full_box(b"co64" if wide else b"stco", counted(*offsets, size=8 if wide else 4)),
    )
    info = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), tables)
    media = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), info)
    track = full_box(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    movie = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((start, data, box(b"moov", movie, box(b"trak", track, media))))


# --- reading ---


@dataclass
class Track:
    """A track's description. Sample ranges are byte places in the file; none of the bytes there are looked at."""

    number: int = 0
    kind: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def keyframes(self) -> list[tuple[int, int]]:
        """(start, length) of the keyframes' byte ranges in the order of the samples; those that touch are one."""
        starts, ends = self.starts[self.key], (self.starts + self.sizes)[self.key]
        if not len(starts):
            return []
        cut = np.nonzero(starts[1:] != ends[:-1])[0] + 1
        begins, stops = starts[np.concatenate([[0], cut])], ends[np.concatenate([cut - 1, [-1]])]
        return list(zip(begins.tolist(), (stops - begins).tolist()))


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, begin of body, end) of every box, outer ones first. A size of 1 is followed by 64 bits, one of 0 reaches to the end."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise Broken(f"{end - at} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise Broken("a large box without its size")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise Broken(f"box {kind.decode('latin-1')!r} at {at} reaches past the end")
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        at = stop


def _table(data: memoryview, at: int, end: int, columns: int = 1, size: int = 4) -> np.ndarray:
    """The rows of a counted table of unsigned integers; its count must fit the box."""
    (n,) = _read(data, ">I", at, end)
    if n * columns * size > end - at - 4:
        raise Broken(f"a table of {n} rows does not fit its box")
    return np.frombuffer(data, f">u{size}", n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _read(data: memoryview, form: str, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise Broken("a box is too short")
    return struct.unpack_from(form, data, at)


def describe(data: bytes | memoryview) -> list[Track]:
    """The tracks of a media file, from its boxes alone; samples of fragments are added to their tracks."""
    data, tracks, extras, fragment, base, made = memoryview(data), [], {}, {}, 0, []
    found: dict[bytes, tuple[int, int]] = {}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found = {}
            made.append(found)
        elif path[:2] == (b"moov", b"trak"):
            found[kind] = (at, end)
        elif kind == b"trex":
            number, _, _, size, flags = _read(data, ">5I", at + 4, end)
            extras[number] = (size, flags)
    for found in made:
        tracks.append(_track(data, found))
    by = {t.number: t for t in tracks}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            base = at - 8
        elif path == (b"moof", b"traf", b"tfhd"):
            fragment = _fragment(data, at, end, extras, base)
        elif path == (b"moof", b"traf", b"trun") and fragment.get("number") in by:
            _run(data, at, end, fragment, by[fragment["number"]])
    for t in tracks:
        if len(t.starts) and int((t.starts + t.sizes).max()) > len(data):
            raise Broken("a sample reaches past the end")
    return tracks


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> Track:
    t = Track()
    for kind in (b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc"):
        if kind not in found:
            raise Broken(f"a track without {kind.decode()}")
    at, end = found[b"tkhd"]
    wide = data[at] == 1
    (t.number,) = _read(data, ">I", at + (20 if wide else 12), end)
    at, end = found[b"mdhd"]
    t.timescale, t.duration = _read(data, ">IQ" if data[at] == 1 else ">II", at + (20 if data[at] == 1 else 12), end)
    at, end = found[b"hdlr"]
    t.kind = _name(_read(data, ">4s", at + 8, end)[0])
    at, end = found[b"stsd"]
    (entries,) = _read(data, ">I", at + 4, end)
    if entries:
        size, codec = _read(data, ">I4s", at + 8, end)
        t.codec = _name(codec)
        if t.kind == "vide":
            t.width, t.height = _read(data, ">HH", at + 40, end)
    sizes = _sizes(data, found)
    n = len(sizes)
    times = _table(data, found[b"stts"][0] + 4, found[b"stts"][1], 2)
    if times[:, 0].sum() != n:
        raise Broken("sample times and sizes disagree")
    t.duration = t.duration or int((times[:, 0] * times[:, 1]).sum())
    if not n:
        return t
    wide = b"co64" in found
    if not wide and b"stco" not in found:
        raise Broken("a track without chunk places")
    at, end = found[b"co64" if wide else b"stco"]
    chunks = _table(data, at + 4, end, size=8 if wide else 4)[:, 0]
    runs = _table(data, found[b"stsc"][0] + 4, found[b"stsc"][1], 3)
    begins = runs[:, 0] - 1
    if not len(runs) or begins[0] != 0 or (np.diff(begins) <= 0).any() or begins[-1] >= len(chunks):
        raise Broken("chunks without samples")
    each = np.repeat(runs[:, 1], np.diff(np.append(begins, len(chunks))))
    if each.sum() != n:
        raise Broken("chunks and samples disagree")
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(each) - each
    inside = before - np.repeat(np.append(before, 0)[np.minimum(firsts, n)], each)
    t.starts, t.sizes = np.repeat(chunks, each) + inside, sizes
    t.key = np.ones(n, bool)
    if b"stss" in found:
        marked = _table(data, found[b"stss"][0] + 4, found[b"stss"][1])[:, 0]
        if len(marked) and not 1 <= marked.min() <= marked.max() <= n:
            raise Broken("a keyframe that is no sample")
        t.key = np.zeros(n, bool)
        t.key[marked - 1] = True
    return t


def _sizes(data: memoryview, found: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stsz" in found:
        at, end = found[b"stsz"]
        size, n = _read(data, ">II", at + 4, end)
        if not size:
            return _table(data, at + 8, end)[:, 0]
        if size * n > len(data):
            raise Broken("more samples than bytes")
        return np.full(n, size, np.int64)
    if b"stz2" not in found:
        raise Broken("a track without sample sizes")
    at, end = found[b"stz2"]
    bits, n = _read(data, ">3xBI", at + 4, end)
    if bits not in (4, 8, 16) or (n * bits + 7) // 8 > end - at - 12:
        raise Broken("a table of sample sizes does not fit its box")
    raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", n if bits > 4 else (n + 1) // 2, at + 12).astype(np.int64)
    return raw if bits > 4 else np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]


def _fragment(data: memoryview, at: int, end: int, extras: dict, base: int) -> dict:
    """What a track's fragment says about its samples: bits of its flags tell which fields there are."""
    flags, number = _read(data, ">II", at, end)
    at, out = at + 8, {"number": number, "base": base}
    out["size"], out["flags"] = extras.get(number, (0, 0))
    for bit, name, form in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "time", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & bit:
            (out[name],) = _read(data, form, at, end)
            at += struct.calcsize(form)
    return out


def _run(data: memoryview, at: int, end: int, fragment: dict, track: Track) -> None:
    """Adds a run of samples; sample flags say which are no keyframes."""
    flags, n = _read(data, ">II", at, end)
    flags, at = flags & 0xFFFFFF, at + 8
    place, first = fragment.get("next", fragment["base"]), None
    if flags & 1:
        place = fragment["base"] + _read(data, ">i", at, end)[0]
        at += 4
    if flags & 4:
        (first,) = _read(data, ">I", at, end)
        at += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if n * len(fields) * 4 > end - at or n > len(data):
        raise Broken("a run of samples does not fit its box")
    rows = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
    column = lambda bit, other: rows[:, fields.index(bit)] if bit in fields else np.full(n, other, np.int64)
    sizes, marks = column(0x200, fragment["size"]), column(0x400, fragment["flags"]).copy()
    if first is not None and n:
        marks[0] = first
    track.starts = np.concatenate([track.starts, place + np.cumsum(sizes) - sizes])
    track.sizes = np.concatenate([track.sizes, sizes])
    track.key = np.concatenate([track.key, marks & 0x10000 == 0])
    if 0x100 in fields:
        track.duration += int(column(0x100, 0).sum())
    fragment["next"] = place + int(sizes.sum())


def _name(four: bytes) -> str:
    return four.decode("latin-1")


def stored(data: bytes, track: Track) -> bytes:
    """A track's stored bytes, sample by sample, as they are."""
    ends = track.starts + track.sizes
    cut = np.nonzero(track.starts[1:] != ends[:-1])[0] + 1
    begins, stops = track.starts[np.concatenate([[0], cut])] if len(ends) else [], ends[np.concatenate([cut - 1, [-1]])] if len(ends) else []
    return b"".join(data[a:b] for a, b in zip(begins, stops))


# --- tables ---

TRACKS = (
    "array<struct<number: long, kind: string, codec: string, width: int, height: int, timescale: long, duration: long, samples: long, bytes: long, "
    "keyframes: array<struct<start: long, length: long>>>>"
)
_TRACKS = pa.list_(
    pa.struct(
        [("number", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()),
         ("samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
    )
)


def media_tracks(media_col: str = "media"):
    """Column: (tracks, problem) of the media files in a binary column: codec, duration in units of the timescale and byte ranges of the keyframes of each track.

    A null file has null tracks and no problem; bytes that are no whole media file have null tracks and say in ``problem`` what is wrong.
    """

    @F.arrow_udf(f"struct<tracks: {TRACKS}, problem: string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            tracks, problems = [], []
            for file in files:
                found, problem = None, None
                if file.is_valid:
                    try:
                        found = [_row(t) for t in describe(file.as_buffer())]
                    except Broken as e:
                        problem = str(e)
                tracks.append(found)
                problems.append(problem)
            yield pa.StructArray.from_arrays([pa.array(tracks, _TRACKS), pa.array(problems, pa.string())], ["tracks", "problem"])

    return read(F.col(media_col))


def _row(t: Track) -> dict:
    keys = [{"start": a, "length": n} for a, n in t.keyframes()]
    return {
        "number": t.number, "kind": t.kind, "codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration,
        "samples": len(t.starts), "bytes": int(t.sizes.sum()), "keyframes": keys,
    }


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a media file, filled up with bytes 0 to a positive multiple of FRAME.

    A narrow map, no shuffle; the output goes on in slices of a few MB, a longer text alone. Null and empty texts are one frame of zeros; rows that
    repeat an id are stored one by one; an empty table gives no rows.
    """

    def run(batches):
        for b in slices(batches):
            raw = [t.encode("utf-8") for t in b.column(1).to_pylist()]
            files = [store(r + bytes(-len(r) % FRAME if r else FRAME)) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digest_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of (doc_id, n_bytes, media).

    The payload is what the first track's sample tables lead to in the stored bytes. ``feature`` is codec, size, duration / timescale, samples, and start+length of the keyframes' byte ranges.
    A null or broken file has nulls but for its own length and hash.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in slices(batches, 2):
            rows = [_digest(m.as_py()) for m in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def _digest(file: bytes | None) -> tuple:
    if file is None:
        return (None,) * 6
    whole = len(file), hashlib.sha256(file).hexdigest()
    try:
        tracks = describe(file)
    except Broken:
        tracks = []
    if not tracks:
        return None, None, None, *whole, None
    t = tracks[0]
    payload = stored(file, t)
    keys = ",".join(f"{a}+{n}" for a, n in t.keyframes())
    feature = f"{t.codec.strip()} {t.width}x{t.height} {t.duration}/{t.timescale} {len(t.starts)} {keys}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), *whole, feature
