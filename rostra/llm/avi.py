"""Media columns: AVI motion-JPEG.

``write`` stores any bytes losslessly in an AVI file: each run of 64 bytes is the 64 quantised coefficients of one
8x8 block of a baseline JPEG frame.  JPEG codes a coefficient of size category 8 as eight free bits, which take all
256 values, so a byte and such a coefficient correspond one to one; both Huffman tables hold only that category, with
a code of one bit, so a block is 64 x 9 bits = 72 bytes.  A restart marker after each block resets the DC prediction.

``parse`` reads the RIFF chunks and the idx1 index of any AVI file; ``decode_frame`` decodes baseline JPEG frames
(any Huffman tables, sampling factors, restart intervals) to coefficients and luma samples; ``shots`` cuts where the
difference of neighbouring luma histograms exceeds an adaptive threshold (mean + 3 deviations of the differences in a
window around it, and a floor).  ``clips`` turns a column of files into timed clip rows.

Defined cases: a null payload counts as empty and is stored as one block of zeros; equal payloads give equal files;
a file without frames yields no clips; a malformed one, or one without a frame rate, raises ValueError in ``parse`` and
yields no clips in ``clips``; very long texts are files of many frames, made and read whole; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 8  # blocks across a stored frame, and at most down
FPS = 25
WINDOW = 12
FLOOR = 0.12

# The zigzag order of JPEG, from a rule.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Samples of a block from its coefficients: the inverse DCT as one matrix.
_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
IDCT = np.kron(_C, _C).astype(np.float32)


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % 64 or (0 if payload else 64))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    one_code = lambda cls: bytes([cls << 4]) + bytes([1] + [0] * 15) + bytes([8])  # noqa: E731  a table with one code of one bit, for category 8
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, one_code(0))
        + _segment(0xC4, one_code(1))
        + _segment(0xDD, b"\x00\x01")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _coded(blocks: np.ndarray) -> np.ndarray:
    """Rows of 64 bytes as rows of 72: a 0 bit, the one Huffman code, before each byte."""
    bits = np.zeros((len(blocks), 64, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    return np.packbits(bits.reshape(len(blocks), 576), axis=1)


def _plain(coded: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(coded, axis=1).reshape(-1, 64, 9)[:, :, 1:].reshape(-1, 512), axis=1)


def coefficients(blocks: np.ndarray) -> np.ndarray:
    """The coefficient of category 8 that each byte stands for: 128 to 255, or -255 to -128."""
    v = blocks.astype(np.int16)
    return np.where(v < 128, v - 255, v)


def _frame(payload: bytes) -> bytes:
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    across = min(SIDE, len(blocks))
    down = -(-len(blocks) // across)
    if len(blocks) < across * down:
        blocks = np.concatenate([blocks, np.zeros((across * down - len(blocks), 64), np.uint8)])
    coded = _coded(blocks)
    if (coded == 255).any():  # a data byte FF is followed by 00
        scan = b"".join(r.tobytes().replace(b"\xff", b"\xff\x00") + bytes([255, 208 + i % 8]) for i, r in enumerate(coded))[:-2]
    else:
        marks = np.empty((len(coded), 2), np.uint8)
        marks[:, 0], marks[:, 1] = 255, 208 + np.arange(len(coded)) % 8
        scan = np.concatenate([coded, marks], axis=1).tobytes()[:-2]
    return _head(8 * across, 8 * down) + scan + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_frames(frames: list[bytes], width: int, height: int, fps: int = FPS, private: bytes = b"") -> bytes:
    """An AVI file of JPEG frames with an idx1 index; private goes to the stream's strd chunk."""
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, max(map(len, frames), default=0), width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), max(map(len, frames), default=0), 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", private) if private else b"")
    index, at, movi = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", strl)) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def write(payload: bytes | None) -> bytes:
    """The payload, padded, as an AVI file."""
    data = padded(payload or b"")
    step = 64 * SIDE * SIDE
    frames = [_frame(data[i : i + step]) for i in range(0, len(data), step)]
    blocks = min(len(data), step) // 64
    return write_frames(frames, 8 * min(SIDE, blocks), 8 * -(-blocks // SIDE), private=struct.pack("<Q", len(data)))


@dataclass
class Movie:
    fps: float
    width: int
    height: int
    private: bytes
    frames: list[bytes]


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("a chunk goes beyond its parent")
        yield name, at + 8, at + 8 + n
        at += 8 + n + n % 2


def parse(data: bytes) -> Movie:
    """Read the header and the frames; through idx1 where there is one, else in order of the movi chunks."""
    view = memoryview(data)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    movie, movi, index = Movie(0.0, 0, 0, b"", []), None, b""

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        for name, a, b in _chunks(view, at, end):
            if name == b"LIST" and bytes(view[a : a + 4]) == b"movi":
                movi = (a, b)
            elif name == b"LIST":
                walk(a + 4, b)
            elif name == b"avih":
                if b - a < 40:
                    raise ValueError("a short avih header")
                movie.fps = 1e6 / max(1, struct.unpack_from("<I", view, a)[0])
                movie.width, movie.height = struct.unpack_from("<II", view, a + 32)
            elif name == b"strh" and bytes(view[a : a + 4]) == b"vids":
                if b - a < 28:
                    raise ValueError("a short strh header")
                scale, rate = struct.unpack_from("<II", view, a + 20)
                movie.fps = rate / scale if scale and rate else movie.fps
            elif name == b"strd":
                movie.private = bytes(view[a:b])
            elif name == b"idx1":
                index = bytes(view[a:b])

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if not movie.fps:
        raise ValueError("no frame rate")
    is_video = lambda name: name[2:] in (b"dc", b"db")
    if index:
        base = movi[0]
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        if entries and bytes(view[base + entries[0][2] : base + entries[0][2] + 4]) != entries[0][0]:
            base = 0  # some writers count from the file's start
        for name, _, offset, n in entries:
            if is_video(name):
                movie.frames.append(bytes(view[base + offset + 8 : base + offset + 8 + n]))
    else:
        movie.frames = [bytes(view[a:b]) for name, a, b in _chunks(view, movi[0] + 4, movi[1]) if is_video(name)]
    return movie


@dataclass
class _Component:
    h: int
    v: int
    quant: int
    dc: dict = None
    ac: dict = None


def _segments(frame: bytes) -> tuple[dict, bytes]:
    """What the markers up to the scan say, and the scan's bytes."""
    head = {"quant": {}, "huffman": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                head["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                count = body[1:17]
                total, code, symbols, table = sum(count), 0, body[17 : 17 + sum(count)], {}
                k = 0
                for length, c in enumerate(count, 1):
                    for _ in range(c):
                        table[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                head["huffman"][body[0]] = table
                body = body[17 + total :]
        elif marker == 0xC0:
            _, head["height"], head["width"], count = struct.unpack_from(">BHHB", body)
            head["parts"] = {body[6 + 3 * i]: _Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            head["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                part, t = head["parts"][body[1 + 2 * i]], body[2 + 2 * i]
                part.dc, part.ac = head["huffman"][t >> 4], head["huffman"][0x10 | t & 15]
            end = frame.rfind(b"\xff\xd9")
            return head, frame[at : end if end >= at else len(frame)]
    raise ValueError("no scan")


_ONE = {(1, 0): 8}


def scan_blocks(head: dict, scan: bytes) -> np.ndarray | None:
    """For a frame as _frame writes them: the coded blocks, rows of 72 bytes; None for any other."""
    parts = list(head["parts"].values())
    if len(parts) != 1 or head["restart"] != 1 or parts[0].dc != _ONE or parts[0].ac != _ONE:
        return None
    blocks = -(-head["width"] // 8) * -(-head["height"] // 8)
    if len(scan) == blocks * 74 - 2:
        return np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(-1, 74)[:, :72]
    rows, at = [], 0
    for _ in range(blocks):
        row = bytearray()
        while len(row) < 72:
            row.append(scan[at])
            at += 2 if scan[at] == 255 else 1
        at += 2
        rows.append(row)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 72)


def _bits(scan: bytes) -> Iterator[int]:
    for b in scan.replace(b"\xff\x00", b"\xff"):
        for k in range(7, -1, -1):
            yield b >> k & 1


def _symbol(bits: Iterator[int], table: dict) -> int:
    code = 0
    for length in range(1, 17):
        code = code << 1 | next(bits)
        if (length, code) in table:
            return table[length, code]
    raise ValueError("no such code")


def _value(bits: Iterator[int], size: int) -> int:
    v = 0
    for _ in range(size):
        v = v << 1 | next(bits)
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a baseline JPEG: the first component's quantised coefficients (blocks x 64, zigzag order) and its samples."""
    head, scan = _segments(frame)
    parts = list(head["parts"].values())
    luma = parts[0]
    if (coded := scan_blocks(head, scan)) is not None:
        zig = coefficients(_plain(coded))
        return zig, _samples(zig, head, -(-head["width"] // 8))
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    alone = len(parts) == 1
    across, down = -(-head["width"] // (8 if alone else 8 * most_h)), -(-head["height"] // (8 if alone else 8 * most_v))
    wide = across * (1 if alone else luma.h)
    out = np.zeros((wide * down * (1 if alone else luma.v), 64), np.int32)
    pieces = []
    start = 0
    for i in range(len(scan) - 1):
        if scan[i] == 255 and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[start:i])
            start = i + 2
    pieces.append(scan[start:])
    step = head["restart"] or across * down
    for n, piece in enumerate(pieces):
        bits, last = _bits(piece), [0] * len(parts)
        for mcu in range(n * step, min((n + 1) * step, across * down)):
            for c, p in enumerate(parts):
                for y in range(1 if alone else p.v):
                    for x in range(1 if alone else p.h):
                        block = np.zeros(64, np.int32)
                        last[c] += _value(bits, _symbol(bits, p.dc))
                        block[0], k = last[c], 1
                        while k < 64:
                            s = _symbol(bits, p.ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                block[k] = _value(bits, s & 15)
                            k += 1
                        if c == 0:
                            row, col = (mcu // across) * (1 if alone else p.v) + y, (mcu % across) * (1 if alone else p.h) + x
                            out[row * wide + col] = block
    return out, _samples(out, head, wide)


def _samples(zig: np.ndarray, head: dict, wide: int) -> np.ndarray:
    quant = head["quant"][list(head["parts"].values())[0].quant]
    natural = np.zeros((len(zig), 64), np.float32)
    natural[:, ZIGZAG] = zig * quant
    pixels = np.clip(np.rint(natural @ IDCT) + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(-1, wide, 8, 8).swapaxes(1, 2).reshape(-1, wide * 8)[: head["height"], : head["width"]]


def read(data: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload that write() stored, and the luma samples of each frame."""
    movie = parse(data)
    blocks, pictures = [], []
    for f in movie.frames:
        zig, samples = decode_frame(f)
        blocks.append(np.where(zig < 0, zig + 255, zig).astype(np.uint8))
        pictures.append(samples)
    return np.concatenate(blocks).tobytes()[: struct.unpack("<Q", movie.private)[0]], pictures


def shots(pictures: list[np.ndarray]) -> list[int]:
    """The first frame of each shot."""
    if not pictures:
        return []
    hist = np.stack([np.bincount(p.reshape(-1) >> 2, minlength=64) / p.size for p in pictures])
    change = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts = [0]
    for i, d in enumerate(change):
        near = np.delete(change[max(0, i - WINDOW) : i + WINDOW + 1], min(i, WINDOW))
        if d > FLOOR and (not len(near) or d > near.mean() + 3 * near.std()):
            cuts.append(i + 1)
    return cuts


def clips(files: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, clip (from 0), first_frame, last_frame, start_s and end_s of each shot of each file."""
    kind = files.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    movie = parse(data.as_py() or b"")
                    first = shots([decode_frame(f)[1] for f in movie.frames])
                except (ValueError, KeyError, IndexError, StopIteration, RuntimeError, TypeError, AttributeError, struct.error):
                    continue  # a frame may be malformed in any way
                for n, (a, b) in enumerate(zip(first, [*first[1:], len(movie.frames)], strict=True)):
                    rows.append((k, n, a, b - 1, a / movie.fps, b / movie.fps))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if i == 0 else x for x in c], t) for i, (c, t) in enumerate(zip(cols, types, strict=True))], ["k", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    return files.select(key, column).mapInArrow(cut, f"`{key}` {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double")


def encode(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and media: each whole text, as UTF-8, in an AVI file."""
    kind = docs.schema[key].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(t.as_py()) for t in part.column(1).cast(pa.binary())], pa.binary())], ["k", "media"])

    return docs.select(key, column).mapInArrow(written, f"`{key}` {kind}, media binary")


DIGEST = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def digest(text: bytes | None) -> tuple:
    """Store a payload, read it back from the stored bytes, and describe both."""
    media = write(text)
    payload, pictures = read(media)
    cuts = shots(pictures)
    light = [round(float(p.mean()), 3) for p in pictures]
    feature = f"frames={len(pictures)};shots={len(cuts)};cuts={','.join(map(str, cuts))};light={sum(light) / len(light):.3f};range={max(light) - min(light):.3f}"
    return len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and the columns of DIGEST for each row; the files themselves aren't kept."""
    kind = docs.schema[key].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(digest(t.as_py()) for t in batch.column(1).cast(pa.binary())), strict=True)) or [[] for _ in DIGEST]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(cols, DIGEST.values(), strict=True))], ["k", *DIGEST])

    return docs.select(key, column).mapInArrow(digested, ", ".join([f"`{key}` {kind}", *(f"{k} {t}" for k, t in DIGEST.items())]))
