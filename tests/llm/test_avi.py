import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import avi as A


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000) | st.just(b"\xff" * 4200))
def test_exact_round_trip(payload):
    media = A.write(payload)
    back, pictures = A.read(media)
    assert back == A.padded(payload) and len(back) % 64 == 0 and back
    assert len(pictures) == -(-len(back) // 4096) and media == A.write(payload)


def bits_of(v, size):
    return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def jpeg(dc, across, down, colour=False):
    """A frame with DC coefficients only, by its own variable-length tables."""
    counts = [0, 1, 2, 2, 3, 1] + [0] * 10
    table, code, k = {}, 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            table[k] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    out, last = "", 0
    for v in dc:
        size = abs(v - last).bit_length()
        out += table[size] + bits_of(v - last, size) + "0"  # 0: end of block
        if colour:
            out += (table[0] + "0") * 2
        last = v
    out += "1" * (-len(out) % 8)
    scan = int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")
    n = 3 if colour else 1
    parts = b"".join(bytes([i, 0x11, 0]) for i in range(1, n + 1))
    used = b"".join(bytes([i, 0]) for i in range(1, n + 1))
    return (
        b"\xff\xd8" + A._segment(0xE0, b"JFIF\0") + A._segment(0xDB, b"\0" + b"\x02" * 64)
        + A._segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, n) + parts)
        + A._segment(0xC4, b"\0" + bytes(counts) + bytes(range(9))) + A._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
        + A._segment(0xDA, bytes([n]) + used + b"\0\x3f\0") + scan + b"\xff\xd9"
    )


@pytest.mark.parametrize("colour", [False, True])
def test_general_baseline_frames(colour):
    dc = [5, -7, 100, 0, 3, -120]
    zig, samples = A.decode_frame(jpeg(dc, 3, 2, colour))
    assert zig[:, 0].tolist() == dc and samples.shape == (16, 24)
    assert [int(samples[8 * (i // 3), 8 * (i % 3)]) for i in range(6)] == [int(np.clip(np.rint(2 * v / 8 + 128), 0, 255)) for v in dc]


def movie(levels):
    return A.write_frames([jpeg([v] * 4, 2, 2) for v in levels], 16, 16, fps=10)


def test_shots_and_clips(spark):
    media = movie([0] * 10 + [150] * 5 + [-150] * 10)
    assert A.shots([A.decode_frame(f)[1] for f in A.parse(media).frames]) == [0, 10, 15]
    rows = [(1, media, "x"), (1, media, "y"), (2, b"RIFF", "z"), (3, None, None), (None, A.write(None), "w")]
    out = A.clips(spark.createDataFrame(rows, "doc_id long, media binary, clip string")).collect()
    assert sorted(((r.doc_id or 0, r.clip, r.first_frame, r.last_frame, round(r.start_s, 3), round(r.end_s, 3)) for r in out)) == sorted(
        [(1, 0, 0, 9, 0.0, 1.0), (1, 1, 10, 14, 1.0, 1.5), (1, 2, 15, 24, 1.5, 2.5)] * 2 + [(0, 0, 0, 0, 0.0, 0.04)]
    )


def test_movie_without_index():
    media = movie([0, 10])
    at = media.index(b"idx1")
    cut = media[:at]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert A.parse(cut).frames == A.parse(media).frames


def test_digests(spark):
    texts = [None, "", "abc", "ü" * 5000, "ü" * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    out = {r.doc_id: r for r in A.digests(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = A.padded(raw)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert out[3][1:] == out[4][1:] and out[0][1:] == out[1][1:]
    assert A.digests(docs.limit(0)).count() == 0
    assert A.read(A.encode(docs).where("doc_id = 3").first().media)[0] == A.padded(("ü" * 5000).encode())


def test_feature_lists_all_cuts(monkeypatch):
    monkeypatch.setattr(A, "shots", lambda pictures: list(range(100)))
    assert f";cuts={','.join(map(str, range(100)))};" in A.digest(b"text")[-1]


def test_malformed_files_yield_no_clips(spark):
    good = A.write(b"some text " * 2000)
    at = good.index(b"avih")
    no_rate = good.replace(good[at + 8 : at + 12], b"\0\0\0\0", 1)
    short = good[: at + 4] + (8).to_bytes(4, "little") + good[at + 8 : at + 16] + good[at + 8 + 56 :]
    empty = b"RIFF" + (16).to_bytes(4, "little") + b"AVI LIST" + (4).to_bytes(4, "little") + b"movi"
    for bad in (short, empty, good[:200], b"RIFF", b""):
        with pytest.raises(ValueError):
            A.parse(bad)
    rows = [(k, b) for k, b in enumerate([good, no_rate, short, empty, good[:200], b"", None, good.replace(b"\xff\xda", b"\xff\xd9")])]
    out = A.clips(spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in out} <= {0, 1} and any(r.doc_id == 0 for r in out)
