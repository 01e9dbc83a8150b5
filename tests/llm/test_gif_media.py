"""GIF columns: exact round trips, and the rules of frames on hand-made files."""

import hashlib
import random
from collections import Counter
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import gif_media as op
from sievegrid.llm.queries import op6_gif_media


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9, bytes(range(256)) * 40, random.Random(1).randbytes(70_000), b"\0" * 70_000])
def test_lzw_round_trip(data):
    assert op.lzw_decode(op.lzw_encode(data), 8, len(data)) == data


def gif(frames, size=(2, 2), palette=(b"\x00\x00\x00", b"\xff\x00\x00", b"\x00\xff\x00", b"\x00\x00\xff")):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF1, 0, 0), b"".join(palette)]
    for (x, y, w, h), samples, disposal, clear, interlaced in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlaced else 0) + b"\x08" + op._blocks(op.lzw_encode(bytes(samples))))
    return b"".join(out) + b"\x3b"


def colours(frame):
    rgb = frame["canvas_rgb"]
    return [{b"\0\0\0": 0, b"\xff\0\0": 1, b"\0\xff\0": 2, b"\0\0\xff": 3}[rgb[i : i + 3]] for i in range(0, len(rgb), 3)]


def test_disposal_and_transparency():
    frames = [((0, 0, 2, 2), [1, 1, 1, 1], 1, None, False), ((0, 0, 2, 1), [2, 0], 3, 0, False), ((1, 1, 1, 1), [3], 2, None, False), ((0, 0, 1, 1), [0], 0, 0, False)]
    got = op.decode_gif(gif(frames))
    assert [colours(f) for f in got] == [[1, 1, 1, 1], [2, 1, 1, 1], [1, 1, 1, 3], [1, 1, 1, 0]]
    assert [f["delay_ms"] for f in got] == [70] * 4 and all(sum(f["histogram"]) == 4 for f in got)
    assert [f["histogram"] for f in op.decode_gif(gif(frames), canvas=False)] == [f["histogram"] for f in got]


def test_interlacing():
    rows = list(range(4)) * 3
    order = [*range(0, 12, 8), *range(4, 12, 8), *range(2, 12, 4), *range(1, 12, 2)]
    got = op.decode_gif(gif([((0, 0, 1, 12), [rows[r] for r in order], 0, None, True)], (1, 12)))
    assert list(got[0]["samples"]) == rows


def test_broken_files_and_clashing_columns(spark):
    good = op.encode_gif(b" " * 192)
    df = spark.createDataFrame([(1, bytearray(good), 5), (2, None, 5), (3, bytearray(b"GIF89a"), 5), (4, bytearray(good[:-9]), 5)], "doc_id long, media binary, frames int")
    got = {r.doc_id: r.frames for r in op.gif_frames(df).collect()}
    assert len(got[1]) == 1 and got[2] is got[3] is got[4] is None
    texts = spark.createDataFrame([(1, None, 7)], "doc_id long, text string, media int")
    assert bytes(op.text_to_gif(texts).first().media) == good and op.text_to_gif(texts.where("false")).count() == 0


def plain_feature(payload):
    """Frames painted pixel by pixel: plain; reversed greys seen through at spaces; plain, taken back; reversed greys, cleared."""
    rows = len(payload) // 192
    n = 1 if rows < 5 else max(5, -(-rows // 340))
    cuts = [rows * i // n for i in range(n + 1)]
    frames = [payload[192 * a : 192 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
    wide, high = 200, max(len(f) for f in frames) // 192 + 4
    canvas, bins = [0] * (wide * high), Counter()
    for k, frame in enumerate(frames):
        before = canvas[:]
        places = [(i // 192 + k * 2 % 5) * wide + i % 192 + k * 3 % 9 for i in range(len(frame))]
        for at, s in zip(places, frame, strict=True):
            if k % 4 != 1 or s != 32:
                canvas[at] = 21 * ((255 - s if k % 2 else s) >> 6)
        bins += Counter(canvas)
        if k % 4 == 2:
            canvas = before
        elif k % 4 == 3:
            for at in places:
                canvas[at] = 0
    return f"frames={len(frames)};ms={100 * len(frames)};bins=" + ",".join(f"{b}:{bins[b]}" for b in sorted(bins))


def test_disposal_shows_in_own_files():
    """Restoring and clearing change what later frames of a stored text show."""
    data = op.encode_gif(("Some words of a text. " * 60).encode().ljust(192 * 7, b" "))
    frames = op.decode_gif(data)
    assert [f["disposal"] for f in frames] == [1, 1, 3, 2, 1] and len({(f["x"], f["y"]) for f in frames}) == 5

    def with_disposal(n, disposal):
        parts = data.split(b"\x21\xf9\x04")
        parts[n + 1] = bytes([parts[n + 1][0] & 0b11100011 | disposal << 2]) + parts[n + 1][1:]
        return [f["histogram"] for f in op.decode_gif(b"\x21\xf9\x04".join(parts))]

    own = [f["histogram"] for f in frames]
    assert with_disposal(2, 1)[3] != own[3] and with_disposal(3, 1)[4] != own[4]


def checked(r, text):
    raw = (text or "").encode()
    payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert r.media_bytes > 781 and r.feature == plain_feature(payload)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = op6_gif_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        checked(r, texts[r.doc_id])


def test_odd_rows(spark, tmp_path):
    long = "".join(chr(random.Random(3).randrange(32, 0x2FF)) for _ in range(50)) * 20_000
    rows = [(1, long), (2, None), (3, ""), (3, ""), (None, "x"), (4, "y " * 5000), (5, "y " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_gif_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    for id_, text in rows:
        checked(of[id_], text)
    assert tuple(of[4])[1:] == tuple(of[5])[1:]
