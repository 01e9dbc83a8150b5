"""Media columns: GIF89a files in a binary column, and their timed frames as nested rows.

``text_to_gif`` stores bytes as 8-bit samples of five or more greyscale frames, moved about on a canvas
a little larger than they are: plain; with a palette of its own and a transparent index; interlaced
and taken back; with a palette of its own, then cleared; and so on. A payload of fewer rows is one
plain frame. ``gif_frames`` reads any GIF: LZW code streams, global and local
palettes, interlacing, transparency and disposal; every frame is painted on the canvas, of which the
histogram is taken. Both work row by row inside Arrow batches, without a shuffle, so one very long
row costs its own size only.

Defined results: a null text counts as empty; null media gives null frames; bytes that are no
readable GIF give null frames too; rows that repeat are stored and read alike; an empty table gives
no rows; other columns pass through, and an output replaces a column that has its name.
"""

from __future__ import annotations

import functools
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.llm.common import named, slices

#: Samples in a row of a frame; payloads are padded to a multiple of it.
WIDTH = 192
#: Rows of a frame at most: 65,280 samples, so that a frame's sides fit GIF's 16 bits.
ROWS = 340
#: Frames that a payload of as many rows is parted into at least, so that each way to store one shows in the next.
FRAMES = 5
#: Columns and rows that the canvas has beyond a frame; frames are moved about within them.
MARGIN_X, MARGIN_Y = 8, 4
#: Index that the second of each four of our own frames shows through: the space.
SEEN_THROUGH = 32
DELAY_MS = 100
_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4096
#: Codes between two clear codes of our own streams: the table is then just full.
_RUN = _FULL - _FIRST

_HIGH_BITS = np.array([16, 4, 1], np.uint8)

_FRAME = pa.struct(
    [
        ("frame", pa.int32()),
        ("delay_ms", pa.int32()),
        ("x", pa.int32()),
        ("y", pa.int32()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("disposal", pa.int32()),
        ("transparent", pa.int32()),
        ("samples", pa.binary()),
        ("canvas_rgb", pa.binary()),
        ("histogram", pa.list_(pa.int64())),
    ]
)
FRAMES_DDL = (
    "array<struct<frame:int,delay_ms:int,x:int,y:int,width:int,height:int,disposal:int,"
    "transparent:int,samples:binary,canvas_rgb:binary,histogram:array<bigint>>>"
)


@functools.lru_cache(64)
def code_widths(n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each of the first n codes after a clear code, for a code size of least bits, and where each ends."""
    size = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    widths = np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, least + 1, 12)
    return widths, np.cumsum(widths)


_OWN_WIDTHS = code_widths(_RUN + 1, 8)[0]
_SINGLES = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """A code stream of 8-bit samples, with a clear code at its start and whenever the table is full."""
    codes: list[int] = []
    emit = codes.append
    table: dict[int, int] = {}  # prefix code * 256 + sample -> code * 256
    free, full = _FIRST << 8, _FULL << 8
    prefix = data[0] << 8 if data else None
    for b in data[1:]:
        key = prefix + b
        if key in table:
            prefix = table[key]
        else:
            emit(prefix)
            table[key] = free
            prefix = b << 8
            free += 256
            if free == full:
                emit(_CLEAR << 8)
                table.clear()
                free = _FIRST << 8
    if prefix is not None:
        emit(prefix)
    emit(_END << 8)
    values = np.frombuffer(array("I", [_CLEAR << 8, *codes]), np.uint32) >> 8
    widths = np.concatenate([[9], np.resize(_OWN_WIDTHS, len(codes))])
    out = bytearray()
    spots = np.arange(12)
    for at in range(0, len(values), 1 << 16):  # 2^16 codes take a whole number of bytes only by chance
        part, wide = values[at : at + (1 << 16)], widths[at : at + (1 << 16)]
        bits = ((part[:, None] >> spots) & 1).astype(np.uint8)[spots < wide[:, None]]
        if at:
            bits = np.concatenate([left, bits])
        whole = len(bits) // 8 * 8
        left = bits[whole:]
        out += np.packbits(bits[:whole], bitorder="little").tobytes()
    return bytes(out) + np.packbits(left, bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, n: int) -> bytes:
    """The first n samples of a code stream; a stream that ends early is filled up with sample 0."""
    clear, end = 1 << least, (1 << least) + 1
    bits = len(stream) * 8
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    triple = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    singles = [*_SINGLES[:clear], b"", b""]
    out: list[bytes] = []
    got, at = 0, 0
    while at < bits and got < n:
        span = 4096
        while True:
            widths, ends = code_widths(span, least)
            fit = int(np.searchsorted(ends, bits - at, "right"))
            starts = at + ends[:fit] - widths[:fit]
            codes = (triple[starts >> 3] >> (starts & 7)) & ((1 << widths[:fit]) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or fit < span:
                break
            span *= 4
        stop = int(stops[0]) if len(stops) else fit
        table = singles.copy()
        add, began, size = table.append, len(out), clear + 2
        run = codes[:stop].tolist()
        # The first code adds no entry; each later one adds one until the table is full. Entries stay, so they are read out at the end.
        room = 1 + _FULL - size
        try:
            prev = table[run[0]] if run else b"-"
            if not prev:
                raise IndexError
            for code in run[1:room]:
                if code < size:
                    entry = table[code]
                elif code == size:
                    entry = prev + prev[:1]
                else:
                    raise IndexError
                add(prev + entry[:1])
                size += 1
                prev = entry
            out += [table[code] for code in run]
        except IndexError:
            raise ValueError("a code that no entry stands for") from None
        got += sum(map(len, out[began:]))
        if not len(stops) or codes[stop] == end:
            break
        at += int(ends[stop])
    return b"".join(out)[:n].ljust(n, b"\0")


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes with their lengths before them, and the empty one that ends them."""
    parts = []
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        parts += (_SINGLES[len(part)], part)
    return b"".join(parts) + b"\0"


def frame_heights(rows: int) -> list[int]:
    """Rows of each frame of a payload of so many rows."""
    n = 1 if rows < FRAMES else max(FRAMES, -(-rows // ROWS))
    return [rows * (i + 1) // n - rows * i // n for i in range(n)]


def frame_place(n: int) -> tuple[int, int]:
    """Column and row of the n-th frame on the canvas."""
    return n * 3 % (MARGIN_X + 1), n * 2 % (MARGIN_Y + 1)


def encode_gif(payload: bytes, width: int = WIDTH, delay_ms: int = DELAY_MS) -> bytes:
    """A payload of a positive multiple of width bytes, as frames that overlap; of four, each is stored another way."""
    heights = frame_heights(len(payload) // width)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width + MARGIN_X, max(heights) + MARGIN_Y, 0xF7, 0, 0), grey]
    at = 0
    for n, rows in enumerate(heights):
        frame, kind = payload[at : at + rows * width], n % 4
        at += rows * width
        disposal, clear = (1, 1, 3, 2)[kind], kind == 1
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | clear, delay_ms // 10, SEEN_THROUGH if clear else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", *frame_place(n), width, rows, 0x40 if kind == 2 else 0x87 if kind % 2 else 0))
        if kind % 2:
            out.append(grey[::-1])
        if kind == 2:
            frame = np.frombuffer(frame, np.uint8).reshape(rows, width)[_interlaced(rows)].tobytes()
        out.append(b"\x08" + _blocks(lzw_encode(frame)))
    return b"".join(out) + b"\x3b"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)


def _palette(reader: _Reader, flags: int) -> bytes | None:
    return reader.take(3 << (flags & 7) + 1) if flags & 0x80 else None


@functools.lru_cache(64)
def _paints(palette: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins and colours of all 256 indices; those that the palette lacks are black."""
    full = np.zeros((256, 3), np.uint8)
    full[: len(palette) // 3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    return (full >> 6) @ _HIGH_BITS, full


@functools.lru_cache(1024)
def _interlaced(h: int) -> np.ndarray:
    """The order in which an interlaced frame has its rows: 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, .."""
    return np.array([*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)], np.int64)


def _rows_in_order(samples: np.ndarray) -> np.ndarray:
    out = np.empty_like(samples)
    out[_interlaced(len(samples))] = samples
    return out


def decode_gif(data: bytes, canvas: bool = True) -> list[dict]:
    """Every frame as stored (samples) and as shown (canvas_rgb: transparent pixels and disposal applied).

    histogram: pixels of the shown canvas by the two high bits of red, green and blue, 64 counts;
    pixels that nothing has painted yet count as the background's black. canvas: also paint and keep
    the colours themselves, not their histogram bins only.
    """
    reader = _Reader(data)
    if reader.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", reader.take(7))
    shared = _palette(reader, flags)
    # What is painted: bins of colours and, if asked for, the colours.
    layers = [np.zeros((height, width), np.uint8)] + [np.zeros((height, width, 3), np.uint8)] * canvas
    frames: list[dict] = []
    disposal, delay, clear_index = 0, 0, None
    while True:
        kind = reader.take(1)
        if kind == b"\x3b":
            return frames
        if kind == b"\x21":
            label, body = reader.take(1), reader.blocks()
            if label == b"\xf9" and len(body) >= 4:
                packed, hundredths, index = struct.unpack("<BHB", body[:4])
                disposal, delay, clear_index = packed >> 2 & 7, hundredths * 10, index if packed & 1 else None
            continue
        if kind != b"\x2c":
            raise ValueError("an unknown block")
        x, y, w, h, flags = struct.unpack("<HHHHB", reader.take(9))
        own = _palette(reader, flags)
        palette = shared if own is None else own
        least = reader.take(1)[0]
        if palette is None or not 2 <= least <= 8:
            raise ValueError("no palette, or a code size out of range")
        samples = np.frombuffer(lzw_decode(reader.blocks(), least, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            samples = _rows_in_order(samples)
        inside = samples[: max(0, height - y), : max(0, width - x)]
        before = [layer.copy() for layer in layers] if disposal == 3 else None
        for layer, paint in zip(layers, _paints(palette), strict=False):
            part = layer[y : y + h, x : x + w]
            if clear_index is None:
                part[:] = paint[inside]
            else:
                seen = inside != clear_index
                part[seen] = paint[inside[seen]]
        frames.append(
            {
                "frame": len(frames), "delay_ms": delay, "x": x, "y": y, "width": w, "height": h, "disposal": disposal,
                "transparent": clear_index, "samples": samples.tobytes(), "canvas_rgb": layers[1].tobytes() if canvas else None,
                "histogram": np.bincount(layers[0].ravel(), minlength=64).tolist(),
            }
        )
        if disposal == 2:  # the background's place is left unpainted
            for layer in layers:
                layer[y : y + h, x : x + w] = 0
        elif disposal == 3:
            layers = before
        disposal, delay, clear_index = 0, 0, None


def text_to_gif(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df without its text, with the text's UTF-8 bytes (padded with spaces) stored as a GIF."""
    rest = [named(c) for c in df.columns if c not in (text_col, media_col)]
    source = df.select(*rest, F.coalesce(named(text_col), F.lit("")).cast("binary").alias(media_col))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col):
            media = []
            for text in part.column(media_col).to_pylist():
                media.append(encode_gif(text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")))
            columns = [*part.columns[:-1], pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return source.mapInArrow(store, T.StructType([*df.select(*rest).schema.fields, T.StructField(media_col, T.BinaryType())]))


def gif_frames(df: DataFrame, media_col: str = "media", frames_col: str = "frames", canvas: bool = True) -> DataFrame:
    """df with one more column: the frames of its media. canvas: also keep each shown canvas as RGB."""
    df = df.drop(frames_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col):
            frames = []
            for data in part.column(media_col).to_pylist():
                try:
                    frames.append(None if data is None else decode_gif(data, canvas))
                except ValueError:
                    frames.append(None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(frames, pa.list_(_FRAME))], names=[*part.schema.names, frames_col])

    return df.mapInArrow(read, T.StructType([*df.schema.fields, T.StructField(frames_col, T._parse_datatype_string(FRAMES_DDL))]))


def payload_of(frames_col: str) -> Column:
    """All samples of the frames, one after another."""
    return F.aggregate(F.col(frames_col), F.lit(b""), lambda got, f: F.concat(got, f["samples"]))
