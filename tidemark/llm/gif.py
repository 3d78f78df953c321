"""GIF media columns.

The codec reads and writes GIF87a/89a: LZW code streams (any minimum code size, early or deferred
clear codes), global and local palettes, interlaced rows, transparency and the four disposal rules.
``gif_frames`` turns a column of GIF files into one row per timed frame, composed on the canvas, with
colour-histogram columns. ``text_gifs`` stores texts losslessly as 8-bit GIF samples and describes what
is read back from the stored bytes.

Bit fields are packed and unpacked with numpy: between two clear codes the width of every code is
known beforehand, so only the dictionary steps run in a Python loop. Memory is bounded by one batch of
8 MB of source text (one longer text stands alone) and one frame at a time.

Defined cases: null text or GIF is empty (a text gives one frame of spaces; an empty GIF has no frames);
equal texts give equal files and values; repeated rows give repeated results; a damaged GIF raises
ValueError in ``decode_gif`` and gives a row with ``error`` set in ``gif_frames``; extra input columns are
left out and can have any name; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Payload bytes per row of pixels, rows per frame, and hundredths of a second per frame of stored texts.
WIDTH, FRAME_ROWS, DELAY_CS = 192, 256, 4
GREY = bytes(v for i in range(256) for v in (i, i, i))
BINS = 8


@lru_cache(maxsize=16)
def _pattern(min_code: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bit at which each begins."""
    first = (1 << min_code) + 2
    sizes = first + np.maximum(0, np.arange((1 << 12) + 512) - 1)
    widths = np.minimum(12, np.floor(np.log2(sizes)).astype(np.int64) + 1)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_encode(pixels: bytes, min_code: int = 8) -> bytes:
    """The code stream of some pixels: a clear code, greedy longest matches, a clear code whenever the table is full, an end code."""
    clear = 1 << min_code
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, put, code = table.get, codes.append, clear + 2
    it = iter(pixels)
    prefix = next(it, None)
    if prefix is not None:
        for byte in it:
            key = prefix << 8 | byte
            nxt = get(key)
            if nxt is not None:
                prefix = nxt
                continue
            put(prefix)
            table[key] = code
            code += 1
            prefix = byte
            if code == 4096:
                codes.append(clear)
                segments.append(codes)
                codes = []
                put = codes.append
                table.clear()
                code = clear + 2
        codes.append(prefix)
    codes.append(clear + 1)
    segments.append(codes)
    widths, _ = _pattern(min_code)
    flat = np.array(segments[0] if len(segments) == 1 else list(chain.from_iterable(segments)), np.uint32)
    w = np.concatenate([[min_code + 1], *(widths[: len(s)] for s in segments)])
    at = np.concatenate([[0], np.cumsum(w)])
    value = np.concatenate([[np.uint32(clear)], flat]).astype(np.uint32) << (at[:-1] & 7).astype(np.uint32)
    out = np.zeros((int(at[-1]) + 7 >> 3) + 3, np.uint8)
    where = at[:-1] >> 3
    for k in range(3):
        part = (value >> np.uint32(8 * k)).astype(np.uint8)
        if min_code >= 7:  # codes are no shorter than a byte, so no two begin in one
            out[where + k] |= part
        else:
            np.bitwise_or.at(out, where + k, part)
    return out[: int(at[-1]) + 7 >> 3].tobytes()


def lzw_decode(stream: bytes, min_code: int, n: int) -> bytes:
    """n pixels of a code stream; ValueError if it is damaged or ends early."""
    if not 1 <= min_code <= 8:
        raise ValueError("minimum code size")
    clear = 1 << min_code
    widths, offsets = _pattern(min_code)
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    base = [bytes((i,)) for i in range(clear)]
    bits, at, made, parts = 8 * len(stream), 0, 0, []
    out: list[bytes] = []  # strings since the last clear code; the j-th table entry is out[j] and the first byte of out[j + 1]
    k = 0  # codes since the last clear code
    while made < n:
        if k < len(widths) - 1:
            w, o = widths[k:], at + offsets[k:-1] - offsets[k]
        else:  # the table has long been full
            w = np.full(4096, 12)
            o = at + 12 * np.arange(4096)
        m = int(np.searchsorted(o + w, bits, "right"))
        if not m:
            raise ValueError("the code stream ends early")
        w, o = w[:m], o[:m]
        i = o >> 3
        codes = (data[i] | data[i + 1] << np.uint32(8) | data[i + 2] << np.uint32(16)) >> (o & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else m
        held, add = len(out), out.append
        for c in codes[:stop].tolist():
            if c < clear:
                add(base[c])
            else:
                j = c - clear - 2
                try:
                    add(out[j] + out[j + 1][:1])
                except IndexError:
                    if j != len(out) - 1:
                        raise ValueError("a code beyond the table") from None
                    add(out[j] + out[j][:1])
        parts.append(b"".join(out[held:]))
        made += len(parts[-1])
        if stop == m:
            k, at = k + stop, int(o[-1] + w[-1])
        elif codes[stop] == clear:
            out, k, at = [], 0, int(o[stop] + w[stop])
        else:
            break
    if made < n:
        raise ValueError("the code stream ends early")
    return b"".join(parts)[:n]


@dataclass
class Frame:
    """One timed frame: its own rectangle, and the whole canvas as shown, as RGB bytes."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # rows x columns x 3


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _rows(height: int) -> np.ndarray:
    """The rows of an interlaced image in stored order."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as a viewer shows them. Uncovered pixels of the canvas are black."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF header")
        wide, high, flags = struct.unpack_from("<HHB", data, 6)
        at, palette = 13, None
        if flags & 128:
            size = 2 << (flags & 7)
            palette, at = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3), at + 3 * size
        canvas = np.zeros((high, wide, 3), np.uint8)
        delay, disposal, clear_index = 0, 0, None
        while True:
            kind = data[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, palette
            if packed & 128:
                size = 2 << (packed & 7)
                own, at = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3), at + 3 * size
            if own is None or left + w > wide or top + h > high:
                raise ValueError("no palette, or an image beyond the canvas")
            min_code = data[at]
            stream, at = _blocks(data, at + 1)
            index = np.frombuffer(lzw_decode(stream, min_code, w * h), np.uint8).reshape(h, w)
            if packed & 64:
                index = index[np.argsort(_rows(h))]
            before = canvas.copy() if disposal == 3 else None
            spot = canvas[top : top + h, left : left + w]
            if index.size and int(index.max()) >= len(own):
                own = np.concatenate([own, np.zeros((256 - len(own), 3), np.uint8)])
            if clear_index is None:
                spot[:] = own[index]
            else:
                seen = index != clear_index
                spot[seen] = own[index[seen]]
            yield Frame(left, top, w, h, 10 * delay, disposal, clear_index, canvas.copy())
            if disposal == 2:
                spot[:] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def encode_gif(frames: list[tuple[int, int, int, int, bytes]], size: tuple[int, int], palette: bytes = GREY, delay_cs: int = DELAY_CS, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a of (left, top, width, height, indexes) frames on a canvas of a size."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    min_code = max(2, depth)
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF0 | depth - 1, 0, 0), palette.ljust(3 << depth, b"\0")]
    for left, top, w, h, pixels in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0, min_code))
        stream = lzw_encode(pixels, min_code)
        out += [x for i in range(0, len(stream), 255) for x in (bytes((min(255, len(stream) - i),)), stream[i : i + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def histogram(rgb: np.ndarray, bins: int = BINS) -> list[int]:
    """Pixels by level of red, then of green, then of blue, each in so many equal bins."""
    return [int(n) for c in range(3) for n in np.bincount(rgb[..., c].ravel() // (256 // bins), minlength=bins)]


def payload_of(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of WIDTH."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b" ")


def store_payload(payload: bytes) -> bytes:
    """A GIF whose grey samples are the payload: WIDTH pixels a row, FRAME_ROWS rows a frame."""
    step = WIDTH * FRAME_ROWS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return encode_gif([(0, 0, WIDTH, len(p) // WIDTH, p) for p in parts], (WIDTH, len(parts[0]) // WIDTH))


def read_payload(media: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """Payload, frames, shown milliseconds and summed grey histogram of a stored GIF, from its composed frames."""
    parts, ms, grey = [], 0, np.zeros(BINS, np.int64)
    for f in decode_gif(media):
        own = np.ascontiguousarray(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0])
        parts.append(own.tobytes())
        ms += f.delay_ms
        grey += np.bincount(own.ravel() >> 5, minlength=BINS)
    return b"".join(parts), len(parts), ms, grey


def text_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back: sizes, digests, a feature string and, if asked for, the file."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *[("media", pa.binary())] * keep_media]
        for b in small_batches(batches, 1):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                media = store_payload(payload_of(raw))
                payload, n, ms, grey = read_payload(media)
                rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={n};ms={ms};grey={','.join(map(str, grey))}", *[media] * keep_media))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(to), to, strict=True)], names=[n for n, _ in to])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def gif_frames(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per timed frame of a binary GIF column: place, times, rules, composed RGB pixels and 24 histogram counts (8 levels of red, green, blue). A damaged file gives its good frames, then a row with error set."""
    schema = "id long, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, disposal int, canvas_width int, canvas_height int, rgb binary, hist array<long>, error string"
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 8, pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for b in small_batches(batches, 1, 1 << 20):
            rows, held = [], 0
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start, k = 0, 0
                try:
                    for k, f in enumerate(decode_gif(data.as_py()) if data.as_py() else ()):  # noqa: B007
                        rows.append((key, k, start, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas), None))
                        start, held = start + f.delay_ms, held + f.canvas.size
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((key, None, start, *[None] * 9, None, str(e)))
            if rows:
                yield batch(rows)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(gif_col).cast("binary").alias("gif")).mapInArrow(run, schema)
