"""GIF: writing samples as frames, and decoding files into timed frames.

``encode`` stores 8-bit samples under a grey palette, LZW-compressed, in frames of fixed width.
``decode`` reads any GIF: global and local palettes, sub-blocks, variable-width LZW codes with
clear codes, interlacing, graphic control (delay, disposal, transparency), and draws every frame
on the canvas: disposal 1 leaves it, 2 clears the frame's area, 3 restores what was there.
``media_columns`` and ``frame_columns`` give what is stored for each file and for each frame.

Cases: a null or empty text is a payload of one row of blanks; very long texts become several
frames; equal texts give equal bytes; a damaged file raises ValueError; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of, longs, ship_code, text_or_empty

WIDTH = 192
ROWS = 1024  #: rows of samples in a frame at most
DELAY = 10  #: hundredths of a second
BINS = 8  #: of each colour's histogram
CYCLE = 3838  #: codes after which a table of 12 bits is full


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    transparent: int | None
    box: tuple[int, int, int, int]  #: left, top, width, height
    samples: np.ndarray  #: palette indexes as stored, height x width
    picture: np.ndarray  #: the canvas after drawing, RGBA


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size."""
    made = np.arange(n) + (1 << least) + 1  # entries the reader has before each code
    bits = np.full(n, least + 1)
    for w in range(least + 1, 12):
        bits += made >= 1 << w
    return bits


def lzw_encode(data: bytes) -> bytes:
    """Codes of 8-bit samples, a clear code at the start and after each full table."""
    codes: list[np.ndarray] = []
    n, i = len(data), 0
    while i < n:
        table: dict[int, int] = {}
        get, out, free = table.get, [256], 258
        emit = out.append
        prefix = data[i]
        i += 1
        stop = False
        for c in memoryview(data)[i:]:
            i += 1
            key = prefix << 8 | c
            code = get(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            prefix = c
            table[key] = free
            free += 1
            if free == 258 + CYCLE:
                stop = True
                break
        if stop:
            i -= 1  # the byte held opens the next table
        else:
            emit(prefix)
        codes.append(np.array(out))
    values = np.concatenate([*codes, [257]])
    width, before = [], 9
    for c in codes:
        own = _widths(len(c), 8)  # of the codes after the clear code, and of the code that ends them
        width.append(np.concatenate([[before], own[: len(c) - 1]]))
        before = int(own[len(c) - 1])
    width = np.concatenate([*width, [before]])
    bits = (values[:, None] >> np.arange(12)) & 1
    keep = np.arange(12) < width[:, None]
    return np.packbits(bits[keep].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, least: int, expected: int) -> bytes:
    """Samples of a code stream; any clear-code habits, any minimum code size."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total = len(data) * 8
    out: list[bytes] = []
    size, at = 0, 0
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    short = _widths(2 * CYCLE, least)
    schedule = short
    past = np.cumsum(schedule)
    while size < expected:
        n = int(np.searchsorted(past, total - at, side="right"))
        if n == 0:
            break
        begin = at + past[:n] - schedule[:n]
        byte = begin >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (begin & 7).astype(np.uint32)) & ((1 << schedule[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stops[0]) if len(stops) else n
        if not len(stops) and n == len(schedule):  # a full table that stays in use
            schedule = _widths(2 * n, least)
            past = np.cumsum(schedule)
            continue
        run = codes[:k].tolist()
        if run:
            table = base.copy()
            add = table.append
            if run[0] >= clear:
                raise ValueError("damaged code stream")
            previous = table[run[0]]
            out.append(previous)
            full = 4096 - len(table)
            for c in run[1 : full + 1]:
                try:
                    entry = table[c]
                except IndexError:
                    if c != len(table):
                        raise ValueError("damaged code stream") from None
                    entry = previous + previous[:1]
                out.append(entry)
                add(previous + entry[:1])
                previous = entry
            out += [table[c] for c in run[full + 1 :]]
            size += sum(map(len, out[-len(run) :]))
        at += int(past[k]) if k < n else int(past[n - 1])
        if k == n or codes[k] == end:
            break
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload's samples, row by row, under a grey palette."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), bytes(x for k in range(256) for x in (k, k, k))]
    for top in range(0, height, rows):
        part = payload[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends too early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    control = (0, 0, None)
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body, at = _gather(data, at)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (delay * 10, packed >> 2 & 7, index if packed & 1 else None)
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        least = data[at]
        body, at = _gather(data, at + 1)
        samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        samples = samples[: w * h].reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        delay, disposal, clear = control
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        part = samples[: area.shape[0], : area.shape[1]]
        shown = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])[part]
        if clear is None:
            area[..., :3] = shown
            area[..., 3] = 255
        else:
            seen = part != clear
            area[seen] = np.concatenate([shown[seen], np.full((int(seen.sum()), 1), 255, np.uint8)], axis=1)
        yield Frame(delay, disposal, clear, (left, top, w, h), samples, canvas)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def histogram(picture: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Counts of the visible pixels in equal bins of red, green and blue."""
    seen = picture[picture[..., 3] > 0]
    return [np.bincount(seen[:, c] // (256 // bins), minlength=bins).tolist() for c in range(3)]


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text padded with blanks to a positive multiple of the unit."""
    n = max(unit, -(-len(text) // unit) * unit)
    return text.ljust(n, b" ")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as a GIF, read back and measured."""
    ship_code(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, text in zip(ids_of(pdf), pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                media = encode(payload_of(raw))
                samples, hist, duration, count = [], np.zeros(BINS, np.int64), 0, 0
                for frame in decode(media):
                    samples.append(frame.samples.tobytes())
                    hist += np.array(histogram(frame.picture[: frame.box[3]])[0])
                    duration += frame.delay_ms
                    count += 1
                back = b"".join(samples)
                row = (name, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, hist.tolist())), count, duration)
                rows.append((*row, media) if with_media else row)
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = longs([r[0] for r in rows])
            yield frame

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    if with_media:
        schema += ", media binary"
    return docs.select(*id_columns(id_col), text_or_empty(text_col).alias("text")).mapInPandas(run, schema)


def frame_columns(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each frame of each file: its time, box, rules and colour histograms."""
    ship_code(media.sparkSession)
    schema = "id long, frame int, start_ms long, delay_ms long, disposal int, transparent int, left int, top int, width int, height int, red array<long>, green array<long>, blue array<long>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, data in zip(pdf["id"], pdf["media"]):
                start = 0
                for k, f in enumerate(decode(bytes(data)) if data is not None else ()):
                    rows.append((name, k, start, f.delay_ms, f.disposal, f.transparent, *f.box, *histogram(f.picture)))
                    start += f.delay_ms
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["transparent"] = out["transparent"].astype("Int32")
            out["id"] = out["id"].astype("Int64")
            yield out

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInPandas(run, schema)
