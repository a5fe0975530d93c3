"""GIF media columns: an LZW encoder and decoder, palettes, disposal, transparency and timed frames, with colour histograms.

Text payloads are stored losslessly as 8-bit palette indices, 64 to a row, in frames of at most ``ROWS`` rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_lists, documents

WIDTH, ROWS, DELAY = 64, 1024, 10  # DELAY: hundredths of a second
MOST = 1 << 26  # pixels of a canvas or a frame
GREY = bytes(c for g in range(256) for c in (g, g, g))


def lzw_codes(data: bytes, root: int) -> list[int]:
    """LZW codes, from a clear code to the end code; the table is cleared when it is full."""
    clear = 1 << root
    codes = [clear]
    if data:
        table: dict[int, int] = {}
        free, prefix = clear + 2, data[0]
        find, add = table.get, codes.append
        for c in memoryview(data)[1:]:
            key = prefix << 8 | c
            code = find(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = c
            if free < 4096:
                table[key] = free
                free += 1
            else:
                add(clear)
                table.clear()
                free = clear + 2
        add(prefix)
    codes.append(clear + 1)
    return codes


def widths_of(k: np.ndarray, root: int) -> np.ndarray:
    """Bits of the k-th code (from 0) after a clear code: as many as the table, that has by then grown to first + k - 1 entries, asks for."""
    return np.clip(np.frexp((1 << root) + 1 + np.maximum(k, 1))[1], root + 1, 12)


@cache
def schedule(root: int, full: bool) -> tuple[np.ndarray, np.ndarray]:
    """Widths of 4096 codes, and the bits before each: after a clear code, or once the table is full."""
    widths = np.full(4096, 12) if full else widths_of(np.arange(4096), root)
    return widths, np.cumsum(widths) - widths


def lzw_encode(data: bytes, root: int = 8) -> bytes:
    codes = np.array(lzw_codes(data, root), np.int64)
    place = np.arange(len(codes))
    cleared = np.maximum.accumulate(np.where(codes == 1 << root, place, -1))
    widths = widths_of(place - np.append(-1, cleared[:-1]) - 1, root)
    end = np.cumsum(widths)
    at = end - widths
    value, byte = codes << (at & 7), at >> 3
    packed = np.bincount(np.concatenate([byte, byte + 1, byte + 2]), weights=np.concatenate([value & 255, value >> 8 & 255, value >> 16]))  # bits don't overlap: sums are unions
    return packed[: -(-int(end[-1]) // 8)].astype(np.uint8).tobytes()


def expanded(codes: np.ndarray, root: int, most: int) -> np.ndarray:
    """Samples of the codes between two clear codes, at most ``most``.

    Entry k of the table is what the k-th code stands for and one sample more, as they stand in the output. So a code's
    length is its entry's code's and one, and each of its samples is a sample further up: both are followed by doubling.
    """
    first = (1 << root) + 2
    literal = codes < first
    entry = np.where(literal, np.arange(len(codes)), codes - first)
    if not literal[0] or (codes[literal] >= first - 2).any() or (entry[~literal] >= np.flatnonzero(~literal)).any():
        raise ValueError("broken code stream")
    length, up = np.where(literal, 0, 1), entry
    while length[up].any():
        length = length + length[up]
        up = up[up]
    end = np.cumsum(length + 1)
    n = int(np.searchsorted(end, most)) + 1
    codes, literal, entry, length, end = codes[:n], literal[:n], entry[:n], length[:n] + 1, end[:n]
    start = end - length
    total = int(end[-1])
    source = np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)
    source += np.repeat((start[entry] - start).astype(source.dtype), length)
    while True:
        further = source.take(source)
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(total, np.uint8)
    samples[start[literal]] = codes[literal]
    return samples[source][:most]


def lzw_decode(stream: bytes, root: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; a short one gives what it holds, a broken one raises ValueError."""
    clear, end = 1 << root, (1 << root) + 1
    raw, bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(stream)
    out, size, at = [], 0, 0
    held: list[np.ndarray] = []  # codes since the last clear code
    k, ended = 0, False
    while not ended and size < most:
        widths, begin = schedule(root, k > 0)
        there = int(np.searchsorted(begin + widths, bits - at, side="right"))
        begin, widths = begin[:there] + at, widths[:there]
        byte = begin >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        held.append(codes[:n])
        if len(stops) or there < 4096:
            ended = not len(stops) or codes[n] == end
            own = np.concatenate(held)
            if len(own):
                out.append(expanded(own, root, most - size))
                size += len(out[-1])
            held, k = [], 0
            at = int(begin[n] + widths[n]) if len(stops) else at
        else:
            k, at = k + 4096, int(begin[-1] + widths[-1])
    return b"".join(x.tobytes() for x in out)


@dataclass
class Frame:
    """One image block: its place, samples (palette indices), palette, transparent index (-1: none), disposal, delay in 1/100 s."""

    left: int
    top: int
    samples: np.ndarray
    palette: bytes
    transparent: int = -1
    disposal: int = 0
    delay: int = 0


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[at : at + 255])]) + data[at : at + 255] for at in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF of frames with palettes of 2 to 256 colours each; a palette equal to the first frame's is written once."""
    root_bits = lambda palette: max(2, (len(palette) // 3 - 1).bit_length())
    padded = lambda palette: palette.ljust(3 << root_bits(palette), b"\0")
    shared = frames[0].palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | root_bits(shared) - 1, 0, 0), padded(shared)]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent >= 0), f.delay, max(0, f.transparent), 0))
        own = f.palette != shared
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0x80 | root_bits(f.palette) - 1 if own else 0))
        if own:
            out.append(padded(f.palette))
        root = root_bits(f.palette)
        out += [bytes([root]), sub_blocks(lzw_encode(f.samples.tobytes(), root))]
    return b"".join([*out, b"\x3b"])


def read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode_frames(data: bytes, most: int = MOST) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames as stored. Interlaced rows are put in order.

    Raises ValueError on what is no GIF, is cut short, or has more than ``most`` pixels in its canvas or in a frame.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > most:
        raise ValueError(f"a canvas of {width} x {height} is too large")
    at, shared = 13, b"\0" * 6
    if flags & 0x80:
        shared = data[13 : 13 + (6 << (flags & 7))]
        at += len(shared)
    frames, disposal, delay, transparent = [], 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            block, after = read_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, struct.unpack_from("<H", block, 1)[0]
                transparent = block[3] if block[0] & 1 else -1
            at = after
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                palette = data[at : at + (6 << (flags & 7))]
                at += len(palette)
            root = data[at]
            if w * h > most or not 2 <= root <= 8:
                raise ValueError(f"a frame of {w} x {h} at {root} bits can't be read")
            stream, at = read_blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, root, w * h), np.uint8)
            if len(samples) < w * h:
                raise ValueError(f"{len(samples)} of {w * h} samples are there")
            samples = samples.reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                samples = samples[np.argsort(order)]
            frames.append(Frame(left, top, samples, palette, transparent, disposal, delay))
            disposal, delay, transparent = 0, 0, -1
        else:
            raise ValueError(f"broken GIF at {at}")
    if at >= len(data):
        raise ValueError("cut short")
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame]):
    """(RGBA canvas, delay) after each frame, by disposal: 2 clears the frame's place, 3 restores what was there before."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        place = canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1]]
        samples = f.samples[: place.shape[0], : place.shape[1]]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette) // 3, :3] = np.frombuffer(f.palette[: len(f.palette) // 3 * 3], np.uint8).reshape(-1, 3)
        palette[:, 3] = 255
        if f.transparent >= 0:
            shown = samples != f.transparent
            place[shown] = palette[samples[shown]]
        else:
            place[:] = palette[samples]
        yield canvas.copy(), f.delay
        if f.disposal == 2:
            place[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(rgba: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of visible pixels by colour, each channel in ``bins`` steps (red slowest)."""
    seen = rgba.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    step = (np.arange(256) * bins // 256).astype(np.int32)
    return np.bincount((step * bins * bins)[seen[:, 0]] + (step * bins)[seen[:, 1]] + step[seen[:, 2]], minlength=bins**3)


def payload_gif(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as an animation of grey samples."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, samples[at : at + ROWS], GREY, disposal=1, delay=DELAY) for at in range(0, len(samples), ROWS)]
    return encode_gif(frames, WIDTH, min(ROWS, len(samples)))


def payload_of(frames: list[Frame]) -> bytes:
    """The samples' grey levels, frame by frame, through each frame's palette."""
    return b"".join(np.frombuffer(f.palette, np.uint8)[::3][f.samples].tobytes() for f in frames)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def storing(batches):
    for b in batches:
        texts, ids = byte_lists(b.column("text")), b.column("doc_id")
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            media = [payload_gif(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in part]
            yield batch(MEDIA, ids[at : at + 500].to_pylist(), [len(t) for t in part], media)


def text_gifs(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8; null text: none) and media: a GIF that holds the text, padded with zero bytes to a positive multiple of 64.

    Rows are treated one by one, whatever they repeat; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(storing, "doc_id long, n_bytes long, media binary")


FRAMES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


FRAME = pa.schema([("frame", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])


def reading(batches):
    for b in batches:
        rows = []
        for i, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
            width, height, frames = decode_frames(media)
            payload = payload_of(frames)
            counts = sum(histogram(rgba[: f.samples.shape[0]]) for f, (rgba, _) in zip(frames, compose(width, height, frames), strict=True))
            feature = f"{width}x{height};{len(frames)} frames;{sum(f.delay for f in frames)} cs;" + ",".join(f"{k}:{x}" for k, x in enumerate(counts) if x)
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            yield batch(FRAMES, *zip(*rows, strict=True))


def gif_features(media: DataFrame) -> DataFrame:
    """What decoding the media column of text_gifs gives: payload digest, last 64 bytes' CRC, and size, frames, time and colour histogram as feature."""
    return media.mapInArrow(reading, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def gif_frames(media: DataFrame, column: str = "media", most: int = MOST) -> DataFrame:
    """Every frame of GIFs as rows: the other columns, frame, delay_cs, width, height, rgba, histogram, error.

    Null media has no frames; media that is broken, cut short or larger than ``most`` pixels one row with error and nothing
    else. A column of media that is named like one of the frame's is replaced by it. Rows are treated one by one,
    whatever they repeat; an empty table gives none.
    """
    keep = [f for f in media.schema.fields if f.name not in (column, *FRAME.names)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "frame int, delay_cs int, width int, height int, rgba binary, histogram array<long>, error string"])

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                data = b.column(column)[row].as_py()
                if data is None:
                    continue
                own = [b.column(f.name)[row : row + 1] for f in keep]
                names = [f.name for f in keep] + FRAME.names
                try:
                    w, h, frames = decode_frames(data, most)
                    found = ((k, delay, w, h, rgba.tobytes(), histogram(rgba).tolist(), None) for k, (rgba, delay) in enumerate(compose(w, h, frames)))
                except (ValueError, IndexError, struct.error) as e:
                    found = iter([(None,) * 6 + (str(e),)])
                for x in found:
                    yield pa.RecordBatch.from_arrays(own + batch(FRAME, *([v] for v in x)).columns, names=names)

    return media.select(*(f"`{f.name}`" for f in keep), f"`{column}`").mapInArrow(run, schema)


def op8_gif_media(spark, sf_dir: str) -> DataFrame:
    return gif_features(text_gifs(documents(spark, sf_dir)))
