"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames.

``decode`` reads any GIF87a or GIF89a file into frames of index samples and ``shown`` composes
them.  ``encode`` writes index samples as an animated GIF whose frames have only what changes.  ``decode_media`` turns a binary column into
timed frames with colour histograms, and ``store_texts`` stores payloads losslessly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import arrow_map, chunks

WIDTH = 64
ROWS = 128  # of a frame at most
#: The index that stands for what lies below; UTF-8 has no such byte.
TRANSPARENT = 255
#: Four levels of each colour.
BINS = 64
#: Pixels of a canvas at most; a header can ask for 2^32.
MOST_PIXELS = 1 << 25
MEDIA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_ms long"
)
FRAMES = (
    "media_id long, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, "
    "disposal int, transparent int, histogram array<long>, canvas_sha256 string, error string"
)


# ---------------------------------------------------------------------------------------- LZW


@lru_cache(maxsize=8)
def code_widths(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first 4096 codes after a clear, and the bits before each: before the k-th
    code the table ends at end + k.  All later codes are 12 bits wide."""
    last = np.minimum((1 << code_size) + 1 + np.arange(4096), 4095)
    width = np.searchsorted(1 << np.arange(code_size + 1, 12), last, side="right") + code_size + 1
    return width, np.concatenate([[0], np.cumsum(width)])


#: The entry after which the encoder clears the table, of 4096.
LAST_ENTRY = 4093


def lzw_compress(samples: bytes) -> bytes:
    """An LZW stream of 8-bit samples by longest match, with a clear whenever the table is full."""
    clear, end = 256, 257
    segments: list[list[int]] = [[]]
    table: dict[int, int] = {}
    known, put, entry = table.get, segments[0].append, end
    rest = iter(samples)
    held = next(rest, -1)
    for sample in rest:
        longer = known(held << 8 | sample)
        if longer is not None:
            held = longer
            continue
        put(held)
        entry += 1
        if entry == LAST_ENTRY:
            segments.append([])
            table.clear()
            put, entry = segments[-1].append, end
        else:
            table[held << 8 | sample] = entry
        held = sample
    if held >= 0:
        put(held)
    sizes, _ = code_widths(8)
    codes, widths, before = [], [], 9
    for segment in segments:
        codes += [[clear], segment]
        widths += [[before], sizes[: len(segment)]]
        before = int(sizes[len(segment)])
    return pack_codes(np.concatenate([*codes, [end]]).astype(np.uint64), np.concatenate([*widths, [before]]))


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits, one after another, least significant bit first."""
    ends = np.cumsum(widths)
    place = ends - widths
    size = int(ends[-1] + 7) // 8
    shifted = codes << (place & 7).astype(np.uint64)  # at most 19 bits, over three bytes
    byte, out = place >> 3, np.zeros(size + 3)
    for n in range(3):  # bits don't overlap, so sums are unions
        out += np.bincount(byte + n, weights=(shifted >> np.uint64(8 * n) & np.uint64(255)).astype(float), minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def expand_segment(codes: np.ndarray, code_size: int) -> np.ndarray:
    """The samples of the codes between two clears, up to the first code that can't be valid.

    Entry j is the string of code j and the next code's first sample, which stand side by side
    in the output.  So a code that names entry j copies from where code j's string begins, and
    every sample points to an earlier one until it meets a literal.
    """
    literal = codes < (1 << code_size)
    entry = np.where(literal, 0, codes - (1 << code_size) - 2)
    bad = ~literal & ((entry < 0) | (entry >= np.arange(len(codes))))
    if bad.any():
        stop = int(np.argmax(bad))
        codes, literal, entry = codes[:stop], literal[:stop], entry[:stop]
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    # Lengths: one more than that of the code that the entry extends.
    parent = np.where(literal, np.arange(n), entry)
    length = np.where(literal, 0, 1)
    while True:
        more = length[parent]
        if not more.any():
            break
        length = length + more
        parent = parent[parent]
    length += 1
    start = np.cumsum(length) - length
    source = np.arange(int(length.sum()))
    source += np.repeat(np.where(literal, 0, start[entry] - start), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    values = np.zeros(len(source), np.uint8)
    values[start[literal]] = codes[literal]
    return values[source]


def lzw_expand(data: bytes, code_size: int, wanted: int) -> bytes:
    """Decode a GIF code stream into at most ``wanted`` samples.

    Any encoder's stream is read: clears may come early, late (the table then stays full) or
    never, and the end code may be missing.  A code that can't be valid ends the stream.
    """
    clear, end = 1 << code_size, (1 << code_size) + 1
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    out: list[np.ndarray] = []
    made, at = 0, 0
    pending: list[np.ndarray] = []  # codes since the clear
    held = 0

    def flush() -> int:
        codes = np.concatenate(pending) if pending else np.zeros(0, np.int64)
        pending.clear()
        samples = expand_segment(codes, code_size)
        out.append(samples)
        return len(samples) - len(codes) if len(samples) < len(codes) else len(samples)

    sizes, bits = code_widths(code_size)
    step = 4096
    while made < wanted:
        if held:
            width = np.full(step, 12)
            place = at + 12 * np.arange(step)
        else:
            width, place = sizes, at + bits[:-1]
        fits = int(np.searchsorted(place + width, total, side="right"))
        width, place = width[:fits], place[:fits]
        byte = place >> 3
        word = stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16
        values = word >> (place & 7) & ((1 << width) - 1)
        special = np.flatnonzero((values == clear) | (values == end))
        cut = int(special[0]) if len(special) else fits
        pending.append(values[:cut])
        held += cut
        if cut == fits and fits == step:
            at = int(place[-1] + width[-1])
            continue
        gained = flush()
        made += max(gained, 0)
        if cut == fits or values[cut] == end or gained < 0:
            break
        at, held = int(place[cut] + width[cut]), 0
    return np.concatenate(out).tobytes()[:wanted] if out else b""


# --------------------------------------------------------------------------------- the format


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int = -1


def grey_palette() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@lru_cache(maxsize=1)
def colour_palette() -> np.ndarray:
    """256 colours: three bits of an index are its red, three its green and two its blue."""
    index = np.arange(256)
    return np.stack([(index >> 5) * 255 // 7, (index >> 2 & 7) * 255 // 7, (index & 3) * 85], axis=1).astype(np.uint8)


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[a : a + 255])]) + data[a : a + 255] for a in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """Index samples, whole rows of ``width``, as timed frames of ``rows`` rows over a colour palette.

    A frame is drawn over the one before, which stays: it has only the rows from the first to the
    last that differ, and rows between that don't are transparent, if ``TRANSPARENT`` is no
    sample.  A comment tells how many rows of all frames' canvases, one under the other, count.
    """
    total = len(samples) // width
    height = max(1, min(rows, total))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), colour_palette().tobytes()]
    out += [b"\x21\xfe", _sub_blocks(f"rows={total}".encode())]
    whole = np.frombuffer(samples, np.uint8).reshape(total, width)
    clear = TRANSPARENT not in samples
    shown = None
    for a in range(0, max(1, total), height):
        new = whole[a : a + height]
        if len(new) < height:
            new = np.concatenate([new, np.zeros((height - len(new), width), np.uint8)])
        top, part, flags = 0, new, 1 << 2
        if shown is not None:
            differs = np.flatnonzero((new != shown).any(axis=1))
            top, bottom = (int(differs[0]), int(differs[-1]) + 1) if len(differs) else (0, 1)
            part = new[top:bottom]
            same = (part == shown[top:bottom]).all(axis=1)
            if clear and same.any():
                part, flags = np.where(same[:, None], np.uint8(TRANSPARENT), part), flags | 1
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay_ms // 10, TRANSPARENT if flags & 1 else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, top, width, len(part), 0) + b"\x08")
        out.append(_sub_blocks(lzw_compress(part.tobytes())))
        shown = new
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    size = 3 * (2 << bits)
    return np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size


def decode(data: bytes) -> tuple[tuple[int, int], list[Frame], bytes]:
    """The screen size, the frames and the comments of a GIF; ``ValueError`` if it is none, is cut
    short or has a screen or frame of more than ``MOST_PIXELS``."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("too many pixels")
    at, palette = 13, grey_palette()
    if flags & 0x80:
        palette, at = _colours(data, at, flags & 7)
    frames: list[Frame] = []
    comments: list[bytes] = []
    control = (0, 0, -1)
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1 : at + 2]
            block, at = _blocks(data, at + 2)
            if label == b"\xf9" and len(block) >= 4:
                packed, delay, index = struct.unpack("<BHB", block[:4])
                control = (delay * 10, packed >> 2 & 7, index if packed & 1 else -1)
            elif label == b"\xfe":
                comments.append(block)
        elif kind == 0x2C:
            if at + 11 > len(data):
                raise ValueError("cut short")
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > MOST_PIXELS:
                raise ValueError("too many pixels")
            at += 10
            own = palette
            if packed & 0x80:
                own, at = _colours(data, at, packed & 7)
            code_size = data[at]
            stream, at = _blocks(data, at + 1)
            if not 2 <= code_size <= 8:
                raise ValueError("bad code size")
            samples = lzw_expand(stream, code_size, w * h)
            if len(samples) < w * h:
                raise ValueError("too few samples")
            if packed & 0x40:  # rows are stored in four passes
                rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                lines = np.empty((h, w), np.uint8)
                lines[rows] = np.frombuffer(samples, np.uint8).reshape(h, w)
                samples = lines.tobytes()
            frames.append(Frame(left, top, w, h, samples, own, *control))
            control = (0, 0, -1)
        else:
            raise ValueError("unknown block")
    if not frames:
        raise ValueError("no frame")
    return (width, height), frames, b"".join(comments)


def colours(frame: Frame) -> np.ndarray:
    """Red, green, blue and opacity of each index."""
    table = np.zeros((256, 4), np.uint8)
    table[: len(frame.palette), :3] = frame.palette
    table[:, 3] = 255
    return table


def shown(size: tuple[int, int], frames: list[Frame], table: Callable[[Frame], np.ndarray] = colours):
    """Each frame's canvas, as shown: drawn over what disposal of the frames before has left.

    ``table`` has what a frame's indices stand for; a canvas is only good until the next.
    """
    width, height = size
    blank = np.zeros_like(table(frames[0])[0]) if frames else np.uint8(0)
    canvas = np.tile(blank, (height, width, *[1] * np.ndim(blank)))
    for frame in frames:
        before = canvas.copy() if frame.disposal == 3 else None
        values = table(frame)
        h, w = max(0, min(frame.height, height - frame.top)), max(0, min(frame.width, width - frame.left))
        index = np.frombuffer(frame.samples, np.uint8).reshape(frame.height, frame.width)[:h, :w]
        area = canvas[frame.top : frame.top + h, frame.left : frame.left + w]
        if frame.transparent < 0:
            area[...] = values[index]
        else:
            drawn = index != frame.transparent
            area[drawn] = values[index[drawn]]
        yield canvas
        if frame.disposal == 2:  # the area becomes transparent again
            area[...] = 0
        elif before is not None:
            canvas = before


def colour_bins(colour: np.ndarray) -> np.ndarray:
    """The bin of each colour, by its level of red, green and blue."""
    high = colour[..., :3].astype(np.int64) >> 6
    return high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Shown pixels of a canvas of colours in ``BINS`` bins."""
    return np.bincount(colour_bins(canvas)[canvas[..., 3] > 0].ravel(), minlength=BINS)


def read_back(media: bytes) -> tuple[bytes, np.ndarray, list[Frame]]:
    """What ``encode`` stored, the colour histogram of all shown frames, and the frames."""
    size, frames, comment = decode(media)
    parts, counts = [], np.zeros(256, np.int64)
    index = np.arange(256, dtype=np.uint8)
    for canvas in shown(size, frames, lambda _: index):
        parts.append(canvas.tobytes())
        counts += np.bincount(canvas.ravel(), minlength=256)
    histogram = np.bincount(colour_bins(frames[0].palette), weights=counts, minlength=BINS).astype(np.int64)
    return b"".join(parts)[: size[0] * int(comment.removeprefix(b"rows="))], histogram, frames


# ----------------------------------------------------------------------------- Spark operators


def decode_media(media: DataFrame) -> DataFrame:
    """Timed frames of ``media`` (media_id, content binary): one row a frame.

    A null or broken file, or one of too many pixels, gives one row with null frame columns and its error.  Repeated rows
    give repeated frames, a null media_id stays null, other columns are left aside and an empty
    table gives no rows.
    """

    def frames(batches):
        for batch in batches:
            rows = []
            for media_id, content in zip(batch.column("media_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    size, found, _ = decode(content or b"")
                except (ValueError, IndexError, struct.error) as error:
                    rows.append((media_id, *[None] * 11, str(error)))
                    continue
                start = 0
                for n, (f, canvas) in enumerate(zip(found, shown(size, found), strict=True)):
                    digest = hashlib.sha256(canvas.tobytes()).hexdigest()
                    place = (f.left, f.top, f.width, f.height, f.disposal, f.transparent)
                    rows.append((media_id, n, start, f.delay_ms, *place, colour_histogram(canvas).tolist(), digest, None))
                    start += f.delay_ms
            i64, i32 = pa.int64(), pa.int32()
            kinds = [i64, i32, i64, i64, i32, i32, i32, i32, i32, i32, pa.list_(i64), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = [part.split()[0] for part in FRAMES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return arrow_map(media.select("media_id", "content"), frames, FRAMES)


def padded(text: str) -> tuple[int, bytes]:
    """The text's UTF-8 size and bytes, with zeros up to a positive multiple of the width."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each row's whole text (doc_id, text) stored as (doc_id, content binary), a GIF."""

    def stored(batches):
        for rows, texts in chunks(batches, "text"):
            content = pa.array([encode(padded(text)[1]) for text in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), content], ["doc_id", "content"])

    return arrow_map(docs.select("doc_id", "text"), stored, "doc_id long, content binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Store each row's whole text as a GIF, read the stored bytes back and describe them.

    A null text is an empty one, whose payload is one row of zeros.  Repeated rows are repeated,
    a null doc_id stays null, other columns are left aside and an empty table gives no rows.
    The feature is the colour histogram of all composed frames, joined by commas.
    """

    def described(batches):
        for rows, texts in chunks(batches, "text"):
            out: list[tuple] = []
            for text in texts:
                size, payload = padded(text)
                media = encode(payload)
                del payload
                back, histogram, frames = read_back(media)
                out.append(
                    (
                        size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                        hashlib.sha256(media).hexdigest(), ",".join(map(str, histogram.tolist())), len(frames),
                        sum(frame.delay_ms for frame in frames),
                    )
                )
            i64, text_kind = pa.int64(), pa.string()
            kinds = [i64, i64, text_kind, i64, i64, text_kind, text_kind, pa.int32(), i64]
            names = [part.split()[0] for part in MEDIA.split(", ")]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names)

    return arrow_map(docs.select("doc_id", "text"), described, MEDIA)
