"""Media columns: baseline JPEG, written losslessly as coefficients and read again."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, prepared

#: Bytes of one row of blocks: three blocks of 64 coefficients.
ROW = 192
#: Rows of blocks of one image: its height has 16 bits.
IMAGE_ROWS = 65535 // 8
#: Bytes of scans that are decoded side by side, about.
LANE_BYTES = 4 << 20
_SPACE = 32
#: Step of the quantiser for the first coefficient, which makes its level the block's mean.
_DC_STEP = 8
#: Blocks between two restart markers: what stands between them can be decoded side by side.
RESTART = ROW // 64
_AC_SIZE = 8


class Image(NamedTuple):
    width: int
    height: int
    #: Of the first component: coefficients of each block in zigzag order, blocks in raster order.
    levels: np.ndarray
    #: The first component's means of blocks, 0 to 255.
    thumbnail: np.ndarray


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(lengths: list[int]) -> list[int]:
    """Canonical codes of code lengths that don't decrease."""
    out, code, last = [], 0, 0
    for n in lengths:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    return out


def _table(kind: int, symbols: list[int], lengths: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols))


# Of texts, most differences of block means have 4 to 6 bits.
_DC_SYMBOLS = [5, 4, 6, 3, 7, 2, 8, 1, 0]
_DC_LENGTHS = [2, 2, 3, 3, 4, 5, 6, 7, 8]
_DC_CODE = dict(zip(_DC_SYMBOLS, zip(_DC_LENGTHS, _codes(_DC_LENGTHS))))
_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, bytes([0, _DC_STEP]) + bytes([1] * 63))
_TABLES = _table(0x00, _DC_SYMBOLS, _DC_LENGTHS) + _table(0x10, [_AC_SIZE, 0x00], [1, 2]) + _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many) of every difference from -255 to 255: code, then value."""
    out, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        n, code = _DC_CODE[size]
        out[diff + 255], sizes[diff + 255] = code << size | (diff if diff > 0 else diff + (1 << size) - 1), n + size
    return out, sizes


_DC_WORDS, _DC_SIZES = _dc_words()
#: An interval has so many bytes at most before stuffing.
_INTERVAL = -(-RESTART * (int(_DC_SIZES.max()) + 63 * (1 + _AC_SIZE)) // 8)


def _intervals_of(payload: bytes, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of the intervals of a payload's rows, each followed by the marker of its number, all written at once.

    A block's first byte is its mean (the level of the first coefficient, less
    128). Each other byte is a coefficient of 8 bits, which are that byte.
    """
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, RESTART, 64)
    diffs = np.diff(blocks[:, :, 0].astype(np.int16) - 128, prepend=np.int16(0), axis=1) + 255
    words, sizes = _DC_WORDS[diffs], _DC_SIZES[diffs]
    rest = 63 * (1 + _AC_SIZE)
    ends = np.cumsum(sizes + rest, axis=1)
    bits = np.zeros((len(blocks), 8 * _INTERVAL), np.uint8)
    flat, begin = bits.reshape(-1), np.arange(len(blocks)) * 8 * _INTERVAL
    values = np.zeros((len(blocks), 63, 1 + _AC_SIZE), np.uint8)
    for i in range(RESTART):
        at = begin + ends[:, i] - rest  # the first coefficient ends here
        for back in range(int(_DC_SIZES.max()), 0, -1):
            some = sizes[:, i] >= back
            flat[at[some] - back] = words[some, i] >> np.uint32(back - 1) & 1
        values[:, :, 1:] = np.unpackbits(blocks[:, i, 1:].copy(), axis=1).reshape(len(blocks), 63, 8)
        np.lib.stride_tricks.sliding_window_view(flat, rest, writeable=True)[at] = values.reshape(len(blocks), rest)
    last = ends[:, -1]
    for pad in range(7):
        flat[(begin + last + pad)[(last + pad) // 8 < -(-last // 8)]] = 1
    size = -(-last // 8)
    # Each interval, its bytes of 255 followed by 0, then its marker.
    whole = np.zeros((len(blocks), _INTERVAL + 2), np.uint8)
    whole[:, :-2] = np.packbits(bits, axis=1)
    row = np.arange(len(blocks))
    whole[row, size], whole[row, size + 1] = 0xFF, 0xD0 + number % 8
    place = np.arange(_INTERVAL + 2)
    times = (place < (size + 2)[:, None]).astype(np.uint8) + ((whole == 0xFF) & (place < size[:, None]))
    out = np.repeat(whole.reshape(-1), times.reshape(-1))
    out[(np.cumsum(times.reshape(-1), dtype=np.int64) - 1)[times.reshape(-1) == 2]] = 0
    return out, times.sum(axis=1, dtype=np.int64)


def padded(raw: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of a row."""
    return raw + bytes([_SPACE]) * (-len(raw) % ROW if raw else ROW)


def encode_all(raws: list[bytes]) -> list[bytes]:
    """Any bytes, padded, as grey baseline JPEGs whose coefficients are the bytes, one image after another; after each row of blocks comes a restart marker."""
    payloads = [padded(raw) for raw in raws]
    rows = np.array([len(p) // ROW for p in payloads], np.int64)
    number = (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) % IMAGE_ROWS
    whole, scans, sizes = b"".join(payloads), [], []
    for at in range(0, len(number), LANE_BYTES // ROW):
        part = slice(at, at + LANE_BYTES // ROW)
        scan, size = _intervals_of(whole[part.start * ROW : part.stop * ROW], number[part])
        scans.append(scan.tobytes())
        sizes.append(size)
    scan, ends = b"".join(scans), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    out, first = [], 0
    for n in rows.tolist():
        images = []
        for at in range(first, first + n, IMAGE_ROWS):
            last = min(at + IMAGE_ROWS, first + n)
            frame = _segment(0xC0, struct.pack(">BHHB3B", 8, (last - at) * 8, 24, 1, 1, 0x11, 0))
            images.append(_HEAD + frame + _TABLES + scan[ends[at] : ends[last] - 2] + b"\xff\xd9")
        out.append(b"".join(images))
        first += n
    return out


def encode(raw: bytes) -> bytes:
    return encode_all([raw])[0]


def _huffman(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, table): for each 16 bits the length of the code they begin with (0: none) and its symbol, as length * 256 + symbol."""
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        lengths = [n for n in range(1, 17) for _ in range(counts[n - 1])]
        symbols = body[at + 17 : at + 17 + len(lengths)]
        table = np.zeros(1 << 16, np.int32)
        for n, code, symbol in zip(lengths, _codes(lengths), symbols):
            if code >> n:
                raise ValueError("more codes than fit")
            table[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
        yield kind, table
        at += 17 + len(lengths)


class _Lanes:
    """Bits of many intervals, read side by side, one code of each after another."""

    def __init__(self, parts: list[bytes]):
        data = np.frombuffer(b"".join(p + b"\0\0\0\0" for p in parts), np.uint8).astype(np.int32)
        self.words = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.at = 8 * (np.cumsum(sizes + 4) - sizes - 4)
        self.end = self.at + 8 * sizes

    def _peek(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] >> (8 - (at & 7)) & 0xFFFF

    def symbols(self, table: np.ndarray, lanes: np.ndarray | slice) -> np.ndarray:
        found = table[self._peek(self.at[lanes])]
        if not found.all():
            raise ValueError("no such code")
        self.at[lanes] += found >> 8
        return found & 255

    def numbers(self, sizes: np.ndarray, lanes: np.ndarray | slice) -> np.ndarray:
        raw = self._peek(self.at[lanes]) >> (16 - sizes)
        self.at[lanes] += sizes
        if (self.at[lanes] > self.end[lanes]).any():
            raise ValueError("the scan ends within a block")
        return np.where(raw >> np.maximum(sizes - 1, 0) != 0, raw, raw - (1 << sizes) + 1) * (sizes > 0)


def _block(lanes: _Lanes, dc: np.ndarray, ac: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The next block of each of the lanes `own`: its first difference and other coefficients."""
    every = slice(None) if len(own) == len(lanes.at) else own
    out = np.zeros((len(own), 64), np.int32)
    out[:, 0] = lanes.numbers(lanes.symbols(dc, every), every)
    k = np.ones(len(own), np.int64)
    here: np.ndarray | slice = slice(None)
    while len(k[here]):
        now = own[here] if isinstance(here, np.ndarray) else every
        symbol = lanes.symbols(ac, now)
        size, step = symbol & 15, symbol >> 4
        value = lanes.numbers(size, now)
        place = k[here] + step
        ended = (size == 0) & (step < 15)
        if ((place > 63) & ~ended).any():
            raise ValueError("too many coefficients")
        rows = np.flatnonzero(~ended) if isinstance(here, slice) else here[~ended]
        out[rows, place[~ended]] = value[~ended]
        k[here] = np.where(ended, 64, place + 1)
        if (k < 64).all():
            here = slice(None)
        else:
            here = np.flatnonzero(k < 64)
    return out


class Scan(NamedTuple):
    """A scan that isn't decoded yet: its intervals, the tables of each component in it, and its blocks in an interval."""

    parts: list[bytes]
    order: list[tuple[int, int, int]]
    tables: tuple[bytes, ...]
    units: list[int]


def _decoded(scans: list[Scan]) -> list[list[np.ndarray]]:
    """Of scans that have the same order and tables, each interval's blocks in their order (64 coefficients each), all intervals side by side."""
    first = scans[0]
    tables = [np.frombuffer(t, np.int32) for t in first.tables]
    lanes = _Lanes([p for s in scans for p in s.parts])
    units = np.array([u for s in scans for u in s.units])
    before: dict[int, np.ndarray] = {}
    found = []
    for unit in range(int(units.max())):
        own = np.flatnonzero(units > unit)
        for i, (component, dc, ac) in enumerate(first.order):
            block = _block(lanes, tables[dc], tables[ac], own)
            last = before.setdefault(component, np.zeros(len(units), np.int32))
            last[own] += block[:, 0]
            block[:, 0] = last[own]
            found.append((own, block))
    out = np.zeros((len(units), len(found), 64), np.int32)
    for i, (own, block) in enumerate(found):
        out[own, i] = block
    at, each = 0, []
    for s in scans:
        each.append([out[at + j, : u * len(first.order)] for j, u in enumerate(s.units)])
        at += len(s.parts)
    return each


class Parsed(NamedTuple):
    """An image whose markers are read, and the scan that has its first component."""

    width: int
    height: int
    components: list[tuple]
    step: int
    scan: Scan


def parse(data: bytes, at: int = 0) -> tuple[Parsed, int]:
    """The markers of the baseline JPEG at a place of data, and where it ends. Anything else raises ValueError."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image starts here")
    at += 2
    quantisers: dict[int, list[int]] = {}
    tables: dict[int, bytes] = {}
    frame: tuple | None = None
    restart, scan = 0, None
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            at += 2
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                quantisers[name] = list(struct.unpack_from(">64H" if wide else ">64B", body, i + 1))
                i += 129 if wide else 65
        elif marker == 0xC4:
            tables |= _tables_of(body)
        elif marker == 0xC0:
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples must have 8 bits")
            frame = width, height, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(count)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = at
            while not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end = data.find(b"\xff", end + 1)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan has no end")
            if frame[2][0][0] in chosen:
                scan = _scan(data[at:end], frame, chosen, tables, restart)
            at = end
    if frame is None or scan is None:
        raise ValueError("no image data")
    width, height, components = frame
    return Parsed(width, height, components, quantisers[components[0][2]][0], scan), at


@lru_cache(maxsize=64)
def _tables_of(body: bytes) -> dict[int, bytes]:
    return {kind: table.tobytes() for kind, table in _huffman(body)}


def _image(parsed: Parsed, intervals: list[np.ndarray]) -> Image:
    """The first component's levels in raster order, and its thumbnail."""
    across, down = _grid(parsed.width, parsed.height, parsed.components, 0)
    blocks = np.concatenate(intervals)
    order = parsed.scan.order
    if len(order) == 1:
        levels = blocks[: across * down]
    else:
        factors = parsed.components[0][1]
        h, v = factors >> 4, factors & 15
        most_h = max(c[1] >> 4 for c in parsed.components)
        wide = -(-parsed.width // (8 * most_h))
        own = blocks.reshape(-1, len(order), 64)[:, [i for i, (c, _, _) in enumerate(order) if c == 0]]
        plane = own.reshape(-1, wide, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, wide * h, 64)
        levels = plane[:down, :across].reshape(-1, 64)
    means = np.clip(np.rint(levels[:, 0] * parsed.step / 8 + 128), 0, 255).astype(np.uint8)
    return Image(parsed.width, parsed.height, levels, means.reshape(down, across))


def decode_all(stored: list[bytes]) -> list[list[Image]]:
    """The images of each of several strings of baseline JPEGs. Anything else raises ValueError.

    Any number of components, sampling factors and restart intervals are read;
    what is given back are the first component's levels and thumbnail. Intervals
    of images with the same tables are decoded side by side.
    """
    found: list[list[Parsed]] = []
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for data in stored:
        at, own = 0, []
        while at < len(data):
            image, at = parse(data, at)
            alike.setdefault((tuple(image.scan.order), image.scan.tables), []).append((len(found), len(own)))
            own.append(image)
        found.append(own)
    out: list[list] = [[None] * len(own) for own in found]
    for places in alike.values():
        for part in _some(places, found):
            for (i, j), intervals in zip(part, _decoded([found[i][j].scan for i, j in part])):
                out[i][j] = _image(found[i][j], intervals)
    return out


def _some(places: list[tuple[int, int]], found: list[list[Parsed]]) -> Iterator[list[tuple[int, int]]]:
    """Places of images, in lists whose scans together have LANE_BYTES, about."""
    part, size = [], 0
    for i, j in places:
        part.append((i, j))
        size += sum(map(len, found[i][j].scan.parts))
        if size >= LANE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def decode(data: bytes) -> Image:
    """The one image of data."""
    return decode_all([data])[0][0]


def _grid(width: int, height: int, components: list[tuple], i: int) -> tuple[int, int]:
    """Blocks across and down that component i has in the image."""
    most_h, most_v = max(c[1] >> 4 for c in components), max(c[1] & 15 for c in components)
    h, v = components[i][1] >> 4, components[i][1] & 15
    return -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)


def _scan(data: bytes, frame: tuple, chosen: dict, tables: dict, restart: int) -> Scan:
    width, height, components = frame
    used = [(i, c) for i, c in enumerate(components) if c[0] in chosen]
    single = len(used) == 1
    most_h, most_v = max(c[1] >> 4 for c in components), max(c[1] & 15 for c in components)
    across, down = _grid(width, height, components, used[0][0])
    wide, high = (across, down) if single else (-(-width // (8 * most_h)), -(-height // (8 * most_v)))
    kinds = sorted({k for _, c in used for k in (chosen[c[0]][0], 16 + chosen[c[0]][1])})
    order = []
    for i, (name, factors, _) in used:
        times = 1 if single else (factors >> 4) * (factors & 15)
        order += [(i, kinds.index(chosen[name][0]), kinds.index(16 + chosen[name][1]))] * times
    parts = list(_intervals(data))
    each = restart or wide * high
    units = [min(each, wide * high - at) for at in range(0, wide * high, each)]
    if len(parts) < len(units) or not all(k in tables for k in kinds):
        raise ValueError("intervals or tables are missing")
    return Scan(parts[: len(units)], order, tuple(tables[k] for k in kinds), units)


def _intervals(data: bytes) -> Iterator[bytes]:
    """The parts of a scan between its restart markers, without stuffing."""
    start = at = 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            yield data[start:at].replace(b"\xff\0", b"\xff")
            start = at + 2
        at += 2
    yield data[start:].replace(b"\xff\0", b"\xff")


def payload_of(images: list[Image]) -> bytes:
    """The bytes that encode() stored in the images' levels."""
    parts = []
    for image in images:
        levels = image.levels
        first = levels[:, :1] + 128
        rest = np.where(levels[:, 1:] > 0, levels[:, 1:], levels[:, 1:] + 255)
        parts.append(np.concatenate((first, rest), axis=1).astype(np.uint8).tobytes())
    return b"".join(parts)


def thumbnail_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which cells of an 8 by 8 grid over the thumbnail are brighter than its mean."""
    down, across = thumbnail.shape
    index = (np.arange(down) * 8 // down)[:, None] * 8 + np.arange(across) * 8 // across
    sums = np.bincount(index.reshape(-1), thumbnail.reshape(-1), 64)
    counts = np.bincount(index.reshape(-1), minlength=64)
    bright = (sums > thumbnail.mean() * counts) & (counts > 0)
    return int.from_bytes(np.packbits(bright).tobytes(), "big")


def media_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every row's whole text in UTF-8 (null: empty) stored as JPEG.

    Very long texts are several images. A null id stays null; rows that repeat
    have equal values; other columns are dropped, whatever their names. An empty
    table gives an empty table.
    """
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(encode_all(raws), pa.binary())], [id_column, "n_bytes", "media"])

    chosen = docs.select(F.col(id_column).cast("long").alias(id_column), text_column)
    return chosen.mapInArrow(run, f"`{id_column}` long, n_bytes long, media binary")


def described(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What reading the media column gives: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height.

    The feature is the thumbnail's size and hash; equal texts have equal values
    everywhere. An image that can't be read raises. Rows that repeat or have a
    null id are read each; an empty table gives an empty table.
    """
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def row(doc: int, n: int, stored: bytes, images: list[Image]) -> tuple:
        payload = payload_of(images)
        thumbnail = np.concatenate([i.thumbnail for i in images])
        height = sum(i.height for i in images)
        feature = f"{thumbnail.shape[1]}x{thumbnail.shape[0]}:{thumbnail_hash(thumbnail):016x}"
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, images[0].width, height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [row(*r) for r in zip(*columns, decode_all(columns[2]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.select(id_column, "n_bytes", "media").mapInArrow(run, f"`{id_column}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")
