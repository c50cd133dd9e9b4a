"""Baseline JPEG as a media column: coefficients stored without loss, Huffman decoding in numpy, DC-only luminance thumbnails."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, map_arrow, slices, spread, stored, table

#: Blocks between restart markers; the decoder takes that many steps of 64 symbols, for all intervals of all images of a batch at once.
INTERVAL = 4
#: Blocks in a row of an image that holds a payload, more only where there would be over MOST_BLOCKS rows; rows are as even as they can be.
ROW_BLOCKS = 64
#: Blocks along a side of an image: its 16 bits count 65,535 samples. So an image holds 4 GB of payload, twice what a value of a table can.
MOST_BLOCKS = 8191
#: The bytes most frequent in UTF-8 prose, most frequent first: they get the smallest coefficients. The others follow in ascending order.
FREQUENT = b" etanrihosdlu\xc3cpm.gqb,\xa9fvyw\nxkzj\xa8ETAIOSNRDL'-0123456789\xb3\xbc\xa4\xb1\xa1"
# The Huffman tables written here: how many codes there are of each length from 1 to 16, and their symbols. DC symbols are sizes 0 to 11;
# AC symbols are sizes 1 to 10 without a run of zeros, the end of a block and sixteen zeros.
DC_LENGTHS = (0, 2, 3, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes((3, 4, 2, 1, 0, 5, 6, 7, 8, 9, 10, 11))
AC_LENGTHS = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
AC_SYMBOLS = bytes((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0x00, 0xF0))
PAYLOAD_TAG = b"PAYLOAD\0"


def huffman(lengths: tuple[int, ...] | bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each symbol, its length; and for every 16 bits the length << 8 | symbol that they start with, 0 if none)."""
    code, length, look, at, value = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(65536, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            if value >> n or at >= len(symbols):
                raise ValueError("a Huffman table has more codes than fit")
            s = symbols[at]
            code[s], length[s] = value, n
            look[value << (16 - n) : (value + 1) << (16 - n)] = n << 8 | s
            value, at = value + 1, at + 1
        value <<= 1
    return code, length, look


@lru_cache(maxsize=64)
def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    return huffman(lengths, symbols)[2]


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    """(the coefficient of each byte, the byte of each coefficient + 256): 1, -1, 2, -2, ... by frequency; none is 0."""
    order = list(dict.fromkeys(FREQUENT)) + [b for b in range(256) if b not in FREQUENT]
    value, back = np.zeros(256, np.int64), np.zeros(513, np.int64)
    for rank, b in enumerate(order):
        v = (rank // 2 + 1) * (-1 if rank % 2 else 1)
        value[b], back[v + 256] = v, b
    return value, back


def code_table(lengths: tuple[int, ...], symbols: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, their number) for each value from -most to most: the size's Huffman code and the value's low bits."""
    code, length, _ = huffman(lengths, symbols)
    v = np.arange(-most, most + 1)
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    low = np.where(v < 0, v + (1 << size) - 1, v)
    return (code[size] << size) | low, length[size] + size


VALUE, BYTE = coefficients()
DC_BITS, DC_SIZE = code_table(DC_LENGTHS, DC_SYMBOLS, 512)
AC_BITS, AC_SIZE = code_table(AC_LENGTHS, AC_SYMBOLS, 256)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = segment(0xDB, b"\0" + bytes([1] * 64)), segment(0xC4, b"\0" + bytes(DC_LENGTHS) + DC_SYMBOLS) + segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + AC_SYMBOLS)


def entropy_code(blocks: np.ndarray, images: np.ndarray, interval: int = INTERVAL) -> list[bytes]:
    """The scans of images: blocks (n, 64) are coefficients in zigzag order without zeros after the first, images the number of blocks of each."""
    n = len(blocks)
    first = np.cumsum(images) - images
    at = np.arange(n) - np.repeat(first, images)  # place in the image
    start = at % interval == 0  # the DC prediction starts anew
    dc = blocks[:, 0].copy()
    dc[1:] -= np.where(start[1:], 0, blocks[:-1, 0])
    bits, size = AC_BITS[blocks + 256], AC_SIZE[blocks + 256]
    bits[:, 0], size[:, 0] = DC_BITS[dc + 512], DC_SIZE[dc + 512]
    lanes = np.flatnonzero(start)
    lane_bits = np.add.reduceat(size.sum(1), lanes)
    lane_bytes = (lane_bits + 7) // 8
    pad = lane_bytes * 8 - lane_bits
    # every lane ends in pad ones: a code of its own after the lane's last
    lane_codes = np.diff(np.append(lanes, n)) * 64
    where = np.cumsum(lane_codes)
    bits = np.insert(bits.ravel(), where, (1 << pad) - 1).astype(np.uint64)
    size = np.insert(size.ravel(), where, pad)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1])
    word = begin >> 6
    room = 64 - (begin & 63) - size
    own = np.where(room >= 0, bits << np.maximum(room, 0).astype(np.uint64), bits >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros((total >> 6) + 2, np.uint64)
    change = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[change]] = np.bitwise_or.reduceat(own, change)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= bits[over] << (64 + room[over]).astype(np.uint64)
    raw = out.astype(">u8").view(np.uint8)[: total // 8]
    # a zero after each 255, and a restart marker between lanes of an image
    lane_image = np.searchsorted(first, lanes, "right") - 1
    last = np.append(lane_image[1:] != lane_image[:-1], True)
    lane_end = np.cumsum(lane_bytes)
    ff = raw == 0xFF
    shift = np.cumsum(ff) - ff
    marks = np.zeros(len(raw) + 1, np.int64)
    marks[lane_end[~last]] = 2
    place = np.arange(len(raw)) + shift + np.cumsum(marks[:-1])
    stuffed = np.zeros(len(raw) + int(ff.sum()) + 2 * int((~last).sum()), np.uint8)
    stuffed[place] = raw
    mark_at = place[lane_end[~last]] - 2
    stuffed[mark_at] = 0xFF
    stuffed[mark_at + 1] = 0xD0 + (at[lanes[~last]] // interval) % 8
    image_end = lane_end[last]
    cut = np.where(image_end < len(raw), place[np.minimum(image_end, len(raw) - 1)], len(stuffed))
    ends = np.concatenate([[0], cut])
    return [stuffed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def shape(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks in a row, rows) of images that hold count blocks each."""
    high = -(-count // np.maximum(ROW_BLOCKS, -(-count // MOST_BLOCKS)))
    return -(-count // high), high


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a grey baseline JPEG: 64 bytes are the coefficients of a block, in zigzag order."""
    count = np.array([len(p) // 64 for p in payloads])
    wide, high = shape(count)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    blocks = np.full((int((wide * high).sum()), 64), VALUE[FREQUENT[0]])
    blocks[spread(np.cumsum(wide * high) - wide * high, count)] = VALUE[data]
    out = []
    for p, w, h, scan in zip(payloads, wide.tolist(), high.tolist(), entropy_code(blocks, wide * high), strict=True):
        frame = segment(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 1) + b"\x01\x11\x00")
        note = segment(0xFE, PAYLOAD_TAG + struct.pack(">Q", len(p)))
        out.append(b"\xff\xd8" + note + TABLES[0] + frame + TABLES[1] + segment(0xDD, struct.pack(">H", INTERVAL)) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9")
    return out


@dataclass
class Header:
    """What the markers before the first scan say."""

    width: int = 0
    height: int = 0
    components: tuple = ()  # (id, horizontal, vertical, quantisation table)
    scan: tuple = ()  # (component index, DC table, AC table)
    interval: int = 0
    payload: int | None = None
    data: int = 0  # where the scan's bytes start
    quantisation: dict = None
    dc: dict = None
    ac: dict = None


def parse(image: bytes) -> Header:
    """The header of a baseline JPEG. ValueError for anything else."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    h, at = Header(quantisation={}, dc={}, ac={}), 2
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = image[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                h.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (h.ac if body[0] >> 4 else h.dc)[body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits are read only")
            h.height, h.width, n = struct.unpack_from(">HHB", body, 1)
            h.components = tuple((body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n))
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            h.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(PAYLOAD_TAG):
            h.payload = struct.unpack_from(">Q", body, len(PAYLOAD_TAG))[0]
        elif marker == 0xDA:
            ids = [c[0] for c in h.components]
            h.scan = tuple((ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0]))
            if len(h.scan) != len(h.components):
                raise ValueError("images of one scan are read only")
            h.data = at
            return h


def layout(h: Header) -> tuple[list[int], int, int]:
    """(the scan's place of the component of each block of a unit, units in a row, rows of units)."""
    if len(h.components) == 1:
        return [0], -(-h.width // 8), -(-h.height // 8)
    most_h, most_v = max(c[1] for c in h.components), max(c[2] for c in h.components)
    order = [k for k, (c, _, _) in enumerate(h.scan) for _ in range(h.components[c][1] * h.components[c][2])]
    return order, -(-h.width // (8 * most_h)), -(-h.height // (8 * most_v))


def decode(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """(header, coefficients) of each image: (blocks, 64) in the order of the scan, zigzag within a block, DC prediction undone.

    The restart intervals of all images whose blocks interleave alike are decoded side by side: each step takes one symbol from every interval.
    """
    headers = [parse(x) for x in images]
    out: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(headers):
        groups.setdefault((tuple(layout(h)[0]), tuple((h.dc[d], h.ac[a]) for _, d, a in h.scan)), []).append(i)
    for (order, tables), members in groups.items():
        for i, blocks in zip(members, decode_alike([images[i] for i in members], [headers[i] for i in members], order, tables), strict=True):
            out[i] = (headers[i], blocks)
    return out


def decode_alike(images: list[bytes], headers: list[Header], order: tuple, tables: tuple) -> list[np.ndarray]:
    dc = np.stack([lookup(*t[0]) for t in tables])
    ac = np.stack([lookup(*t[1]) for t in tables])
    kind, per_unit = np.array(order), len(order)
    units = [np.prod(layout(h)[1:]) for h in headers]
    scans = [np.frombuffer(x, np.uint8, offset=h.data) for x, h in zip(images, headers, strict=True)]
    raw = np.concatenate(scans)
    image_at = np.cumsum([0, *map(len, scans)])[:-1]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    ends = ff[after == 0xD9]
    drop = np.concatenate([ff[after == 0] + 1, restart, restart + 1])
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    moved = np.concatenate([[0], np.cumsum(keep)])
    # lanes: the scan's start and what follows each restart marker before the image's end
    end_of = ends[np.searchsorted(ends, image_at)] if len(ends) else np.full(len(images), -1)
    if not len(ends) or (np.searchsorted(ends, image_at) >= len(ends)).any():
        raise ValueError("an image does not end")
    inside = restart[restart < end_of[np.searchsorted(image_at, restart, "right") - 1]]
    lane_start = np.sort(np.concatenate([image_at, inside + 2]))
    lane_image = np.searchsorted(image_at, lane_start, "right") - 1
    number = np.arange(len(lane_start)) - np.searchsorted(lane_image, lane_image)
    every = np.array([h.interval or u for h, u in zip(headers, units, strict=True)])
    todo = np.minimum(every[lane_image], np.array(units)[lane_image] - number * every[lane_image]) * per_unit
    if (todo <= 0).any() or (np.bincount(lane_image, todo, len(images)) != np.array(units) * per_unit).any():
        raise ValueError("restart markers do not match the image's size")
    stream = np.concatenate([raw[keep], np.full(16, 0, np.uint8)])
    windows = np.ndarray((len(stream) - 7,), ">u8", stream.tobytes(), strides=(1,))
    offset = np.cumsum(todo) - todo
    blocks = np.zeros((int(todo.sum()), 64), np.int32)
    flat = blocks.reshape(-1)
    pos = moved[lane_start].astype(np.int64) * 8
    most = (len(stream) - 8) * 8
    place, left, k = offset * 64, todo.copy(), np.zeros(len(todo), np.int64)
    unit = np.zeros(len(todo), np.int64)
    predicted = np.zeros((len(todo), len(tables)), np.int64)
    alive = np.arange(len(todo))
    while len(alive):
        if (pos > most).any():
            raise ValueError("a scan ends too early")
        bits = windows[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        peek = (bits >> np.uint64(48)).astype(np.int64)
        c = kind[unit]
        is_dc = k == 0
        found = np.where(is_dc, dc[c, peek], ac[c, peek])
        length, symbol = found >> 8, found & 255
        if (length == 0).any():
            raise ValueError("a code is in no Huffman table")
        size = symbol & 15
        value = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        pos = pos + length + size
        row = np.flatnonzero(is_dc)
        if len(row):
            predicted[alive[row], c[row]] += value[row]
            value[row] = predicted[alive[row], c[row]]
        run = np.where(is_dc, 0, symbol >> 4)
        end = ~is_dc & (size == 0) & (run != 15)
        target = k + run
        if (target[~end] > 63).any():
            raise ValueError("a block has more than 64 coefficients")
        store = is_dc | (size > 0)
        flat[(place + target)[store]] = value[store]
        k = np.where(end, 64, target + 1)
        done = k == 64
        if done.any():
            place, left, k = place + 64 * done, left - done, np.where(done, 0, k)
            unit = np.where(done, (unit + 1) % per_unit, unit)
            go = left > 0
            if not go.all():
                alive, place, left, k, unit, pos = alive[go], place[go], left[go], k[go], unit[go], pos[go]
    first = np.searchsorted(lane_image, np.arange(len(images)))
    return np.split(blocks, offset[first][1:])


def thumbnail(h: Header, blocks: np.ndarray) -> np.ndarray:
    """The luminance of an image at an eighth of its size: the mean of each 8 x 8 block, from its DC coefficient alone."""
    order, wide, high = layout(h)
    component = h.scan[0][0]
    _, ch, cv, q = h.components[component]
    own = blocks[:, 0].reshape(wide * high, len(order))[:, [k for k, c in enumerate(order) if c == 0]]
    if len(order) == 1:
        grid = own.reshape(high, wide)
    else:
        grid = own.reshape(high, wide, cv, ch).transpose(0, 2, 1, 3).reshape(high * cv, wide * ch)
    return np.clip(np.rint(128 + grid * h.quantisation[q][0] / 8), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 parts of a thumbnail are brighter than their mean."""
    rows = np.arange(8) * thumb.shape[0] // 8
    columns = np.arange(8) * thumb.shape[1] // 8
    small = thumb[rows][:, columns].astype(np.int64)
    return f"{int.from_bytes(np.packbits(small * 64 > small.sum()).tobytes(), 'big'):016x}"


def feature(h: Header, thumb: np.ndarray) -> str:
    """An image's size in pixels, its thumbnail's average hash and the thumbnail's CRC-32."""
    return f"{h.width}x{h.height}:{average_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"


def media_column(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_bytes and media: the whole text as UTF-8 (null: empty), filled with zero bytes to a positive multiple of 64, as a JPEG; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(binary(batch.column(1)), 1 << 20):
                texts = part.to_pylist()
                made = encode([t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(map_arrow(source, run, "doc_id long, n_bytes long, media binary"), "media", "uncompressed")


DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold: the payload's size and digests, the image's, and the features of its thumbnail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DECODED.split(", ")]
        for batch in batches:
            for row, part in slices(binary(batch.column(2)), 1 << 20):
                images, rows = part.to_pylist(), []
                for image, (h, blocks) in zip(images, decode(images), strict=True):
                    payload = BYTE[blocks.ravel()[: h.payload] + 256].astype(np.uint8).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(h, thumbnail(h, blocks))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), batch.column(1).slice(row, len(part)), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, DECODED)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload and features, from the images as read back."""
    return media_features(media_column(table(spark, sf_dir, "documents")))
