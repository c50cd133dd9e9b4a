import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.llm import media

from .conftest import ROWS


def payloads(decoded):
    return [media.BYTE[b.ravel()[: h.payload] + 256].astype(np.uint8).tobytes() for h, b in decoded]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=1500), min_size=1, max_size=5))
def test_round_trip(parts):
    full = [p + bytes(-len(p) % 64) for p in parts]
    assert payloads(media.decode(media.encode(full))) == full


def test_extremes_round_trip():
    rng = np.random.default_rng(1)
    full = [bytes([b]) * 64 * n for b in (0, 32, 255) for n in (1, 4, 5, 64, 65, 300)] + [rng.integers(0, 256, 64 * 999, dtype=np.uint8).tobytes()]
    assert payloads(media.decode(media.encode(full))) == full


def scan_bits(image, tables, order, blocks, interval):
    """A scan written one bit at a time: the plain version."""
    out, units = b"", len(blocks) // len(order)
    for first in range(0, units, interval):
        bits, last = "", {}
        for k in range(first * len(order), min(first + interval, units) * len(order)):
            c = order[k % len(order)]
            dc, ac = tables[c]
            block, run = blocks[k], 0

            def put(table, run_, v):
                nonlocal bits
                size = abs(int(v)).bit_length()
                code, length, _ = media.huffman(*table)
                symbol = run_ << 4 | size
                bits += f"{code[symbol]:0{length[symbol]}b}"
                if size:
                    bits += f"{int(v) if v > 0 else int(v) + (1 << size) - 1:0{size}b}"

            put(dc, 0, block[0] - last.get(c, 0))
            last[c] = block[0]
            for v in block[1:]:
                if v:
                    while run > 15:
                        put(ac, 15, 0)
                        run -= 16
                    put(ac, run, v)
                    run = 0
                else:
                    run += 1
            if run:
                put(ac, 0, 0)
        bits += "1" * (-len(bits) % 8)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        if first + interval < units:
            out += bytes((0xFF, 0xD0 + first // interval % 8))
    return image + out + b"\xff\xd9"


@pytest.mark.parametrize("colour", [False, True])
def test_decoder_reads_other_images(colour):
    """Runs of zeros, ends of blocks, three interleaved components with subsampling, other tables, 16-bit quantisation, restarts."""
    rng = np.random.default_rng(7)
    all_ac = bytes([0x00, 0xF0] + [r << 4 | s for s in range(1, 11) for r in range(16)])
    dc = ((0, 0, 0, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), bytes(range(12)))
    ac = ((0, 0, 0, 0, 0, 0, 0, 162, 0, 0, 0, 0, 0, 0, 0, 0), all_ac)
    order = [0, 0, 0, 0, 1, 2] if colour else [0]
    wide, high = (33, 17) if colour else (40, 24)
    units = 3 * 2 if colour else 5 * 3
    blocks = np.where(rng.random((units * len(order), 64)) < 0.1, rng.integers(-500, 500, (units * len(order), 64)), 0)
    parts = [(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)] if colour else [(1, 1, 1, 0)]
    head = b"\xff\xd8" + media.segment(0xE0, b"JFIF\0") + media.segment(0xDB, b"\x10" + struct.pack(">64H", *[16] * 64)) + media.segment(0xDB, b"\x01" + bytes([3] * 64))
    head += media.segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(parts)) + b"".join(bytes((i, h << 4 | v, q)) for i, h, v, q in parts))
    head += media.segment(0xC4, b"\0" + bytes(dc[0]) + dc[1] + b"\x10" + bytes(ac[0]) + ac[1]) + media.segment(0xDD, struct.pack(">H", 2))
    head += media.segment(0xDA, bytes([len(parts)]) + b"".join(bytes((i, 0)) for i, *_ in parts) + b"\0\x3f\0")
    image = scan_bits(head, {c: (dc, ac) for c in range(3)}, order, blocks, 2)
    (h, got), (_, other) = media.decode([image, media.encode([bytes(640)])[0]])
    assert (got == blocks).all() and other.shape == (10, 64)
    thumb = media.thumbnail(h, got)
    if colour:
        grid = blocks[:, 0].reshape(2, 3, 6)
        want = np.array([[grid[y // 2, x // 2, 2 * (y % 2) + x % 2] for x in range(6)] for y in range(4)])
    else:
        want = blocks[:, 0].reshape(3, 5)
    assert (thumb == np.clip(np.rint(128 + want * 2), 0, 255)).all()
    assert media.feature(h, thumb).startswith(f"{wide}x{high}:")


def test_bad_images_are_refused():
    good = media.encode([b"some text " * 64])[0]
    for bad in (b"", b"GIF89a", good[:40], good[:-2], good[:-30] + b"\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            media.decode([bad])


def test_query_over_awkward_documents(docs, empty):
    rows = media.media_features(media.media_column(docs)).collect()
    want = []
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r[:5])) for r in rows)
    same = [tuple(r[1:]) for r in rows if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert media.media_features(media.media_column(empty)).count() == 0


def test_very_long_payloads_fit_the_frame():
    count = np.array([1, 64, 65, 8191 * 64, 8191 * 64 + 1, 525_000, 20_000_000, 8191 * 8191])  # 525,000 blocks are 33.6 MB
    wide, high = media.shape(count)
    assert (wide * high >= count).all() and (wide <= 8191).all() and (high <= 8191).all()
    assert (wide * high - count < wide).all()  # at most a row is filled up
    assert wide[0] == high[0] == 1 and wide[3] == 64


def test_tall_images_round_trip(monkeypatch):
    monkeypatch.setattr(media, "ROW_BLOCKS", 2)
    monkeypatch.setattr(media, "MOST_BLOCKS", 5)
    payload = bytes(i * 37 % 256 for i in range(64 * 23))
    (h, blocks), = media.decode(media.encode([payload]))
    assert (h.width // 8, h.height // 8) == (5, 5)
    assert media.BYTE[blocks.ravel()[: h.payload] + 256].astype(np.uint8).tobytes() == payload
