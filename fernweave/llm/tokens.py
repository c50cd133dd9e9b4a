"""Token ids of whole texts by a public tokenizer, with a memo of the pieces between single spaces."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import binary, buffers, slices, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Pieces that a worker remembers; about 60 MB.
KEEP = 250_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


class Encoder:
    """Ids of texts by the tokenizers library: add_special_tokens=False, strings of special tokens are ordinary text.

    The byte-level vocabulary splits a text before every single space that stands between two characters other than white space, and around every
    such line feed, whatever stands further away. So a text's ids are those of the pieces between these places, and a piece that is known needs no
    second run of the library. Pieces of other white space and of scripts without spaces are simply longer.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = type(self.tokenizer.pre_tokenizer).__name__
        self.by_piece = pre == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None
        self.keep = keep
        if self.by_piece:
            spaced = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith("\u0120")}  # the byte-level form of a space
            self.spaced = np.isin(np.arange(self.vocabulary()), list(spaced))
        self.known: dict[bytes, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, the number of ids of each); null is empty."""
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, part in slices(binary(texts), 2 << 20):
            flat, count = self._pieces(part) if self.by_piece else self._plain([x.decode() for x in part.to_pylist()])
            flats.append(flat)
            counts.append(count)
        return np.concatenate(flats), np.concatenate(counts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum())), count

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _plain, for pieces that start with their only white space, a space: many at a time, since just their first ids start with a space."""
        runs = [b"".join(pieces[k : k + 512]).decode() for k in range(0, len(pieces), 512)]
        flat, _ = self._plain(runs)
        first = np.flatnonzero(self.spaced[flat])
        if len(first) != len(pieces):
            return self._plain([x.decode() for x in pieces])
        return flat, np.diff(np.append(first, len(flat)))

    def _pieces(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = buffers(part)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
        starts = piece_starts(data)
        starts[at[:-1][at[:-1] < n]] = True
        first = np.flatnonzero(starts)
        ends = np.append(first, n).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        row, lengths, flat = self._rows(coded.dictionary)
        own = row[coded.indices.to_numpy()]
        size = lengths[own]
        out = flat[spread((np.cumsum(lengths) - lengths)[own], size)]
        piece_of = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(piece_of[np.searchsorted(first, at)])

    def _rows(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of each piece in the tables of lengths and ids that are returned with it."""
        data, at = buffers(pieces)
        pieces, known = pieces.to_pylist(), self.known
        row = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(row < 0)
        if not len(new):
            return row, self.lengths, self.flat
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        single = ((data[at[:-1]] == 32) & (np.add.reduceat(blank.astype(np.int64), at[:-1]) == 1))[new]
        new = np.concatenate([new[single], new[~single]])
        n = int(single.sum())
        flat, count = self._joined([pieces[i] for i in new[:n].tolist()])
        others, more = self._plain([pieces[i].decode() for i in new[n:].tolist()])
        flat, count = np.concatenate([flat, others]), np.concatenate([count, more])
        row[new] = len(self.lengths) + np.arange(len(new))
        lengths, flat = np.concatenate([self.lengths, count]), np.concatenate([self.flat, flat])
        if len(lengths) <= self.keep:
            known.update(zip([pieces[i] for i in new.tolist()], row[new].tolist(), strict=True))
            self.lengths, self.flat = lengths, flat
        return row, lengths, flat


class Decoder:
    """The bytes of ids of a byte-level vocabulary, whose tokens write a byte as a printable character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # these stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        own = {i: t.encode() for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        own |= {i: bytes(byte[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        table = [own.get(i, b"") for i in range(max(own, default=-1) + 1)]
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.start[ids], self.length[ids])].tobytes()


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per worker process and vocabulary file."""
    return Decoder(path)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes: a flag a byte."""
    n = len(data)
    out = np.zeros(n, bool)
    gap = np.flatnonzero((data == 32) | (data == 10))
    gap = gap[(gap >= 2) & (gap < n - 1)]
    after, before, lead = data[gap + 1], data[gap - 1], data[gap - 2]
    # Two-byte characters from U+00C0 on hold no white space; longer ones may, and are not cut at.
    gap = gap[(((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF))) & (((before > 32) & (before < 127)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)))]
    out[gap] = True
    out[gap[data[gap] == 10] + 1] = True
    return out
