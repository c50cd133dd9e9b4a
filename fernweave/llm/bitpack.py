"""Token ids in fixed-width bit-packed files: the fewest bits that hold the vocabulary, with block offsets for random access."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, map_arrow, slices, spread, stored, table
from .tokens import default_tokenizer, encoder

#: magic, bits an id, ids a block, ids, documents; then, little-endian: block offsets uint64[blocks + 1], doc ids int64[documents],
#: null flags uint8[documents], document starts uint64[documents + 1], blocks.
HEAD = struct.Struct("<8sIIQQ")
MAGIC = b"FWPACK01"
BLOCK_IDS = 4096
#: A file is closed when it holds this many ids; a document is never cut.
FILE_IDS = 1 << 19
END_ID = 2


def width(vocabulary: int) -> int:
    """Bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as a little-endian bit stream of bits each; bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").view(np.uint8)
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little")


def unpack_bits(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return data[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    flags = np.unpackbits(data, bitorder="little", count=n * bits).reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file of the documents' ids, in the order given. An id that needs more bits raises ValueError."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_bits(ids[k : k + block_ids], bits) for k in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block_ids, len(ids), len(doc_ids)), offsets.tobytes(), keys.tobytes(), nulls.tobytes(), starts.tobytes(), *(x.tobytes() for x in blocks)])


class PackedFile:
    """Reads a file; any range of ids is unpacked from the blocks that hold it."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, self.n_ids, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        n_blocks, at = -(-self.n_ids // self.block_ids), HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        keys = np.frombuffer(data, "<i8", n_docs, at)
        nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        at += 9 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, offset=at + 8 * (n_docs + 1))

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError(f"{start}:{end} of {self.n_ids} ids")
        if start == end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-end // self.block_ids)
        data = self.payload[self.offsets[a] : self.offsets[b]]
        n = min(b * self.block_ids, self.n_ids) - a * self.block_ids
        if self.block_ids * self.bits % 8:  # blocks end within a byte: one at a time
            got = np.concatenate([unpack_bits(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block_ids, self.n_ids - k * self.block_ids)) for k in range(a, b)])
        else:
            got = unpack_bits(data, self.bits, n)
        return got[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


ENCODED = "doc_id long, n long, bits binary, salt long"
FILES = "part long, file long, n_docs long, n_ids long, data binary"


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, int]:
    """(doc_id, n, bits, salt: a row a document, its ids with the end id as one run of fixed-width bits; written to the shared folder, the width).

    The tokenizer runs here and nowhere else: what is shuffled into order later are packed ids, less than half of the texts' bytes.
    """
    path = tokenizer or default_tokenizer()
    bits = width(max(encoder(path).vocabulary(), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for row, texts in slices(binary(batch.column(1)), 1 << 20):
                flat, count = code.encode(texts)
                with_end = count + 1
                ids = np.full(int(with_end.sum()), end_id, np.uint32)
                ids[spread(np.cumsum(with_end) - with_end, count)] = flat
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"an id needs more than {bits} bits")
                ends = np.cumsum(with_end)
                data = pa.array([pack_bits(ids[e - n : e], bits).tobytes() for e, n in zip(ends.tolist(), with_end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(with_end), data, batch.column(2).slice(row, len(texts))], names=["doc_id", "n", "bits", "salt"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    return stored(map_arrow(source, run, ENCODED), "encoded"), bits


def packed_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Every text of docs (doc_id, text) as token ids in files, in ascending doc_id order: a row a file with its place (part, file), written to the shared folder.

    Null texts are empty; null doc_ids come first; rows with one doc_id are all kept, in any order. Other columns are not read.
    The packed ids are range-partitioned by doc_id and a stored salt, so that a doc_id of very many rows is divided; a file holds about file_ids ids, more only
    for one long document. A task holds one file's ids.
    """
    rows, bits = encoded(docs, tokenizer, end_id)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        flat: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data = write_file(keys, np.array(counts, np.int64), np.concatenate(flat), bits)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, file, len(keys), sum(counts))] + [pa.array([data], pa.binary())], names=["part", "file", "n_docs", "n_ids", "data"])

        for batch in batches:
            for key, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append(key)
                counts.append(n)
                flat.append(unpack_bits(np.frombuffer(data.as_buffer(), np.uint8), bits, n))
                held += n
                if held >= file_ids:
                    yield close()
                    keys, counts, flat, file, held = [], [], [], file + 1, 0
        if keys:
            yield close()

    ordered = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "n", "bits")
    return stored(map_arrow(ordered, build, FILES), "packed", "snappy")


def file_starts(files: DataFrame) -> DataFrame:
    """(part, file, base): the ids before each of packed_files(). Running sums go over the parts, a row a partition, and within a part."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = files.select("part", "file", inner.alias("inner")).join(before, "part")
    return heads.select("part", "file", (F.col("inner") + F.col("before")).alias("base"))


def read_documents(files: DataFrame) -> DataFrame:
    """The documents of packed_files(), read back where the files stand: part, file, doc_id, at (ids before it in its file), ids (little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                file = PackedFile(data.as_buffer())
                for k in range(0, len(file.doc_ids), 256):
                    docs = file.doc_ids[k : k + 256]
                    starts = file.starts[k : k + len(docs) + 1]
                    ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4").view(np.uint8)
                    at = ((starts - starts[0]) * 4).astype(np.int64)
                    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
                    where = [pa.array(np.full(len(docs), x, np.int64)) for x in (part, number)]
                    yield pa.RecordBatch.from_arrays([*where, pa.array(docs, pa.int64()), pa.array(starts[:-1]), values], names=["part", "file", "doc_id", "at", "ids"])

    return map_arrow(files.select("part", "file", "data"), read, "part long, file long, doc_id long, at long, ids binary")


def placed(files: DataFrame) -> DataFrame:
    """Every document's place and digest, from the files as read back: doc_id, start (ids before it in all files), n_tokens, ids_crc32. No ids are shuffled."""
    docs = read_documents(files).select("part", "file", "doc_id", "at", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(file_starts(files), ["part", "file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest in the packed files, from the files as read back."""
    return placed(packed_files(table(spark, sf_dir, "documents")))
