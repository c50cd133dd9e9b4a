"""Packing of documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, map_arrow, ranked, slices, spread, stored, table
from .tokens import default_tokenizer, encoder

LENGTH = 2048
END_ID = 1
#: Column generation ends when the linear program is this near its lower bound.
GAP = 2e-3
MAX_COLUMNS = 3000


def class_sizes(length: int = LENGTH) -> np.ndarray:
    """The sizes that piece lengths are rounded up to: every length to 64, then 32 steps to each doubling, and the full length. About 230 for 2048."""
    out, step, size = [], 1, 0
    while size < length:
        size += step
        out.append(min(size, length))
        if size >= 64 and size & (size - 1) == 0:
            step = max(1, size // 32)
    return np.array(out)


def price(duals: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, float]:
    """The pattern of most worth that fits in length, by unbounded-knapsack dynamic programming over capacities, and its worth."""
    best, last = np.zeros(length + 1), np.full(length + 1, -1)
    fits = np.searchsorted(sizes, np.arange(length + 1), "right")
    for c in range(int(sizes[0]), length + 1):
        worth = best[c - sizes[: fits[c]]] + duals[: fits[c]]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], last[c] = worth[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), length
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return pattern, float(best[length])


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, int]]:
    """(pattern, uses) that meet demand exactly; patterns may hold fewer items than fit.

    The linear program over patterns (fewest sequences, demand met) is solved by the revised simplex method; a knapsack over the duals prices the column that
    enters. The solution is rounded down, and what is left (fewer items than patterns hold) is put into patterns first fit, longest first.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(length // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (length // sizes))
    x = inverse @ demand
    center = sizes / length  # duals of the bound by sizes alone: they are close, and steady the search
    lower = float(center @ demand)
    cost = np.ones(m)
    for step in range(MAX_COLUMNS):
        duals = cost @ inverse
        if cost @ x <= lower * (1 + GAP):
            break
        enters = 1.0
        if duals.min() < -1e-7:  # more of an item than is asked for costs nothing
            pattern, enters = np.zeros(m, np.int64), 0.0
            pattern[int(duals.argmin())] = -1
        else:
            for weight in (0.8, 0.3, 0.0):
                smooth = weight * center + (1 - weight) * np.maximum(duals, 0)
                pattern, worth = price(smooth, sizes, length)
                bound = float(smooth @ demand) / max(worth, 1.0)
                if bound > lower:
                    lower, center = bound, smooth / max(worth, 1.0)
                if float(duals @ pattern) > 1 + 1e-6:
                    break
            else:
                break  # no pattern is worth its sequence: optimal
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        columns[:, r], cost[r] = pattern, enters
        inverse[r] /= d[r]
        d[r] = 0
        inverse -= np.outer(d, inverse[r])
        if step % 50 == 49:  # rounding errors add up
            inverse = np.linalg.inv(columns.astype(float))
        x = np.maximum(inverse @ demand, 0)
    x = np.where(cost > 0, x, 0)
    uses, left, out = np.floor(x + 1e-7).astype(np.int64), demand.astype(np.int64).copy(), []
    for k in np.argsort(-uses, kind="stable"):
        column, n = columns[:, k].copy(), int(uses[k])
        while n and column.any():
            column = np.minimum(column, left)  # a pattern may hold more of an item than is left
            held = column > 0
            if not held.any():
                break
            most = min(n, int((left[held] // column[held]).min()))
            out.append((column.copy(), most))
            left -= most * column
            n -= most
    return out + first_fit(sizes, left, length)


def first_fit(sizes: np.ndarray, left: np.ndarray, length: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for the items left, first fit with the longest first; runs of one size fill a pattern at once."""
    rooms, patterns = [], []
    for k in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[k]), int(left[k])
        for p in range(len(rooms)):
            if not n:
                break
            fit = min(n, rooms[p] // size)
            if fit:
                patterns[p][k] += fit
                rooms[p] -= fit * size
                n -= fit
        while n:
            fit = min(n, length // size)
            pattern = np.zeros(len(sizes), np.int64)
            pattern[k] = fit
            patterns.append(pattern)
            rooms.append(length - fit * size)
            n -= fit
    return [(p, 1) for p in patterns]


class Plan:
    """Where the piece of rank r among the pieces of its class goes: a sequence and a slot in it."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, length: int = LENGTH):
        held = np.flatnonzero(demand)
        tables: dict[int, list] = {int(k): [] for k in held}
        self.sequences, slot_rows = 0, dict.fromkeys(tables, 0)
        for pattern, n in cutting_stock(sizes[held], demand[held], length):
            slot = 0
            for k in np.flatnonzero(pattern)[::-1]:
                a = int(pattern[k])
                c = int(held[k])
                tables[c].append((slot_rows[c], self.sequences, a, slot))
                slot_rows[c] += a * n
                slot += a
            self.sequences += n
        self.tables = {c: np.array(t, np.int64) for c, t in tables.items()}

    def place(self, classes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for c in np.unique(classes):
            rows = np.flatnonzero(classes == c)
            t = self.tables[int(c)]
            at = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
            k = rank[rows] - at[:, 0]
            sequence[rows] = at[:, 1] + k // at[:, 2]
            slot[rows] = at[:, 3] + k % at[:, 2]
        return sequence, slot


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The documents' ids (with end_id at the end) in pieces: doc_id, start, length, doc_tokens, ids (little-endian uint32), text_hash, salt (tells equal rows apart); written to the shared folder.

    All pieces but a document's last have the full length. Null texts are empty; rows with null or repeated doc_ids are documents like others.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for row, texts in slices(binary(batch.column(1)), 2 << 20):
                part = batch.slice(row, len(texts))
                flat, count = code.encode(texts)
                n = count + 1
                ids = np.full(int(n.sum()), end_id, "<u4")
                ids[spread(np.cumsum(n) - n, count)] = flat
                of_doc = np.repeat(np.arange(len(n)), -(-n // length))
                k = spread(np.zeros(len(n), np.int64), -(-n // length))
                start = k * length
                size = np.minimum(n[of_doc] - start, length)
                at = np.concatenate([[0], np.cumsum(size)]) * 4
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.view(np.uint8))])
                own = pa.array(of_doc)
                columns = [part.column(0).take(own), pa.array(start), pa.array(size), pa.array(n[of_doc]), values.cast(pa.binary()), part.column(2).take(own), part.column(3).take(own)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "text_hash", "salt"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("salt"))
    return stored(map_arrow(source, cut, "doc_id long, start long, length long, doc_tokens long, ids binary, text_hash long, salt long"), "pieces")


def pack(found: DataFrame, length: int = LENGTH, carry: Sequence[str] = (), salts: int = 256) -> DataFrame:
    """Pieces (as of pieces(), written, so that both readings agree) with sequence_id and offset, gapless from 0 in each sequence; carry names more columns to keep.

    The driver gets a count for each of some 230 length classes and sends back the patterns' rank intervals; both are bounded by the classes, not by the data.
    Pieces are ranked within their class by distributed numbering, since one length may hold a third of all pieces.
    """
    sizes = class_sizes(length)
    found = found.select("doc_id", "start", "length", "doc_tokens", "text_hash", "salt", *carry)
    found = found.withColumn("_class", class_of(F.col("length"), length))
    demand = np.zeros(len(sizes), np.int64)
    for k, n in found.groupBy("_class").agg(F.count(F.lit(1))).collect():
        demand[k] = n
    plan = Plan(sizes, demand, length)
    numbered = ranked(found, ["_class"], ["doc_id", "start", "text_hash"], "_rank", salts, "salt").drop("text_hash", "salt")
    schema = T.StructType([*numbered.schema, T.StructField("sequence_id", T.LongType()), T.StructField("_slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = plan.place(batch.column("_class").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())], names=schema.names)

    placed = numbered.mapInArrow(place, schema)
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_slot", "_rank", "_class")


def class_of(size: Column, length: int) -> Column:
    """The index in class_sizes(length) of the class of a piece of this size."""
    doubling = F.greatest(F.lit(6), F.floor(F.log2(F.greatest(size, F.lit(1)) - F.lit(0.5))))
    index = F.lit(64) + (doubling - 6) * 32 + F.ceil((size - F.pow(F.lit(2), doubling)) / F.pow(F.lit(2), doubling - 5)) - 1
    return F.least(F.when(size <= 64, size - 1).otherwise(index), F.lit(len(class_sizes(length)) - 1)).cast("int")


def sequences(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian uint32), doc_ids and offsets of its pieces in order."""
    rows = pack(found, length, carry=["ids"])
    row = F.struct("offset", "doc_id", "start", "length", "ids")
    held = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # at most length pieces
    ids = F.aggregate("_rows", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"]))
    return held.select("sequence_id", ids.alias("ids"), F.transform("_rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"), r["offset"].alias("offset"), r["length"].alias("length"))).alias("pieces"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    found = pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids"))
    return pack(found, carry=["ids_crc32"])
