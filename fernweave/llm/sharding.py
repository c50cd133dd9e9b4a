"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stored, table

#: The ring has 2 ** RING_BITS places; keys and virtual nodes stand on places.
RING_BITS = 16
VIRTUAL_NODES = 512
#: A place of more than this many times the mean rows of a place is numbered by as many tasks as it has such parts.
HEAVY = 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[int]:
    """The shard whose virtual node stands at or next clockwise after each place. The points of a shard do not depend on how many shards there are."""
    places = 1 << RING_BITS
    points: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}:{k}".encode(), digest_size=16).digest()
            place = int.from_bytes(digest[:8], "little") % places
            points[place] = min(points.get(place, (digest, shard)), (digest, shard))  # two on one place: the smaller digest has it
    owner, at = [0] * places, points[min(points)][1]
    for place in range(places - 1, -1, -1):
        at = points[place][1] if place in points else at
        owner[place] = at
    return owner


def bounded(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(place, from rank, to rank, shard, slot of the first): where the keys of each place go.

    Every shard may take its equal part of all keys, rounded so that the parts add up. Places are served in a fixed shuffled order; a place's keys go to the
    virtual node next clockwise, and what its shard has no room for continues clockwise to the next virtual node whose shard has room. All rooms are filled
    in the end, so counts are at most one apart.
    """
    owner, places, total = ring(shards, virtual_nodes), 1 << RING_BITS, sum(counts.values())
    room = [total // shards + (k < total % shards) for k in range(shards)]
    used, out = [0] * shards, []
    for place in sorted(counts, key=lambda p: int(f"{p:0{RING_BITS}b}"[::-1], 2)):
        rank, at = 0, place
        while rank < counts[place]:
            shard = owner[at % places]
            n = min(counts[place] - rank, room[shard] - used[shard])
            if n:
                out.append((place, rank, rank + n, shard, used[shard]))
                used[shard] += n
                rank += n
            at += 1
    return out


def shard_rows(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, shard and slot (gapless from 0 in each shard); other columns are not read.

    A key is a doc_id with its text, so a doc_id that many rows share is spread too. Its hash is its place on the ring. Nulls: a null text is empty, a null
    doc_id is a key of its own. The driver gets a count a place, 65,536 at most, and broadcasts as many ranges and a few more; a place of very many rows, equal
    ones too, is numbered by tasks that share it, since each row has a stored salt. Rows without texts are written once and read twice.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    keyed = stored(keyed.withColumn("_place", F.shiftrightunsigned("_key", 64 - RING_BITS).cast("int")), "keys")
    counts = {r[0]: r[1] for r in keyed.groupBy("_place").agg(F.count(F.lit(1))).collect()}
    ranges = spark.createDataFrame(bounded(counts, shards, virtual_nodes), "_place int, _from long, _to long, shard int, _slot long")
    part = HEAVY * max(1, sum(counts.values()) >> RING_BITS)
    heavy = spark.createDataFrame([(p, -(-n // part)) for p, n in counts.items() if n > part], "_heavy int, _parts int")
    keyed = keyed.join(F.broadcast(heavy), keyed["_place"] == heavy["_heavy"], "left")
    numbered = ranked(keyed, ["_place"], ["_key", "doc_id", "text_crc32"], "_rank", F.coalesce("_parts", F.lit(1)), "_row")
    found = numbered.join(F.broadcast(ranges), (numbered["_place"] == ranges["_place"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards; the law is that of rows: counts at most one apart."""
    out = shard_rows(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
