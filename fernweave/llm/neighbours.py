"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat arrays; the shards' results are merged."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .components import contract

TOP = 20
#: A shard holds about this many vectors where that makes fewer than SHARDS shards; else there are SHARDS, or more where one would hold more rows or bytes than these.
SHARD_LEAST = 4096
SHARDS = 8
SHARD_ROWS = 100_000
SHARD_BYTES = 64 << 20
#: Links a node keeps on the upper levels, and twice that on the lowest; the chance to reach the next level is one in LINKS.
LINKS = 16
#: Links more that a node may get where a part of a level could not be reached else.
SPARE = 2
#: The beam of a new node; that of a query on the lowest level and on those above it (the former where a level is small); nodes that a step expands.
BUILD_BEAM, BEAM, UPPER_BEAM, EXPAND = 64, 256, 64, 8
#: New nodes are linked in batches: no more than there are nodes already, nor than this many.
BATCH = 512
#: A level above of at most this many nodes is compared whole for where to link a new node; queries never are.
SMALL = 1024
#: Queries that one task searches a shard for.
QUERY_BLOCK = 5000
SEED = 42


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components, not zero."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def products(x: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The inner product of x[rows[i]] and q[own[i]] for each i, some at a time, so that the gathered vectors stay in the processor's cache."""
    out = np.empty(len(rows), np.float32)
    step = max(64, (1 << 18) // (4 * x.shape[1]))
    left, right = (np.empty((min(step, len(rows)), x.shape[1]), np.float32) for _ in range(2))
    for a in range(0, len(rows), step):
        k = min(step, len(rows) - a)
        np.take(x, rows[a : a + k], 0, out=left[:k], mode="clip")
        np.take(q, own[a : a + k], 0, out=right[:k], mode="clip")
        np.einsum("ij,ij->i", left[:k], right[:k], out=out[a : a + k])
    return out


def products_of(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inner products of q[i] and x[rows[i, j]]; -inf where rows is negative."""
    score = np.full(rows.shape, -np.inf, np.float32)
    r, c = np.nonzero(rows >= 0)
    score[r, c] = products(x, rows[r, c], q, r)
    return score


def prune(block: np.ndarray, candidates: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of each node's candidates (nearest first; -1: none) those nearer to the node than to any candidate kept before, keep at most; -1 fills up."""
    out = []
    for a in range(0, len(block), 64):  # few at a time: all candidates of a node are compared with each other
        own = candidates[a : a + 64]
        c = x.take(np.maximum(own, 0), 0)
        to_node = c - x[block[a : a + 64]][:, None]
        to_node = np.einsum("ijk,ijk->ij", to_node, to_node)
        to_node[own < 0] = np.inf
        sq = np.einsum("ijk,ijk->ij", c, c)
        between = c @ c.transpose(0, 2, 1)
        between *= -2
        between += sq[:, :, None]
        between += sq[:, None, :]
        chosen = np.zeros(own.shape, bool)
        near = np.full(own.shape, np.inf, np.float32)  # to the nearest candidate kept
        room = np.full(len(own), keep)
        for k in range(own.shape[1]):
            take = np.flatnonzero((to_node[:, k] <= near[:, k]) & (to_node[:, k] < np.inf) & (room > 0))
            chosen[take, k] = True
            room[take] -= 1
            near[take] = np.minimum(near[take], between[take, k])
        # room that is left goes to the nearest of the others
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
        out.append(np.take_along_axis(own, order, 1))
    return np.concatenate(out) if out else candidates[:, :keep]


#: A place of a beam that holds no row: after all others, and not open.
NONE = np.int64(np.iinfo(np.int64).max - 1)


def packed(rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A number for each row and its score (float32) that sorts the best first; its lowest bit, set here, says that the row is open (not expanded yet)."""
    bits = np.ascontiguousarray(scores, np.float32).view(np.int32)
    falling = ~(bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF)))
    return (falling.astype(np.int64) << 32) | (rows.astype(np.int64) << 1) | 1


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of packed(); -1 and -inf where there is NONE."""
    bits = ~(keys >> 32).astype(np.int32)
    scores = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.float32)
    none = keys == NONE
    return np.where(none, -1, (keys & 0xFFFFFFFF) >> 1), np.where(none, np.float32(-np.inf), scores)


def beam_search(x: np.ndarray, place: np.ndarray, links: np.ndarray, q: np.ndarray, rows: np.ndarray, scores: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, inner products; beam of them, best first; -1 and -inf fill up): the best that a beam finds on a level for each of q, from rows on.

    place[r] is row r's place in links, whose values are rows of x. All queries go on at once; a step expands the EXPAND best of each that are not expanded yet.
    Beams are sorted numbers of packed(), and only what is better than a full beam's last goes into it, so a step costs little more than the rows it scores.
    """
    n, m = len(x), len(q)
    width = max(beam, rows.shape[1])
    keys = np.full((m, width), NONE)
    keys[:, : rows.shape[1]] = np.where(rows >= 0, packed(rows, np.where(rows >= 0, scores, -np.inf)), NONE)
    keys.sort(1)
    seen = np.zeros(m * (n + 1), bool)  # a query's n rows, and one that stands for no link
    seen[n :: n + 1] = True
    base = np.arange(m) * (n + 1)
    seen[(base[:, None] + rows)[rows >= 0]] = True
    out = keys.copy()
    live = np.arange(m)
    while len(live):
        open_ = (keys & 1).astype(bool)
        some = open_.any(1)
        if not some.all():
            out[live[~some]] = keys[~some]
            live, keys, open_ = live[some], keys[some], open_[some]
            if not len(live):
                break
        r, c = np.nonzero(open_ & (np.cumsum(open_, 1, dtype=np.int32) <= EXPAND))
        chosen = keys[r, c]
        keys[r, c] = chosen - 1
        near = links[place[(chosen & 0xFFFFFFFF) >> 1]]
        at = (base[live[r]][:, None] + np.where(near < 0, n, near)).ravel()
        at = np.sort(at[~seen[at]])
        if not len(at):
            continue
        at = at[np.append(True, at[1:] != at[:-1])]
        seen[at] = True
        own, row = np.divmod(at, n + 1)
        score = products(x, row, q, own)
        new, own = packed(row, score), np.searchsorted(live, own)
        good = new < keys[own, -1]
        new, own = new[good], own[good]
        if not len(new):
            continue
        count = np.bincount(own, minlength=len(live))
        more = np.full((len(live), int(count.max())), NONE)
        more[own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] = new
        keys = np.sort(np.concatenate([keys, more], 1), 1)[:, :width]
    return unpacked(out)


def nearest_first(ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row of ids the most of the highest score, in that order; -1 where the score is -inf."""
    most = min(most, ids.shape[1])
    top = np.argpartition(-score, most - 1, 1)[:, :most]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), 1, kind="stable"), 1)
    return np.where(np.isfinite(np.take_along_axis(score, top, 1)), np.take_along_axis(ids, top, 1), -1)


class Level:
    """A level while it is built: nodes (rows of x), place[row] and links (len(nodes) x width + SPARE, rows; -1 fills up). Vectors all have one norm."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, keep: int, width: int):
        self.x, self.nodes, self.keep, self.width = x, nodes, keep, width
        self.place = np.full(len(x), -1, np.int64)
        self.place[nodes] = np.arange(len(nodes))
        self.links = np.full((len(nodes), width + SPARE), -1, np.int32)

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """As beam_search(), from the rows entry (a row a query) on."""
        score = np.einsum("ijk,ik->ij", self.x[np.maximum(entry, 0)], q)
        return beam_search(self.x, self.place, self.links, q, entry, score, beam)

    def insert(self, batch: np.ndarray, entry: np.ndarray | None) -> None:
        """Links the rows batch: to the best of what a search from entry (None: nothing is linked yet) finds and of the batch itself, and those back to them."""
        q = self.x[batch]
        score = q @ q.T
        np.fill_diagonal(score, -np.inf)
        ids = np.broadcast_to(batch, score.shape)
        mates = nearest_first(ids, score, 2 * self.keep)
        candidates = mates
        if entry is not None:
            found, best = self.search(q, entry, BUILD_BEAM)
            candidates = nearest_first(np.concatenate([found, mates], 1), np.concatenate([best, products_of(self.x, mates, q)], 1), BUILD_BEAM)
        chosen = prune(batch, candidates, self.x, self.keep)
        self.links[self.place[batch], : chosen.shape[1]] = chosen
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel().astype(np.int64)
        self.link_back(source[target >= 0], target[target >= 0])

    def link_back(self, source: np.ndarray, target: np.ndarray) -> None:
        """Adds source to the links of target, pair by pair; a node whose links are full keeps those that prune() takes."""
        known = (self.links[self.place[target]] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        if not len(source):
            return
        score = products(self.x, source, self.x, target)
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        source, target, rank = source[rank < self.width], target[rank < self.width], rank[rank < self.width]
        own, at = np.unique(target, return_inverse=True)
        for a in range(0, len(own), 1024):  # few at a time: prune() compares all candidates of a node with each other
            part = own[a : a + 1024]
            mine = (at >= a) & (at < a + len(part))
            new = np.full((len(part), self.width), -1, np.int64)
            new[at[mine] - a, rank[mine]] = source[mine]
            old = self.links[self.place[part], : self.width].astype(np.int64)
            both = np.concatenate([old, new], 1)
            score = products_of(self.x, both, self.x[part])
            held = int((both >= 0).sum(1).max())
            both = nearest_first(both, score, held)
            full = (both >= 0).sum(1) > self.width
            out = np.full((len(part), self.width), -1, np.int64)
            short = min(self.width, both.shape[1])
            out[:, :short] = both[:, :short]
            if full.any():
                out[full] = prune(part[full], both[full], self.x, self.width)
            self.links[self.place[part], : self.width] = out

    def reached(self, entry: np.ndarray) -> np.ndarray:
        """A flag a node of the level: whether links lead to it from the rows entry."""
        flag = np.zeros(len(self.nodes), bool)
        front = self.place[entry]
        flag[front] = True
        while len(front):
            step = self.links[front]
            step = np.unique(self.place[step[step >= 0]])
            front = step[~flag[step]]
            flag[front] = True
        return flag

    def join_up(self, entry: np.ndarray) -> None:
        """Spare links to whatever can't be reached from entry, so that all nodes can: the first node of each such part, from the nearest that has a spare link."""
        while True:
            flag = self.reached(entry)
            lost = np.flatnonzero(~flag)
            if not len(lost):
                return
            source, target = np.repeat(lost, self.links.shape[1]), self.links[lost].ravel()
            target = np.where(target >= 0, self.place[np.maximum(target, 0)], -1)
            inside = (target >= 0) & ~flag[np.maximum(target, 0)]
            moved = contract(source[inside], target[inside])[0]
            first = np.setdiff1d(lost, moved)[:BATCH]
            free = (self.links[:, -SPARE:] < 0).any(1)
            score = np.where((flag & free)[None, :], self.x[self.nodes[first]] @ self.x[self.nodes].T, -np.inf)
            taken = np.zeros(len(self.nodes), bool)
            for k, f in enumerate(first):  # a node takes one a round
                best = int(np.where(taken, -np.inf, score[k]).argmax())
                if taken[best] or not np.isfinite(score[k, best]):
                    if k:
                        break
                    self.links = np.concatenate([self.links, np.full((len(self.nodes), SPARE), -1, np.int32)], 1)  # all spare links are used
                    break
                taken[best] = True
                spare = np.flatnonzero(self.links[best, self.width :] < 0)[0] + self.width
                self.links[best, spare] = self.nodes[f]


def entries(x: np.ndarray, batch: np.ndarray, built: list[Level], first: np.ndarray) -> np.ndarray:
    """Where the search for each of batch starts on a new level: its nearest on the levels above, built from the top down; first if there are none.

    The lowest level of at most SMALL nodes is compared whole, so that new nodes are sent into the right one of far clusters; those below are searched.
    """
    small = [k for k, above in enumerate(built) if len(above.nodes) <= SMALL]
    entry = np.repeat(first[:, None], len(batch), 0)
    if small:
        nodes = built[small[-1]].nodes
        entry = nearest_first(np.broadcast_to(nodes, (len(batch), len(nodes))), x[batch] @ x[nodes].T, 4)
    for above in built[small[-1] + 1 if small else 0 :]:
        entry = nearest_first(*above.search(x[batch], entry, UPPER_BEAM), 4)
    return entry


class Graph:
    """A shard's vectors with the levels of its graph: nodes[l] (rows) and links[l] (len(nodes[l]) x width, rows; -1 fills up). A search starts at nodes[-1][0]."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.ids, self.nodes, self.links = vectors, ids, nodes, links
        self.x = vectors.astype(np.float32)
        self.places = [np.full(len(vectors), -1, np.int64) for _ in nodes]
        for place, own in zip(self.places, nodes, strict=True):
            place[own] = np.arange(len(own))

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, seed: int = SEED) -> Graph:
        """vectors (n, d); ids (n, any), -1 filled up: the smallest vec_ids that have the vector. Levels are drawn by hashing the first id.

        Largest inner product is nearest in Euclidean distance after one more component that makes all norms equal; links are made there. Nodes enter by levels,
        the highest first, and within a level in batches of at most as many as it holds: a batch searches the levels above and then its own, links to what
        it finds there and among itself, and is linked back. At last every node of a level can be reached from those that are on the next level too.
        """
        n = len(vectors)
        x = vectors.astype(np.float32)
        norm = (x.astype(np.float64) ** 2).sum(1)
        x = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None].astype(np.float32)], axis=1)
        mixed = (ids[:, 0].astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        level = np.floor(-np.log(u) / np.log(LINKS)).astype(int)
        order = np.lexsort((mixed, -level))  # those of higher levels first, in no order else
        built: list[Level] = []
        for at in range(int(level.max()), -1, -1):
            own = order[: int((level >= at).sum())]
            now = Level(x, own, LINKS, LINKS if at else 2 * LINKS)
            top = min(len(built[-1].nodes) if built else 1, len(own))
            held, step = 0, max(32, (32 << 20) // n)
            while held < len(own):
                size = min(max(held, 32), BATCH, step) if held else min(64, len(own))
                batch = own[held : held + size]
                now.insert(batch, entries(x, batch, built, own[:1]) if held else None)
                held += len(batch)
            now.join_up(own[:top])
            built.append(now)
        return cls(vectors, ids, [b.nodes for b in reversed(built)], [b.links for b in reversed(built)])

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Rows of the nearest for each query, nearest first, beam of them; -1 fills up."""
        q = queries.astype(np.float32)
        rows = np.repeat(self.nodes[-1][:1, None], len(q), 0)
        scores = np.einsum("ijk,ik->ij", self.x[rows], q)
        for at in range(len(self.nodes) - 1, -1, -1):
            rows, scores = beam_search(self.x, self.places[at], self.links[at], q, rows, scores, UPPER_BEAM if at and len(self.nodes[at]) > 2 * beam else beam)
        return rows

    HEAD = struct.Struct("<QIII")

    def dumps(self) -> bytes:
        """Flat arrays: sizes; vectors; ids; and for each level its node count, its links' width, nodes and links."""
        out = [self.HEAD.pack(len(self.vectors), self.vectors.shape[1], self.ids.shape[1], len(self.nodes)), self.vectors.astype("<f8").tobytes(), self.ids.astype("<i8").tobytes()]
        for nodes, links in zip(self.nodes, self.links, strict=True):
            out += [struct.pack("<QQ", len(nodes), links.shape[1]), nodes.astype("<i4").tobytes(), links.astype("<i4").tobytes()]
        return b"".join(out)

    @classmethod
    def loads(cls, data: bytes) -> Graph:
        n, d, k, levels = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        vectors = np.frombuffer(data, "<f8", n * d, at).reshape(n, d)
        at += 8 * n * d
        ids = np.frombuffer(data, "<i8", n * k, at).reshape(n, k)
        at += 8 * n * k
        nodes, links = [], []
        for _ in range(levels):
            m, width = struct.unpack_from("<QQ", data, at)
            nodes.append(np.frombuffer(data, "<i4", m, at + 16).astype(np.int64))
            links.append(np.frombuffer(data, "<i4", m * width, at + 16 + 4 * m).reshape(m, width))
            at += 16 + 4 * m + 4 * m * width
        return cls(vectors, ids, nodes, links)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the top rows of this shard for each query but its own; scores in double precision on the vectors given."""
        rows = self.search(queries, max(BEAM, 4 * top))
        score = np.einsum("qkd,qd->qk", self.vectors[np.maximum(rows, 0)], queries)
        score[rows < 0] = -np.inf
        k = min(top + 1, rows.shape[1])
        best = np.argpartition(-score, k - 1, 1)[:, :k]
        rows, score = np.take_along_axis(rows, best, 1), np.take_along_axis(score, best, 1)
        found = np.where((rows >= 0)[:, :, None], self.ids[np.maximum(rows, 0)], -1).reshape(len(rows), -1)
        score = np.repeat(score, self.ids.shape[1], 1)
        bad = (np.repeat(rows < 0, self.ids.shape[1], 1)) | (found == MISSING) | (found == query_ids[:, None])
        score = np.where(bad, -np.inf, score)
        order = np.lexsort((found, -score), axis=1)[:, :top]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        good = np.isfinite(score)
        return np.repeat(query_ids, good.sum(1)), found[good], score[good]


#: Fills up rows of ids; no vec_id has it.
MISSING = np.iinfo(np.int64).min


def streams(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(is it the first of a new key, rows of one key), for batches sorted by their first keys columns."""
    last = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        begin = np.concatenate([[0], np.flatnonzero(change)])
        for a, z in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
            if z > a:
                key = tuple(c[a] for c in columns)
                yield key != last, batch.slice(a, z - a)
                last = key


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_index(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """The graphs of vectors (vec_id, embedding: usable) as rows (shard, d, data), written to the shared folder. Each length of vectors, d, has shards of its own.

    Equal vectors are one node that keeps their top + 1 smallest vec_ids: more can be in no result. They are told by 128 bits of their hashes, repeated rows
    are reduced before they are shuffled, and so are the vec_ids of a vector that very many rows share. The driver gets a count for each length.
    """
    keyed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = keyed.select("vec_id", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(SEED), "embedding").alias("k2"), "embedding")
    once = keyed.groupBy("k1", "k2", "vec_id").agg(F.first("embedding").alias("embedding"))
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    nodes = stored(few.select("k1", "k2", "n", "vec_id", F.size("embedding").alias("d"), F.when(F.col("n") == 1, F.col("embedding")).alias("embedding")), "nodes")
    first, plan = 0, []
    for d, n in sorted(nodes.where("n = 1").groupBy("d").agg(F.count(F.lit(1))).collect()):
        most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * d)))
        shards = max(-(-n // most), min(SHARDS, -(-n // SHARD_LEAST)))
        plan.append((d, first, shards))
        first += shards
    plan = vectors.sparkSession.createDataFrame(plan, "_d int, _first int, _shards int")
    dealt = nodes.join(F.broadcast(plan), nodes["d"] == plan["_d"])
    dealt = dealt.select((F.col("_first") + F.pmod("k1", F.col("_shards"))).cast("int").alias("shard"), "k1", "k2", "n", "vec_id", "embedding")
    dealt = dealt.repartition(max(first, 1), "shard").sortWithinPartitions("shard", "k1", "k2", "n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            n, vec_id = (rows.column(c).to_numpy() for c in ("n", "vec_id"))
            heads = np.flatnonzero(n == 1)
            x = matrix(rows.column("embedding").chunk(0).drop_null())
            ids = np.full((len(x), int(n.max())), MISSING)
            ids[np.searchsorted(heads, np.arange(len(n)), "right") - 1, n - 1] = vec_id
            made = Graph.build(x, ids)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([made.dumps()], pa.binary())], names=["shard", "d", "data"])

        for new, rows in streams(batches, 1):
            if new and held:
                yield close()
                held = []
            shard = rows.column(0)[0].as_py()
            held.append(rows.select(["n", "vec_id", "embedding"]))
        if held:
            yield close()

    return stored(dealt.mapInArrow(build, "shard int, d int, data binary"), "index", "uncompressed")


def search_index(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the top nearest of each of queries (vec_id, embedding), merged over the shards of index.

    A task gets a shard's graph and a block of queries, and streams through them; neither the queries nor the index are broadcast.
    """
    n = queries.count()
    splits = max(1, -(-n // QUERY_BLOCK))
    of_length = index.groupBy("d").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # a row a length
    each = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    graphs = index.select("shard", each.alias("split"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), "data")
    asked = queries.join(F.broadcast(of_length), F.size("embedding") == F.col("d"))
    asked = asked.select(F.explode("shards").alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("kind"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("binary").alias("data"))
    dealt = graphs.union(asked).repartition("shard", "split").sortWithinPartitions("shard", "split", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for new, rows in streams(batches, 2):
            if new:
                graph = Graph.loads(rows.column("data")[0].as_py())
                rows = rows.slice(1)
            for a in range(0, rows.num_rows, 256):
                part = rows.slice(a, 256)
                got = graph.nearest(part.column("vec_id").to_numpy(), matrix(part.column("embedding")), top)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asks: Column, top: int = TOP) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that asks holds for, the top other rows of largest inner product, ties to smaller vec_ids.

    Vectors that are null, zero or hold null or non-finite components, and those without a vec_id, take no part. Vectors of different lengths have no product, so
    each length is searched apart. Repeated rows count once; of rows with one vec_id that asks, the smallest vector does. Other columns are not read. Nothing
    in, nothing out.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = good.where(asks).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search_index(build_index(good, top), queries, top)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
