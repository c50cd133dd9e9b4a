"""SimHash near-duplicate detection with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, buffers, map_arrow, slices, spread, stored, table
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Widths of the segments on the ring, lowest bits first: one more than the distance allowed, so that the budget of the first of a chain is no difference.
SEGMENTS = (13, 13, 13, 13, 12)
#: A bucket of more fingerprints is compared in blocks of this many.
BLOCK = 2048
#: near_copies(), which op10's contract does not bind: words of a shingle; keys of a set and the smallest hashes in each; equal bytes of two sketches at least
#: (of 96; at a similarity of 0.8 fewer have a chance of 1 in a million); the shingles of a block of sets.
COPY_SHINGLE = 5
BANDS, BAND = 24, 4
SKETCH_EQUAL = 56
SET_BLOCK = 200_000


def shingle_hashes(texts: pa.Array, n: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every word shingle of all texts one after another, the number of each text's). A-Z count as a-z; words part at ASCII white space."""
    data, at = buffers(texts)
    data = LOWER[data]
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    bound = np.zeros(size + 1, bool)
    bound[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | bound[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | bound[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = solid.copy()  # each word, and one byte of white space after it
    keep[ends[ends < size]] = True
    data[~solid] = 32
    place = np.cumsum(keep) - 1
    joined = data[keep].tobytes()
    starts_at, lengths = place[starts], ends - starts
    words = np.diff(np.searchsorted(starts, at))
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    a = spread(np.cumsum(words) - words, count)
    z = a + np.repeat(np.minimum(words, n) - 1, count)
    f = xxhash.xxh64_intdigest
    begin, end = starts_at[a].tolist(), (starts_at[z] + lengths[z]).tolist()
    return np.array([f(joined[x:y], seed) for x, y in zip(begin, end, strict=True)], np.uint64), count


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is 1 if it is in over half of them."""
    lanes = np.uint64(0x0101010101010101)
    pieces = -(-count // 255)  # a lane of eight bits counts to 255
    begin = spread(np.zeros(len(count), np.int64), pieces) * 255 + np.repeat(np.cumsum(count) - count, pieces)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    of_doc = (np.cumsum(pieces) - pieces)[some]
    for b in range(8):
        part = np.add.reduceat((hashes >> np.uint64(b)) & lanes, begin)
        sums = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc, axis=0)
        bits = (sums * 2 > count[some, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(b))).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id with text_hash and fingerprint (the 64 bits as a long). A null text has no words and, like every such text, the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, part in slices(binary(batch.column(1)), 1 << 20):
                found.append(majority(*shingle_hashes(part)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "text_hash", "fingerprint"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    return map_arrow(source, run, "doc_id long, text_hash long, fingerprint long")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def chain_keys(fingerprint: Column) -> Column:
    """The keys of a fingerprint: two fingerprints at distance 4 or less share one at least.

    On a ring of five segments the budget is 4/5 of a difference a segment. By the pigeonring principle some segment starts a chain whose first one, two and
    three segments differ in at most 0, 1 and 2 bits together. So the first is equal, of the second one half is equal, and of the third one third is equal:
    5 x 2 x 3 keys. A key holds the three values and where they stand, and nothing hashed.
    """
    low = np.cumsum((0, *SEGMENTS))
    field = lambda a, n: F.shiftrightunsigned(fingerprint, int(a)).bitwiseAND(F.lit((1 << n) - 1))
    split = lambda a, n, k: [(a + n * j // k, n * (j + 1) // k - n * j // k) for j in range(k)]
    keys = []
    for i in range(len(SEGMENTS)):
        s, t = (i + 1) % len(SEGMENTS), (i + 2) % len(SEGMENTS)
        for j, (a, n) in enumerate(split(int(low[s]), SEGMENTS[s], 2)):
            for k, (b, o) in enumerate(split(int(low[t]), SEGMENTS[t], 3)):
                where = (i * 2 + j) * 3 + k
                value = field(low[i], SEGMENTS[i]) + F.shiftleft(field(a, n), 13) + F.shiftleft(field(b, o), 20)
                keys.append(value + F.lit(where << 32))
    return F.array(*keys)


def chained(diff: np.ndarray, first: np.ndarray | int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the chain of segments that starts at first stays within its budget at every length: 1, 2, ... segments differ in at most that share of distance.

    The pigeonring filter: pairs within distance pass it for one start at least, and few others do; what fails needs no full Hamming check.
    """
    low, m = np.cumsum((0, *SEGMENTS)).astype(np.uint64), len(SEGMENTS)
    masks = np.array([(1 << n) - 1 for n in SEGMENTS], np.uint64)
    total, good = np.zeros(np.shape(diff), np.int64), np.ones(np.shape(diff), bool)
    for n in range(1, m):
        s = (np.asarray(first) + n - 1) % m
        total += np.bitwise_count((diff >> low[s]) & masks[s])
        good &= total <= n * distance // m
    return good


def near_pairs(value: np.ndarray, group: np.ndarray, first: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group that connect what lies within distance: all pairs of small runs, a star for each component of large ones.

    A run is a bucket of the chains that start at the segment first; candidates must pass that chain's budgets before their Hamming distance is taken. What
    another chain alone lets pass is linked in that chain's bucket.
    """
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, len(group)))
    a, b = [], []
    few = size <= 48
    n = np.repeat(size[few], size[few])  # a row for each member; it meets the members after it
    top = spread(begin[few], size[few])
    place = spread(np.zeros(int(few.sum()), np.int64), size[few])
    after = n - 1 - place
    left, right = np.repeat(top, after), spread(top + 1, after)
    near = np.flatnonzero(chained(value[left] ^ value[right], first[left], distance))
    left, right = left[near], right[near]
    near = np.bitwise_count(value[left] ^ value[right]) <= distance
    a.append(value[left[near]])
    b.append(value[right[near]])
    for s, k in zip(begin[~few], size[~few], strict=True):
        own = np.unique(value[s : s + k])
        free = np.ones(len(own), bool)
        while free.any():
            root = int(free.argmax())
            free[root], front = False, np.array([root])
            while len(front):
                met = np.zeros(len(own), bool)
                rest = np.flatnonzero(free)
                for f in range(0, len(front), 256):
                    diff = own[front[f : f + 256], None] ^ own[None, rest]
                    x, y = np.nonzero(chained(diff, first[s], distance))
                    met[rest[y[np.bitwise_count(diff[x, y]) <= distance]]] = True
                front = np.flatnonzero(met & free)
                free[front] = False
                a.append(np.full(len(front), own[root]))
                b.append(own[front])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the different fingerprints of distinct just as all pairs at that distance or less would.

    Fingerprints meet in the buckets of their chain keys. A bucket is compared whole; a large one in blocks, every two of them in a task of their own, so no
    task holds more than two blocks, and no pairs are emitted but links. distance is at most 4, for which the keys are made. Spark takes the exploded keys
    for no larger than the fingerprints' file, so the join is never left to its choice: a broadcast of them would fill the driver.
    """
    if distance > DISTANCE:
        raise ValueError(f"the chain keys hold for distances to {DISTANCE}")
    rows = distinct.select("fingerprint", F.explode(chain_keys(F.col("fingerprint"))).alias("key"))
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = rows.join(shared.hint("merge"), "key").withColumn("x", F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "fingerprint")
    met = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            key, x, y, value = (table.column(i).to_numpy() for i in range(4))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            a, b = near_pairs(value.view(np.uint64), np.cumsum(new), (key >> 32) // 6, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            key, x, y = (held.column(i).to_numpy() for i in range(3))
            last = np.flatnonzero((key != key[-1]) | (x != x[-1]) | (y != y[-1]))
            if len(last) and last[-1] >= 20_000:  # the last group may go on in the next batch
                yield found(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield found(held)

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs' doc_id with text_hash, fingerprint (long), component_id, the smallest doc_id that links of distance or less reach, and root, the component's key.

    Equal fingerprints count once from then on, so a group of copies costs one row. Null doc_ids belong to a component as others do; a component of nothing
    else has a null id. Repeated rows are repeated. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distance))
    labelled = distinct.join(roots.hint("merge"), distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    labelled = stored(labelled, "labelled-prints")  # read twice
    smallest = stored(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")  # so that a large component's rows can be split in the join
    own = stored(labelled.join(smallest.hint("merge"), "root").select("fingerprint", "component_id", "root"), "own")  # all rows are then joined with one table
    return prints.join(own.hint("merge"), "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id", "root")


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different COPY_SHINGLE-word shingles of each text, ascending, one text after another; the number of each text's)."""
    hashes, count = shingle_hashes(texts, COPY_SHINGLE)
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(count))


def signatures(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The smallest of BANDS * BAND multiplicative hashes of each run of hashes (a row a run; runs without hashes have zeros)."""
    out = np.zeros((len(count), BANDS * BAND), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        begin = (np.cumsum(count) - count)[some]
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
        for i, f in enumerate(factors):
            out[some, i] = np.minimum.reduceat(hashes * f, begin)
    return out


def set_rows(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text_hash with set (the hash of its shingles as a set; zero if there are none), bands (their keys) and sketch (a byte of each smallest hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(binary(batch.column(1)), 1 << 20):
                hashes, count = token_sets(part)
                least = signatures(hashes, count)
                ends = np.cumsum(count)
                own = [xxhash.xxh64_intdigest(hashes[e - n : e].tobytes(), SEED) if n else 0 for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
                mixed = np.zeros((len(part), BANDS), np.uint64)
                for i in range(BAND):
                    mixed = (mixed ^ least[:, i::BAND]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                mixed += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(part) + 1, BANDS, dtype=np.int32)), pa.array(mixed.view(np.int64).ravel()))
                sketch = pa.array([x.tobytes() for x in (least >> np.uint64(56 - 16)).astype(np.uint8)], pa.binary())
                ids, texts = batch.column(0).slice(row, len(part)), batch.column(2).slice(row, len(part))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(np.array(own, np.uint64).view(np.int64)), bands, sketch], names=["doc_id", "text_hash", "set", "bands", "sketch"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    return map_arrow(source, run, "doc_id long, text_hash long, set long, bands array<long>, sketch binary")


def spanning(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that connect 0..n-1 as all pairs would for which near holds; near(i, rest) says which of rest are near i."""
    free, a, b = np.ones(n, bool), [], []
    for root in range(n):
        if not free[root]:
            continue
        free[root], front = False, [root]
        while front:
            i = front.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            met = rest[near(i, rest)]
            free[met] = False
            front += met.tolist()
            a.append(np.full(len(met), i))
            b.append(met)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def like_sketches(data: list[bytes]):
    x = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    return lambda i, rest: (x[rest] == x[i]).sum(1) >= SKETCH_EQUAL


def like_sets(data: list[bytes]):
    """Whether the Jaccard similarity of two sets is 0.8 or more, in whole numbers."""
    sets = [np.frombuffer(d, np.uint64) for d in data]
    sizes = np.array([len(x) for x in sets], np.int64)
    at = np.cumsum(sizes) - sizes
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(place) + 1, bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        own = place[at[i] : at[i] + sizes[i]]
        out = np.zeros(len(rest), bool)
        fits = np.flatnonzero((5 * sizes[rest] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[rest]))
        if len(fits):
            other = rest[fits]
            mark[own] = True
            common = np.add.reduceat(mark[place[spread(at[other], sizes[other])]].astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
            mark[own] = False
            out[fits] = 9 * common >= 4 * (sizes[i] + sizes[other])
        return out

    return near


def block_links(rows: DataFrame, like, weight: Column, most: int) -> DataFrame:
    """(a, b): links that connect the members of each group of rows (grp, set, data) as all its pairs would for which like() holds.

    A group whose weight is over most is compared in blocks, every two of them in a task of their own.
    """
    blocks = stored(rows.groupBy("grp").agg(F.ceil(F.sum(weight) / F.lit(most)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "blocks")
    met = rows.join(blocks, "grp").withColumn("x", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "set", "data")
    met = met.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, data = None, [], []

        def found() -> pa.RecordBatch:
            a, b = spanning(len(own), like(data))
            ids = np.array(own, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        for batch in batches:
            for g, x, y, s, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, x, y) != last and len(own) > 1:
                    yield found()
                if (g, x, y) != last:
                    last, own, data = (g, x, y), [], []
                own.append(s)
                data.append(d)
        if len(own) > 1:
            yield found()

    return map_arrow(met, compare, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text_hash with root, the key of its component by links of a Jaccard similarity of 0.8 or more over different 5-word shingles.

    At 0.8 fingerprints differ in some 10 of 64 bits, too many for keys of them; so candidates share one of BANDS keys of BAND smallest hashes (a pair at 0.8
    is missed with a chance of 3 in a million) and most of the bytes of their sketches. The candidates' components, small but for real groups of copies, are then compared by
    their whole sets. Equal sets count once. Texts without words are copies of each other.
    """
    rows = stored(set_rows(docs), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = stored(rows.where("set <> 0").groupBy("set").agg(F.min(place).alias("first")), "distinct-sets")
    one = rows.where("set <> 0").groupBy("set").agg(F.min("bands").alias("bands"))
    keys = one.select("set", F.explode("bands").alias("grp"))
    shared = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    met = stored(keys.join(shared.hint("merge"), "grp"), "shared-bands")
    sketches = stored(rows.join(met.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min("sketch").alias("data")), "sketches")
    coarse = components(block_links(met.join(sketches, "set"), like_sketches, F.lit(1), BLOCK))
    members = coarse.select(F.col("node").alias("set"), F.col("root").alias("grp")).unionAll(coarse.select(F.col("root").alias("set"), F.col("root").alias("grp")).distinct())
    wanted = stored(members.join(distinct, "set").select("set", "grp", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text")), "candidates")
    source = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), text_hash().alias("_hash"))
    texts = source.join(wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))).select("set", "text", "grp")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(binary(batch.column(1)), 1 << 20):
                hashes, count = token_sets(part)
                ends = np.cumsum(count)
                data = pa.array([hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), count.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), data, batch.column(2).slice(row, len(part))], names=["set", "data", "grp"])

    sets = stored(map_arrow(texts, shingled, "set long, data binary, grp long").dropDuplicates(["set"]), "candidate-sets")
    roots = components(block_links(sets.select("grp", "set", "data"), like_sets, F.length("data") / F.lit(8), SET_BLOCK))
    return rows.select("doc_id", "text_hash", "set").join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "set").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each component of near copies: that of its smallest doc_id (a null one only if there is no other), of several such the one of the smallest text_hash."""
    return kept_of(docs, near_copies(docs))


def one_of_each_by_simhash(docs: DataFrame) -> DataFrame:
    """docs with one row, as one_of_each() takes it, for each component of links by SimHash, found by the pigeonring filter, or by a Jaccard similarity of 0.8.

    Fingerprints at that similarity differ in some 10 bits, so their links alone would leave near copies; a component of either kind joins those of the other.
    """
    prints = near_duplicates(docs).select("doc_id", "text_hash", F.xxhash64(F.lit("fingerprint"), "root").alias("a"))
    sets = near_copies(docs).select("doc_id", "text_hash", F.xxhash64(F.lit("set"), "root").alias("b"))
    rows = stored(prints.unionByName(sets, allowMissingColumns=True).groupBy("doc_id", "text_hash").agg(F.min("a").alias("a"), F.min("b").alias("b")), "both-roots")
    roots = components(rows.select("a", "b").distinct())
    return kept_of(docs, rows.join(roots.hint("merge"), F.col("a") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "a").alias("root")))


def kept_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row for each root of found (doc_id, text_hash, root)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
