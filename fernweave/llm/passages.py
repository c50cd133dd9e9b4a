"""Substring dedup: hashes of lines or paragraphs, and, for passages that no line bounds, winnowed hashes of word runs that are extended word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, buffers, free, map_arrow, slices, spread, stored, table
from .simhash import LOWER

#: What op7 and the pipeline remove: a line or a run of words that repeats is removed from this many words on. Shorter ones are common phrases and legal lines.
MIN_WORDS = 25
SEED = 7
#: Random values of bytes, and the odd base of the powers that they are summed with, modulo 2**64.
BYTES = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of binary texts, one text after another: doc, first[doc] (the first word of each, and their number), start and end in code points, and lines,
    the line feeds in the texts before each word."""

    def __init__(self, texts: pa.Array):
        raw, at = buffers(texts)
        size = len(raw)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        bound = np.zeros(size + 1, bool)
        bound[at] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | bound[1:-1]
        last[:-1] &= ~solid[1:] | bound[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at, starts, "right") - 1
        self.first = np.searchsorted(starts, at)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        zero = points[at[self.doc]]
        self.start, self.end = points[starts] - zero, points[ends] - zero
        feed = raw == 10
        feed[:-1] |= (raw[:-1] == 13) & (raw[1:] != 10)
        feed[-1:] |= raw[-1:] == 13
        self.lines = np.cumsum(feed)[starts]
        length = ends - starts + 1  # each word with a space after it
        self.at = np.concatenate([[0], np.cumsum(length)])
        joined = np.full(self.at[-1], 32, np.uint8)
        joined[spread(self.at[:-1], length - 1)] = LOWER[raw[spread(starts, length - 1)]]
        self.joined = joined
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[joined] * powers(BASE, len(joined)), dtype=np.uint64)])
        self.back = powers(BACK, len(joined) + 1)

    def digests(self, n: int) -> np.ndarray:
        """The hash of every n words that follow each other, with A-Z as a-z and one space after each."""
        a, z = self.at[: max(0, len(self.at) - n)], self.at[n:]
        return mixed((self.sums[z] - self.sums[a]) * self.back[a])


def sizes(min_words: int) -> tuple[int, int]:
    """(words of a hashed run, places of a window): min_words words hold one window of such runs."""
    k = (min_words + 2) // 2
    return k, min_words + 1 - k


def units(words: Words, paragraphs: bool = False) -> tuple[np.ndarray, ...]:
    """(first word, words, digest as two longs) of the lines of texts, or of their paragraphs, which blank lines part; blank ones are none.

    The digest is that of 128 bits of the unit with A-Z as a-z and one space between words.
    """
    if not len(words.doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.ones(len(words.doc), bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | (np.diff(words.lines) >= (2 if paragraphs else 1))
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(words.doc)))
    data = words.joined.tobytes()
    digest = b"".join([xxhash.xxh128_digest(data[a : z - 1], SEED) for a, z in zip(words.at[begin].tolist(), words.at[begin + n].tolist(), strict=True)])
    both = np.frombuffer(digest, "<i8").reshape(-1, 2)
    return begin, n, both[:, 0], both[:, 1]


def anchors(words: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(row, index in the text, first word in the text, digest) of the runs of words that stand for texts: of every window of runs the one of the smallest hash.

    The choice depends on the words of the window alone, so whatever min_words words stand at two places have a run in common, wherever they start or end, and
    the runs chosen of a text meet or overlap. Texts of fewer words than min_words have none.
    """
    k, w = sizes(min_words)
    digest = words.digests(k)
    count = np.maximum(np.diff(words.first) - min_words + 1, 0)  # windows of each text
    begin = spread(words.first[:-1], count)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    best, least = begin.copy(), digest[begin]
    for i in range(1, w):
        other = digest[begin + i]
        less = other < least
        best, least = np.where(less, begin + i, best), np.where(less, other, least)
    new = np.ones(len(best), bool)  # within a text the choice never moves back
    new[1:] = best[1:] != best[:-1]
    best = best[new]
    row = words.doc[best]
    per_doc = np.bincount(row, minlength=len(words.first) - 1)
    return row, spread(np.zeros(len(per_doc), np.int64), per_doc), best - words.first[row], digest[best].view(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text with text_hash, 64 bits: what tells apart documents of one doc_id or of none."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.withColumn("text_hash", F.xxhash64("text"))


HASHED = "doc_id long, text_hash long, unit int, pos int, digest long, digest2 long, words int, start int, end int"


def hashed_rows(docs: DataFrame, run_words: int | None, unit_words: int | None, paragraphs: bool = False) -> DataFrame:
    """A row an anchor of docs (doc_id, text), for runs from run_words on, and a row a line or paragraph of unit_words words or more (those have digest2, words,
    start and end); None: none of that kind. Null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, null = [x.split()[0] for x in HASHED.split(", ")], [pa.nulls(0, t) for t in (pa.int64(), *[pa.int32()] * 3)]
        for batch in batches:
            for row, part in slices(binary(batch.column(1)), 1 << 20):
                words = Words(part)
                if run_words:
                    of, unit, pos, digest = anchors(words, run_words)
                    own = pa.array(of + row)
                    small = [pa.array(x.astype(np.int32)) for x in (unit, pos)]
                    rest = [pa.nulls(len(own), x.type) for x in null]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), *small, pa.array(digest), *rest], names=names)
                if unit_words:
                    begin, n, digest, digest2 = units(words, paragraphs)
                    long = n >= unit_words
                    begin, n, digest, digest2 = begin[long], n[long], digest[long], digest2[long]
                    of = words.doc[begin]
                    own, pos = pa.array(of + row), begin - words.first[of]
                    small = [pa.array(x.astype(np.int32)) for x in (n, words.start[begin], words.end[begin + n - 1])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), *[pa.array(pos.astype(np.int32))] * 2, pa.array(digest), pa.array(digest2), *small], names=names)

    return stored(map_arrow(identified(docs), run, HASHED), "hashed")


PLACE = ("doc_id", "text_hash", "pos")
SPAN = ("doc_id", "text_hash", "a", "z", "start", "end", "kept")


def first_of(rows: DataFrame, *digest: str) -> DataFrame:
    """The first place of every digest that stands at more than one: the digest's columns, and first_doc, first_hash, first_pos; written.

    Written, since else the join with it would follow in the aggregation's stage, where a hot digest's rows can't be split.
    """
    place = F.struct(*PLACE)
    found = rows.groupBy(*digest).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    return stored(found.select(*digest, F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash"), F.col("first.pos").alias("first_pos")), "first")


def later(rows: DataFrame, *digest: str) -> DataFrame:
    """The rows whose digest stands at an earlier place too, with that place: earlier by (doc_id, text_hash, pos), null doc_ids first."""
    found = rows.join(first_of(rows, *digest), list(digest))
    return found.where(F.struct(*PLACE) > F.struct(*[F.col(f).alias(c) for f, c in zip(("first_doc", "first_hash", "first_pos"), PLACE, strict=True)]))


def unit_spans(rows: DataFrame) -> DataFrame:
    """The SPANs of all lines or paragraphs (as of hashed_rows()) but the first of each digest, once for each document."""
    found = later(rows.where("digest2 is not null"), "digest", "digest2")
    return found.select("doc_id", "text_hash", F.col("pos").alias("a"), (F.col("pos") + F.col("words")).alias("z"), "start", "end", F.col("first_doc").alias("kept")).distinct()


def merged(spans: DataFrame, min_words: int = 1) -> DataFrame:
    """SPANs that overlap as one, those of min_words words or more: doc_id, text_hash, start, end (code points of the original text), words, kept_doc_id."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("a", "z")
    spans = spans.withColumn("new", F.coalesce((F.col("a") > F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = spans.groupBy("doc_id", "text_hash", "span").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("z") - F.min("a")).cast("long").alias("words"),
        F.min_by("kept", F.struct("a", "kept")).alias("kept_doc_id"),
    )
    return found.where(F.col("words") >= min_words).drop("span")


def repeated_units(docs: DataFrame, min_words: int = 1, paragraphs: bool = False) -> DataFrame:
    """The spans of the lines of docs (doc_id, text), or of their paragraphs, that an earlier place has: all occurrences but the first of each, however short.

    Units are compared with A-Z as a-z and one space between words, by 128 bits of their hash. Columns and order are those of repeated_spans().
    """
    found = unit_spans(hashed_rows(docs, None, max(1, min_words), paragraphs))
    return found.select("doc_id", "text_hash", *[F.col(c).cast("long").alias(c) for c in ("start", "end")], (F.col("z") - F.col("a")).cast("long").alias("words"), F.col("kept").alias("kept_doc_id"))


CONTEXT = "doc_id long, text_hash long, pos int, before array<long>, after array<long>, starts array<int>, ends array<int>"


def contexts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """For the anchors at wanted (doc_id, text_hash, pos): the hashes of the words before (nearest first) and after, as many as a match can go on for, and
    where the span would start and end (code points) with 0, 1, 2, ... of them."""
    k, w = sizes(min_words)
    of = stored(wanted.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at")), "wanted")
    of = of.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "at")
    joined = identified(docs).join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text", "text_hash", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(binary(batch.column(1)), 1 << 20):
                words = Words(part)
                one = words.digests(1).view(np.int64)
                own, rest = [], [[] for _ in range(5)]
                for i, at in enumerate(batch.column(3).slice(row, len(part)).to_pylist()):
                    low, high = words.first[i], words.first[i + 1]
                    for p in at:
                        a, z = low + p, low + p + k
                        left, right = max(low, a - w), min(high, z + w)
                        own.append(row + i)
                        for out, x in zip(rest, (p, one[left:a][::-1], one[z:right], words.start[left : a + 1][::-1], words.end[z - 1 : right]), strict=True):
                            out.append(x)
                kinds = (pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())])
                values = [pa.array(x, t) for x, t in zip(rest, kinds, strict=True)]
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), *values], names=["doc_id", "text_hash", "pos", "before", "after", "starts", "ends"])

    return map_arrow(joined, run, CONTEXT).dropDuplicates(["doc_id", "text_hash", "pos"])


def equal_words(a: Column, b: Column) -> Column:
    """How many elements at the start of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The spans of docs (doc_id, text) to remove: doc_id, text_hash, start, end (code points of the original text), words, kept_doc_id.

    Lines of min_words words or more are removed where an earlier place has the line, as by repeated_units(). Passages that no line bounds are found by anchors:
    of those with one digest the first in the order of (doc_id, text_hash, place) is kept, within a text too (there, one that overlaps it is none). A run of
    anchors that are repeats goes on word by word at both ends for as long as the kept occurrence has the same words. Spans that overlap are one, which counts
    if it holds min_words words. So whatever min_words words or more stand at two places are found. kept_doc_id is that of the first line or anchor, of two the smaller.
    Null doc_ids come first. Rows with one doc_id and different texts are documents of their own; rows equal in both are one document, and its spans are given
    once. Anchors' digests have 64 bits: a chance match alone makes 13 words, which is no span.
    A digest that a third of all anchors share costs a row a task in the aggregation, and its rows are split by adaptive execution in the join; a row that is
    a third of the table is reduced to one in each task before its anchors meet.
    """
    k, w = sizes(min_words)
    both = hashed_rows(docs, min_words, min_words)
    repeats = later(both.where("digest2 is null").select("doc_id", "text_hash", "unit", "pos", "digest"), "digest")
    same_text = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash"))
    repeats = repeats.where(~(same_text & (F.col("pos") < F.col("first_pos") + k)))
    repeats = repeats.select("doc_id", "text_hash", "unit", "pos", "first_doc", "first_hash", "first_pos").distinct()
    repeats = repeats.select("doc_id", "text_hash", "unit", "pos", F.struct(F.col("first_doc").alias("doc_id"), F.col("first_hash").alias("text_hash"), F.col("first_pos").alias("pos")).alias("first"))
    own = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    runs = repeats.withColumn("run", F.col("unit") - F.dense_rank().over(own)).groupBy("doc_id", "text_hash", "run")
    runs = stored(runs.agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.min_by("first", "unit").alias("first_a"), F.max_by("first", "unit").alias("first_z")).drop("run"), "runs")
    wanted = [runs.select("doc_id", "text_hash", F.col(c).alias("pos")) for c in ("a", "z")] + [runs.select(f"{c}.*") for c in ("first_a", "first_z")]
    around = stored(contexts(docs, wanted[0].unionAll(wanted[1]).unionAll(wanted[2]).unionAll(wanted[3]).distinct(), min_words), "contexts")

    def beside(found: DataFrame, doc_id: str, text_hash: str, pos: str, **columns: str) -> DataFrame:
        c = around.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("pos").alias("_pos"), *[F.col(v).alias(n) for n, v in columns.items()])
        return found.join(c, F.col(doc_id).eqNullSafe(c["_id"]) & (F.col(text_hash) == c["_hash"]) & (F.col(pos) == c["_pos"])).drop("_id", "_hash", "_pos")

    found = beside(runs, "doc_id", "text_hash", "a", left="before", starts="starts")
    found = beside(found, "doc_id", "text_hash", "z", right="after", ends="ends")
    found = beside(found, "first_a.doc_id", "first_a.text_hash", "first_a.pos", kept_left="before")
    found = beside(found, "first_z.doc_id", "first_z.text_hash", "first_z.pos", kept_right="after")
    inside = lambda c: F.col("doc_id").eqNullSafe(F.col(f"{c}.doc_id")) & (F.col("text_hash") == F.col(f"{c}.text_hash"))
    # within a text neither end may go on into the words that are kept
    left, right = equal_words(F.col("left"), F.col("kept_left")), equal_words(F.col("right"), F.col("kept_right"))
    left = F.when(inside("first_a"), F.least(left, F.col("a") - F.col("first_a.pos") - k)).otherwise(left)
    right = F.when(inside("first_z"), F.greatest(F.lit(0), F.least(right, F.col("a") - F.col("first_z.pos") - k))).otherwise(right)
    found = found.withColumns({"left": left, "right": right})
    spans = found.select("doc_id", "text_hash", (F.col("a") - F.col("left")).alias("a"), (F.col("z") + k + F.col("right")).alias("z"), F.col("starts")[F.col("left")].alias("start"), F.col("ends")[F.col("right")].alias("end"), F.col("first_a.doc_id").alias("kept"))
    return merged(spans.unionByName(unit_spans(both)), min_words)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of text (and n_chars, where there is one, counted anew); rows and columns stay, whatever they are called."""
    cuts = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left").select("row.*", F.col("cuts").alias(free("cuts", docs.columns)))
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, hit = batch.column(at), batch.column(len(names))
            if hit.null_count < len(hit):
                texts = column.to_pylist()
                for i, spans_ in enumerate(hit.to_pylist()):
                    if spans_:
                        old, out, end = texts[i], [], 0
                        for s in spans_:
                            out.append(old[end : s["start"]])
                            end = s["end"]
                        texts[i] = "".join([*out, old[end:]])
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(len(names))], names=names)

    out = map_arrow(joined, cut, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without repeated lines and passages."""
    return without_spans(docs, repeated_spans(docs, min_words))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that are removed from documents."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "words", "kept_doc_id")
