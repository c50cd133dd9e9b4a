"""Mixing of sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 42
#: Hexadecimal digits of a row's hash that name its bin: 4,096 bins a source.
BIN_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, source_size: a row a source) with target: the words the mix should take of it.

    The sources by code point, null last, have the weights in turn, and share the sum of all sizes. Water-filling: with the sources ordered by the water
    level that fills their clamp (epochs x size / weight), a source is clamped if the level that the rest would have lies above its own; the first that is
    not sets the level of all that follow. One pass over a row a source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_clamp", F.lit(float(epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("_clamp") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(Window.partitionBy()), F.sum("_weight").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_clamp").over(before), F.lit(0.0))) / (all_weights - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_clamp") <= F.col("_level") * F.col("_weight"))
    free = F.min(F.when(~F.col("_full"), F.struct(F.col("_clamp") / F.col("_weight"), F.col("source").isNull(), "source", F.col("_level").alias("level")))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.when(F.col("_full"), F.col("_clamp")).otherwise(free["level"] * F.col("_weight")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, cut: bool = True) -> DataFrame:
    """docs (doc_id, source, text and any others) with size, source_size, target and taken: the words that the mix takes of each row, repeats counted.

    A source's whole repetitions take all its rows; the fraction left takes its rows in the order of a seeded hash until the target is reached. The row at the
    target is taken in part, so that a source gets its target to the word; with cut=False a row is whole or left, whichever is nearer.
    Nulls: a null source is a source, a null text has no words, rows with null or equal doc_ids are told apart by their texts. An empty table stays empty.
    A hot source is dealt out by 4,096 bins of a hash of doc_id and text, so a null or shared doc_id is dealt out too; running sums go over bins (4,096 rows a source) and then within one bin.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    mixed = mixed_rows(docs, F.struct(*[F.col(f"`{c}`") for c in kept]), weights, epochs, seed, cut)
    return mixed.select(*[F.col(f"row.`{c}`") for c in kept], "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, row: Column, weights: Sequence[float], epochs: float, seed: int, cut: bool) -> DataFrame:
    """row of each of docs with size, source_size, target and taken, as mix() says. Rows are shuffled once, by source and bin."""
    text, doc_id = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        row.alias("row"),
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
        F.col("doc_id").alias("id"),
        words(text).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), doc_id, F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))).alias("hash"),
    )
    rows = rows.withColumn("bin", F.substring("hash", 1, BIN_DIGITS))
    sums = rows.groupBy("source", "key", "bin").agg(F.sum("size").alias("n"))
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "target")
    bins = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n", "source")
    inner = Window.partitionBy("key", "bin").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(bins.join(goal, "key"), ["key", "bin"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    room = rest - F.col("before") - F.col("inner")
    part = F.least(F.greatest(room, F.lit(0)), F.col("size")) if cut else F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = F.least(whole * F.col("size") + part, F.lit(int(epochs)) * F.col("size")).cast("long")
    return rows.select("row", "size", "source_size", "target", taken.alias("taken"))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken. Rows without words are kept once."""
    mixed = mixed_rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), weights, epochs, seed, False)
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("cast(taken div greatest(size, 1) as int)"))
    return mixed.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, mixed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, []::VARCHAR[] AS full_, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE AS level
  UNION ALL
  SELECT step + 1, f.full_new,
         (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(CASE WHEN list_contains(f.full_new, coalesce('s' || source, 'n')) THEN 3.0 * source_size END), 0))
                 / nullif(sum(CASE WHEN NOT list_contains(f.full_new, coalesce('s' || source, 'n')) THEN w END), 0) FROM s)
  FROM (SELECT step, full_, level, (SELECT list(coalesce('s' || source, 'n')) FROM s WHERE list_contains(fill.full_, coalesce('s' || source, 'n')) OR 3.0 * source_size <= fill.level * w) AS full_new FROM fill) f
  WHERE len(f.full_new) > len(f.full_)
), last AS (
  SELECT full_, level FROM fill ORDER BY step DESC LIMIT 1
), goal AS (
  SELECT source, source_size, CASE WHEN list_contains(l.full_, coalesce('s' || source, 'n')) THEN 3.0 * source_size ELSE l.level * w END::DOUBLE AS target
  FROM s, last l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       least(whole * size + least(greatest(round(target)::BIGINT - whole * source_size - before, 0), size), 3 * size)::BIGINT AS taken
FROM r
"""
