"""Toxicity grades by cumulative-link ordinal regression over the words of texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored, table

#: The model is fitted on at most this many labelled documents, those of the smallest hashes; scoring and all else cover every document.
SAMPLE = 8_000
SAMPLE_SEED = 11
#: And on texts of this many bytes together at most, in the same order, so that the driver holds no more whatever the texts' lengths.
SAMPLE_BYTES = 128 << 20
#: A word is a feature if its rate in toxic and in other documents of the sample differs by this many standard errors.
MIN_Z = 5.0
MAX_FEATURES = 1500
#: A word's stems of these lengths count beside the word.
STEMS = (4, 5, 6, 7)
#: A document is toxic if its expected severity is this or more.
REJECT = 0.5
#: Words that a worker remembers; about 50 MB.
REMEMBER = 300_000
WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    """The different words of a text, in lower case; null has none."""
    return set(WORDS.findall(text.lower())) if text else set()


def signs(word: str) -> list[str]:
    """A word's features: itself, and its stems with a mark."""
    return [word, *(word[:n] + "~" for n in STEMS if n < len(word))]


@dataclass
class Model:
    """P(grade <= k) = 1 / (1 + exp(score - thresholds[k])), score being the sum of the weights of a text's words: one weight a word for all thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The scores of texts; which features a word has is remembered for REMEMBER words at most."""
        weights, known, out = self.weights, self.known, np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in words(text):
                has = known.get(w)
                if has is None:
                    has = tuple(f for f in signs(w) if f in weights)
                    if len(known) < REMEMBER:
                        known[w] = has
                if has:
                    found.update(has)
            out[i] = sum(weights[f] for f in sorted(found))
        return out

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(most likely grade, expected severity: the sum over thresholds of the chance to lie above)."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        chance = -np.diff(np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1), axis=1)
        return chance.argmax(1), above.sum(1)


def features_of(text: str | None) -> set[str]:
    return {f for w in words(text) for f in signs(w)}


def select_features(texts: list[str | None], toxic: np.ndarray, min_z: float = MIN_Z, most: int = MAX_FEATURES) -> dict[str, bool]:
    """The features whose document rates differ most between the two kinds, and whether they are more frequent in the toxic."""
    inside, outside = Counter(), Counter()
    for text, t in zip(texts, toxic, strict=True):
        (inside if t else outside).update(features_of(text))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    scored = []
    for w in inside.keys() | outside.keys():
        a, b = inside[w], outside[w]
        if a + b >= 3:
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
            if abs(z) >= min_z:
                scored.append((-abs(z), w, z > 0))
    return {w: more for _, w, more in sorted(scored)[:most]}


def fit_ordinal(rows: list[np.ndarray], d: int, y: np.ndarray, grades: int, l2: float = 0.05, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) of the proportional-odds model for rows (the features, below d, that each has) with grades y.

    The penalised likelihood is climbed by gradient steps with momentum; the gaps between thresholds are kept positive by their logarithms.
    """
    n = len(y)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(d), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, gaps = par[:d], np.exp(par[d + 1 :])
        theta = par[d] + np.concatenate([[0], np.cumsum(gaps)])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.bincount(of, w[at], n)
        hi, lo = sigma(edge[y + 1] - s), sigma(edge[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_theta = np.array([(dhi * (y == k)).sum() - (dlo * (y == k + 1)).sum() for k in range(grades - 1)])
        g = np.concatenate([np.bincount(at, (dlo - dhi)[of], d) - l2 * w, [g_theta.sum()], [g_theta[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * min(1.0, 2 * (1 - t / (steps + 1)))
    return par[:d], par[d] + np.concatenate([[0], np.cumsum(np.exp(par[d + 1 :]))])


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """The model for texts with integer labels: 0 is not toxic, and higher is worse.

    Labels of 0 and 1 alone are made three grades first: the toxic documents with more different toxic features than their median are the severe ones.
    """
    y = np.array(labels, int)
    toxic = y > 0
    if not len(y) or toxic.all() or not toxic.any():  # nothing to tell apart: no words, and the one grade seen
        return Model({}, np.array([-50.0 if len(y) and toxic.all() else 50.0]))
    features = select_features(texts, toxic)
    place = {w: i for i, w in enumerate(features)}
    rows = [np.array(sorted(place[f] for f in features_of(t) & place.keys()), np.int64) for t in texts]
    grade = y
    if y.max() == 1:
        worse = np.array(list(features.values()), bool)
        hits = np.array([worse[r].sum() for r in rows])
        grade = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)
    _, grade = np.unique(grade, return_inverse=True)
    weights, thresholds = fit_ordinal(rows, len(features), grade, int(grade.max()) + 1)
    return Model(dict(zip(features, weights.tolist(), strict=True)), thresholds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SAMPLE_SEED, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents (doc_id, toxic), at most sample of them and sample_bytes of their texts, taken by hash.

    Null labels and labels without a document are left out. A doc_id counts once, with its smallest text and its worst label.
    """
    wanted = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")  # at most sample rows
    order = Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("bytes") <= sample_bytes)
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.select("doc_id", "text", "toxic").collect())
    return fit([t for _, t, _ in got], [int(y) for _, _, y in got])


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity_grade, expected_severity and toxic (0 or 1), in place of columns of these names; a null or empty text has the score of no words.

    A document is toxic if it is expected to be as severe as REJECT and its words speak for it: where most labels are toxic, one without any sign is not.
    """
    docs = docs.drop("severity_grade", "expected_severity", "toxic")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(at).to_pylist())
            best, expected = model.grades(score)
            toxic = (expected >= REJECT) & (score > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(expected), pa.array(toxic.astype(np.int32))], names=[*names, "severity_grade", "expected_severity", "toxic"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "severity_grade int, expected_severity double, toxic int"])
    return map_arrow(docs, run, fields)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not toxic."""
    rows = grade(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")), model)
    return rows.where("toxic = 0").select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's grade and expected severity, by a model from the labelled ones.

    labels says 0 or 1, so the severe grade is made from the texts themselves (see fit()): the grade tells how much toxic vocabulary a toxic document has,
    and no label stands behind the line between the two upper grades.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model).drop("text")
