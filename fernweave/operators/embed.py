"""Vectors from encoders that the user gives: batches, tries after a refusal, pooling."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts a call, tries after the first one, seconds before the second try, doubled for each later one.
BATCH, RETRIES, PAUSE = 128, 3, 1.0


class Throttled(Exception):
    """A service raises this when it wants to be asked again later."""


def _call(encode: Callable, texts: list[str], retries: int, pause: float) -> tuple[list, str | None]:
    """A vector a text, and why there are none. Answers with an index are put in its order; only a Throttled one is asked again."""
    for k in range(retries + 1):
        try:
            got = encode(texts)
            rows = [a["vector"] for a in sorted(got, key=lambda a: a["index"])] if got and isinstance(got[0], dict) else list(got)
            if len(rows) != len(texts):
                raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
            return [[float(x) for x in r] for r in rows], None
        except Throttled as e:
            error = f"Throttled: {e}"
            if k < retries:
                time.sleep(pause * 2**k)
        except Exception as e:  # noqa: BLE001 - a batch that fails has no vectors, and the others go on
            return [None] * len(texts), f"{type(e).__name__}: {e}"
    return [None] * len(texts), error


def encode_texts(texts: DataFrame, encode: Callable, batch: int = BATCH, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """texts (id, text) with the vectors of encode(list of texts): (id, vector, error). Null texts are empty ones.

    encode runs on the executors and gives a vector a text, in their order or as {"index", "vector"}; what it can't do for a batch leaves those rows without vectors
    and with the cause. A partition asks for one batch after another, so the number of partitions bounds how many calls are open at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), batch):
                part = rows.iloc[k : k + batch]
                found, error = _call(encode, [t or "" for t in part["text"]], retries, pause)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": found, "error": error})

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, vector array<float>, error string")


def unit(vector: Column) -> Column:
    """A vector of length 1 in the same direction; one of length 0 stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x + F.lit(0.0)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is not 0, as a unit vector; zeros where the mask is 0 throughout. tokens: array<array<double>>, mask: array<int>."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda p: p["m"] != 0), lambda p: p["t"])
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))
