"""Connected components of links that no single machine need hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fernweave.operators.components import star_components
from fernweave.storage import stored

#: Links that one task finishes alone, 16 bytes each, after each partition has shrunk its own; more go through rounds of joins.
ALONE = 1 << 20
#: Links that a task gathers at least before it shrinks them.
GATHER = 1 << 16


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these links that are not smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # follow labels of labels
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """links (a long, b long) as (node, root): the smallest node of each node's component, for all nodes of links but the roots themselves.

    Each partition first shrinks its own links to stars. Of what is left, at most alone links are finished by one task, and more by the rounds of
    star_components(): a round is some 14 stages, each of as many tasks as there are shuffle partitions, however few the rows. The result is written.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more, n = [], 0

        def both() -> tuple[np.ndarray, np.ndarray]:
            return contract(*(np.concatenate([held, *(x.column(i).to_numpy() for x in more)]) for i, held in enumerate((a, b))))

        for batch in batches:
            more.append(batch)
            n += batch.num_rows
            if n >= max(GATHER, len(a)):  # else each batch would cost as much as all before it
                (a, b), more, n = both(), [], 0
        a, b = both()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    given = links.where("a is not null and b is not null and a <> b")

    def finish(edges: DataFrame) -> DataFrame | None:
        if edges.count() > alone:
            return None
        return stored(edges.coalesce(1).mapInArrow(shrink, "a long, b long").toDF("node", "root"), "roots")

    return star_components(given.mapInArrow(shrink, "a long, b long"), finish)
