"""Connected components of a link table, as a chain of shuffles.

Links are first contracted inside each task, then large-star and small-star steps alternate until every
node points at the smallest id of its component. A step keeps at most as many links as it got, a hub's
links are reduced before they are shuffled, and each round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.session import scratch_root

MOST_ROUNDS = 60


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, smallest node reachable)`` of the nodes of the links, over these links alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while not np.array_equal(label, label[label]):
        label = label[label]
    return nodes, nodes[label]


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node with its smallest, without loops."""
    nodes, low = smallest_labels(a, b)
    far = nodes != low
    return nodes[far], low[far]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = contracted(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _lowest(links: DataFrame) -> DataFrame:
    """Smallest partner of each node. Checkpointed, so that a join with it reads two plain shuffles and a hub is split."""
    return links.groupBy("a").agg(F.min("b").alias("low")).checkpoint()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    lowered = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return lowered.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links`` (a, b: long, not null) that isn't its component's smallest.

    A node that is missing from the result is the smallest of its component. Loops and repeated links
    do no harm; no links give no rows.
    """
    scratch_root(links.sparkSession)
    current = links.filter(F.col("a") != F.col("b")).mapInArrow(_contract, "a long, b long").checkpoint()
    seen = None
    for _ in range(MOST_ROUNDS):
        current = _small_star(_large_star(current)).checkpoint()
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = (state["n"], state["h"])
    raise RuntimeError("components did not settle")
