"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: A node with more neighbours than this and than its share of all links is a hub; there are at most 2 * ``HUBS`` of them.
HUB_LINKS, HUBS = 1000, 50_000
#: Links that are made a forest at once, and links of a task.
FOREST_LINKS, TASK_LINKS = 1 << 20, 200_000


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``edges`` (u, v) with ``least`` of u, from a table of u, n (its neighbours) and least.

    No key of the join has more than ``most`` rows: hubs meet their rows by a broadcast,
    which is small whatever the input, as ``most`` is at least the number of links by ``HUBS``.
    """
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col("least").alias("_of_hub")))
    tagged = edges.join(hubs, "u", "left")
    others = tagged.where("_of_hub IS NULL").select("u", "v").join(least.where(F.col("n") <= most).select("u", "least"), "u")
    return tagged.where("_of_hub IS NOT NULL").select("u", "v", F.col("_of_hub").alias("least")).unionByName(others)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what ``u`` and ``v`` join: each node once, its root being the smallest that it reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
    at = np.flatnonzero(root < np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest for every ``FOREST_LINKS`` links (u, v) of a partition, whose links it replaces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        u, v = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_pydict({"u": u, "v": v})

    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        if sum(len(u) for u, _ in held) >= FOREST_LINKS:
            yield made()
    if held:
        yield made()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node of ``links`` (a, b).

    What lies in one partition is replaced by its forest. A round then hangs each node's
    larger neighbours on its smallest one and then its smaller ones, by an aggregate and
    a join, so no node's neighbours are ever gathered. Rounds go on until every node is
    either a root or has one smaller neighbour and no larger one; each is stored in the
    shared folder and the one before it deleted. The tables are as many tasks as their
    links fill (``TASK_LINKS``), and one a core at least.
    """
    forests = lambda df: df.mapInArrow(_forests, "u long, v long")
    edges = stored(forests(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    while True:
        count = edges.count()
        most = max(HUB_LINKS, count // HUBS)
        tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_LINKS))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.count("*").alias("n"), F.least("u", F.min("v")).alias("least"), F.max("v").alias("largest")).coalesce(tasks))
        if not least.where("least < u AND largest > least").limit(1).count():
            drop_stored(edges)
            return least.select(F.col("u").alias("node"), F.col("least").alias("component"))
        large = stored(_with_least(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, most).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        first = stored(large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("least")).coalesce(tasks))
        pairs = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v"))))
        small = stored(forests(_with_least(large, first, most).select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").coalesce(tasks).distinct().coalesce(tasks)))
        for old in (edges, least, large, first):
            drop_stored(old)
        edges = small
