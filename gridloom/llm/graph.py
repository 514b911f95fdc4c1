"""Connected components of a link table, by rounds of smallest neighbours, pointer jumping and contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

#: Rows of a round's tables that a task takes at most on average, and the fewest tasks.
ROWS, TASKS = 250_000, 8


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task reduced to (member, smallest member) per component, without the smallest itself."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b); component is its smallest reachable node.

    Each round: every node points to its smallest neighbour or itself, pointers jump until they end at roots, and links are contracted
    to the roots. Joins on nodes that many others point to are salted. A round has as many tasks as its links ask for, so that the
    last rounds, of few links, don't write many small files. Nothing comes to the driver but row counts.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    most = 0
    while n := edges.count():
        tasks = max(TASKS, 2 * n // ROWS)  # a link has two ends
        most = max(most, tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        up = cut(up.coalesce(tasks))
        while True:  # each jump doubles the reach, so chains take logarithmically many
            over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = salted_join(up, over, ["p"], F.col("node")).select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            jumped = cut(jumped.coalesce(tasks))
            up = jumped.select("node", "p")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(up)
        for end in ("a", "b"):
            to = up.select(F.col("node").alias(end), F.col("p").alias("_p"))
            edges = salted_join(edges, to, [end], F.xxhash64("a", "b")).drop(end).withColumnRenamed("_p", end)
        edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = cut(edges.coalesce(tasks))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = rounds[0]
    for up in rounds[1:]:
        over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        out = salted_join(out, over, ["p"], F.col("node"), "left").select("node", F.coalesce("pp", "p").alias("p"))
    return out.select("node", F.col("p").alias("component")).coalesce(most)
