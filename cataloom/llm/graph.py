"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import few, stored

#: Links that are joined into local groups at a time.
LOCAL_LINKS = 1 << 18


class Sets:
    """Disjoint sets of 0..n-1; the least member stands for a set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _local_stars(batches):
    """(node, center): the groups that a piece of the links forms by itself,
    each hung below its least node."""
    for batch in batches:
        for lo in range(0, batch.num_rows, LOCAL_LINKS):
            a, b = (batch.column(i)[lo:lo + LOCAL_LINKS].to_numpy() for i in range(2))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = Sets(len(nodes))
            for i, j in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
                sets.join(i, j)
            center = nodes[[sets.find(i) for i in range(len(nodes))]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(center)], ["node", "center"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b long): the
    smallest node that links lead to.

    A round joins the links of each piece into stars, takes for each node the
    least of its centers (a partial aggregate), looks one step further (the
    least center's own least center), and links the node and all its centers
    to that. It ends when no node has two centers. Distances halve, so rounds
    grow with the logarithm of the longest path. A node in very many links is
    a join key with one row on the other side, which adaptive execution can
    split."""
    links = links.select("a", "b").where("a <> b")
    while True:
        stars = stored(few(links).mapInArrow(_local_stars, "node long, center long").distinct(), narrow=True)
        least = stored(stars.groupBy("node").agg(F.min("center").alias("least"), F.max("center").alias("most")), narrow=True)
        if least.where("least <> most").isEmpty():
            return least.select("node", F.col("least").alias("component"))
        ahead = least.select(F.col("node").alias("next"), F.col("least").alias("further"))
        jumped = stored(least.join(ahead, F.col("least") == F.col("next")).select(F.col("node").alias("jumper"), "least", "further"), narrow=True)
        links = (stars.join(jumped, F.col("node") == F.col("jumper"))
                 .select(F.explode(F.array("node", "center", "least")).alias("a"), F.col("further").alias("b")).where("a <> b"))
