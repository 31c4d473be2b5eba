"""Connected components of a link table, by hooking and pointer jumping: over stored tables, or in one task for few links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Distinct links that one task takes at once (4 MB of longs); rounds over more cost the driver a dozen jobs each.
FEW = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the links between ``a`` and ``b``: all their ends, sorted, and the smallest node each can reach."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        to, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(to, root[x], low)
        np.minimum.at(to, root[y], low)
        while (to[to] != to).any():
            to = to[to]
        if (to == root).all():
            return nodes, nodes[root]
        root = to


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all batches, at most ``FEW``, to (node, root)."""
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if ends:
        nodes, roots = smallest(*map(np.concatenate, zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links (two long columns): root is the smallest node that can be reached.

    Up to ``FEW`` distinct links are followed in one task. Of more, each round every group takes the smallest root next to
    it, then roots are followed twice; labels are written to the shared folder after a round, so lost executors cost one
    round at most. Only the numbers of links and changes reach the driver. Self-links and repeated links do no harm; links
    with a null end are left out; no links: no rows.
    """
    one = links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    one = stored(one.distinct(), "edges")
    if one.count() <= FEW:
        return stored(one.coalesce(1).mapInArrow(_at_once, "node long, root long"), "labels")
    edges = one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = stored(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("root")).select(F.col("x").alias("node"), "root"), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("near"))
        hooks = (
            labels.join(near, labels["node"] == near["x"]).groupBy("root").agg(F.min("near").alias("near"))
            .select("root", F.least("root", "near").alias("to"))
        )
        # a root may be the member of another group by now: it moves with that group
        own = labels.select(F.col("node").alias("root"), F.col("root").alias("own"))
        moves = stored(hooks.join(own, "root").select("root", F.least("to", "own").alias("to")), "moves")
        for _ in range(2):
            next_ = moves.select(F.col("root").alias("to"), F.col("to").alias("__next"))
            moves = moves.join(next_, "to", "left").select("root", F.coalesce("__next", "to").alias("to"))
        moved = labels.join(moves, "root").select("node", F.col("to").alias("new"), (F.col("to") != F.col("root")).alias("changed"))
        moved = stored(moved, "labels")
        changed = moved.where("changed").limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
