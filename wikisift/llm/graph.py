"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.sources.tables import materialize

_FEW_LINKS = 200_000


def forest(links: DataFrame) -> DataFrame:
    """Fewer links ``(u, v)`` that connect the same: each task leaves out what its links so far connect.

    A task keeps fewer links than it has nodes, however many it reads; no rows are moved.
    """

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = np.zeros(len(u), bool)
            for i, (x, y) in enumerate(zip(u, v)):
                x, y = root(x), root(y)
                if x != y:
                    parent[x] = y
                    keep[i] = True
            yield b.filter(pa.array(keep))

    links = links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    return links.mapInArrow(run, links.schema)


def _few_solved(links: DataFrame) -> DataFrame:
    """``(label, to)``: the smallest label that each one reaches, by one task. For a bounded number of links, each in both directions."""

    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, u = np.unique(u, return_inverse=True)
        v = np.searchsorted(nodes, v)
        top = np.arange(len(nodes))
        while True:
            low = top.copy()
            np.minimum.at(low, top[u], top[v])
            while ((ends := low[low]) != low).any():
                low = ends
            if (low[top] == top).all():
                break
            top = low[top]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["label", "to"])

    kind = links.schema["u"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(run, f"label {kind}, to {kind}")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``: the smallest node that can be reached.

    Each round hangs every label below its smallest neighbouring label, follows these
    pointers to their ends and relabels the links, so the links that remain shrink
    quickly whatever the shape of a component. Each round is a written table: a lost
    executor costs a re-read. A node with many links only adds rows to pre-aggregated
    minima and to plain joins, which are split when skewed. At most ``_FEW_LINKS`` links
    are followed to their ends by one task: for so few, rounds are nothing but small jobs,
    and each leaves its code and buffers in the executors.
    """
    both = links.select("u", "v").where("u <> v")
    left = materialize(both.union(both.select("v", "u")).distinct(), "links")
    labels = materialize(left.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while count := left.count():
        if count <= _FEW_LINKS:
            hooks = materialize(_few_solved(left), "hooks").withColumnRenamed("label", "component")
            return materialize(labels.join(hooks, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        hooks = left.groupBy(F.col("u").alias("label")).agg(F.min("v").alias("to")).where("`to` < label")
        hooks = materialize(hooks, "hooks")
        while True:
            ends = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            jumped = hooks.join(ends, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            hooks = materialize(jumped, "hooks")
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("label", "to")
        labels = materialize(
            labels.join(hooks.withColumnRenamed("label", "component"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")), "labels",
        )
        for end in ("u", "v"):
            left = left.join(hooks.withColumnRenamed("label", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = materialize(left.where("u <> v").distinct(), "links")
    return labels
