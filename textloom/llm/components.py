"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that isn't the smallest of its component.

    Each round points every node at its smallest lower neighbour, follows the pointers to their roots and
    contracts the edges to pairs of roots, so that the number of roots at least halves. Rows with nulls and
    loops are ignored; repeated edges count once; no edges give an empty table. Every round is written to the
    shared folder. A hub is one key on one side of plain equi joins, which adaptive execution splits.
    """
    ends = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = scratch.write(edges.where("a is not null and b is not null and a <> b").select(*ends(F.col("a"), F.col("b"))).distinct(), "edges")
    label = None
    while label is None or not e.isEmpty():
        p = scratch.write(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "pointers")
        while True:
            up = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            q = scratch.write(p.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jumped")
            scratch.drop(p)
            p, done = q, q.where("moved").isEmpty()
            if done:
                break
        roots = p.select("node", F.col("parent").alias("root"))
        if label is None:
            label = roots.select("node", F.col("root").alias("component"))
        else:
            old = label
            label = scratch.write(
                label.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
                .unionByName(roots.select("node", F.col("root").alias("component"))),
                "labels",
            )
            scratch.drop(old)
        hi, lo = roots.select(F.col("node").alias("hi"), F.col("root").alias("hi_root")), roots.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        old = e
        e = scratch.write(
            e.join(hi, "hi", "left").join(lo, "lo", "left")
            .select(F.coalesce("hi_root", "hi").alias("a"), F.coalesce("lo_root", "lo").alias("b")).where("a <> b")
            .select(*ends(F.col("a"), F.col("b"))).distinct(),
            "edges",
        )
        scratch.drop(old)
    return label


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` items linked by the pairs (i, j)."""
    label = np.arange(n, dtype=np.int64)
    while len(i):
        low = np.minimum(label[i], label[j])
        roots_i, roots_j = label[i], label[j]  # only roots are hooked, so that no link between trees is forgotten
        np.minimum.at(label, roots_i, low)
        np.minimum.at(label, roots_j, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label
