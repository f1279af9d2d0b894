"""Gradient-boosted trees: trained by Spark on a bounded table of labelled rows, then taken out as plain nodes.

The nodes score as SQL expressions (all work stays in the JVM) or over numpy columns inside a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (weight, root); a node is a leaf value, or (feature, threshold, left, right): left if at most the threshold.
Trees = list[tuple[float, object]]


def fit(rows: DataFrame, trees: int, depth: int, step: float = 0.3, seed: int = 7) -> Trees:
    """``rows``: ``features`` array<double> and ``label`` 0 or 1, already cut and of bounded number."""
    one = rows.agg(F.min("label"), F.max("label"), F.count("*")).first()
    if not one[2] or one[0] == one[1]:
        return [(1.0, 0.0 if not one[2] else (4.0 if one[0] else -4.0))]
    ready = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=64, minInstancesPerNode=5,
                          cacheNodeIds=False).fit(ready)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        split = n.split()
        return (int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild()))

    return [(float(w), node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode()))
            for w, t in zip(model.treeWeights, model.trees, strict=True)]


def expression(trees: Trees, features: list[Column]) -> Column:
    """The sum of the trees; above 0 means label 1."""

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        i, threshold, left, right = node
        return F.when(features[i] <= threshold, walk(left)).otherwise(walk(right))

    total = F.lit(0.0)
    for weight, root in trees:
        total = total + F.lit(weight) * walk(root)
    return total


def scores(trees: Trees, features: np.ndarray) -> np.ndarray:
    """The sum of the trees for each row of a matrix."""
    total = np.zeros(len(features))

    def walk(node, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] = node
            return
        i, threshold, left, right = node
        goes = features[rows, i] <= threshold
        walk(left, rows[goes], out)
        walk(right, rows[~goes], out)

    for weight, root in trees:
        out = np.zeros(len(features))
        walk(root, np.arange(len(features)), out)
        total += weight * out
    return total
