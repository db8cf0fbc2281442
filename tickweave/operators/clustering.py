"""Hierarchical clustering of correlations, and the data behind plots of matrices and ticks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.matrices import CovarianceMatrix
from tickweave.sources.ticks import Ticks


@dataclass(frozen=True)
class Tree:
    """merges[k] = the two clusters joined at heights[k]; leaves are -1, -2, ..., clusters 1, 2, ...; order of leaves."""

    merges: list[tuple[int, int]]
    heights: list[float]
    order: list[int]


_UPDATES = {
    "ward": lambda i, j, k: ((i + k) / (i + j + k), (j + k) / (i + j + k), -k / (i + j + k), 0.0),
    "average": lambda i, j, k: (i / (i + j), j / (i + j), 0.0, 0.0),
    "single": lambda i, j, k: (0.5, 0.5, 0.0, -0.5),
    "complete": lambda i, j, k: (0.5, 0.5, 0.0, 0.5),
}


def correlation_distances(cor: np.ndarray) -> np.ndarray:
    """Euclidean distances between the columns of root(half of one minus correlation)."""
    d = np.sqrt(np.maximum(0.5 * (1 - cor), 0))
    return np.sqrt(np.maximum(((d[:, :, None] - d[:, None, :]) ** 2).sum(axis=0), 0))


def cluster(cor: np.ndarray, linkage: str = "ward") -> Tree:
    """Agglomerative clustering by the recurrence of distances to a merged cluster."""
    if linkage not in _UPDATES:
        raise ValueError(f"unknown linkage {linkage!r}")
    squared = linkage == "ward"
    dist = correlation_distances(cor)
    dist = dist**2 if squared else dist.copy()
    active = {i: (-(i + 1), 1, [i]) for i in range(len(cor))}
    merges, heights = [], []
    while len(active) > 1:
        keys = sorted(active)
        i, j = min(((a, b) for x, a in enumerate(keys) for b in keys[x + 1 :]), key=lambda p: (dist[p], p))
        height = dist[i, j]
        (ci, ni, li), (cj, nj, lj) = active[i], active.pop(j)
        for k in active:
            if k != i:
                a, b, c, g = _UPDATES[linkage](ni, nj, active[k][1])
                dist[i, k] = dist[k, i] = a * dist[i, k] + b * dist[j, k] + c * height + g * abs(dist[i, k] - dist[j, k])
        merges.append((ci, cj))
        heights.append(float(np.sqrt(height)) if squared else float(height))
        active[i] = (len(merges), ni + nj, li + lj)
    order = next(iter(active.values()))[2] if active else []
    return Tree(merges, heights, order)


def reorder_by_cluster(cm: CovarianceMatrix, linkage: str = "ward") -> CovarianceMatrix:
    return cm.rearrange([cm.labels[i] for i in cluster(cm.correlation, linkage).order])


def dendrogram_segments(tree: Tree) -> list[tuple[float, float, float, float]]:
    """Segments (x1, y1, x2, y2) of a dendrogram drawn over the leaf order."""
    place = {-(leaf + 1): (float(x), 0.0) for x, leaf in enumerate(tree.order)}
    out = []
    for k, ((a, b), h) in enumerate(zip(tree.merges, tree.heights, strict=True), 1):
        (xa, ya), (xb, yb) = place[a], place[b]
        out += [(xa, ya, xa, h), (xb, yb, xb, h), (xa, h, xb, h)]
        place[k] = ((xa + xb) / 2, h)
    return out


def heatmap_rows(cor: DataFrame) -> DataFrame:
    """(a, b, cor, label): cells of a heat map, labelled in whole percent."""
    return cor.select("a", "b", "cor", F.concat(F.floor(F.bround("cor", 2) * 100).cast("string"), F.lit("%")).alias("label"))


def heatmap_spec(x: str = "a", y: str = "b", value: str = "cor", title: str = "") -> dict:
    """A Vega-Lite description of a heat map over ``heatmap_rows``."""
    axes = {"x": {"field": x, "type": "nominal"}, "y": {"field": y, "type": "nominal"}}
    return {
        "title": title,
        "encoding": axes,
        "layer": [
            {"mark": "rect", "encoding": {"color": {"field": value, "type": "quantitative", "scale": {"domain": [-1, 1]}}}},
            {"mark": "text", "encoding": {"text": {"field": "label", "type": "nominal"}}},
        ],
    }


def comparison_rows(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cells of two matrices in one heat map: the first above the diagonal, the second below."""
    upper = x.where("a <= b").select("a", "b", "cor")
    return heatmap_rows(upper.unionByName(y.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cor")))


def tick_lines(ticks: Ticks, points: int = 1000) -> DataFrame:
    """(asset, bin, t, value): about ``points`` mean values per asset for a line chart."""
    lo, hi = ticks.extent()
    width = (hi - lo) / points or 1.0
    binned = ticks.df.withColumn("bin", F.floor((F.col("t") - lo) / width))
    return binned.groupBy("asset", "bin").agg(F.min("t").alias("t"), F.avg("value").alias("value"))
