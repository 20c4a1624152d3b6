"""Isolation forest: trees of small hashed samples, grown once, scored in Arrow batches.

The forest is a flat table of nodes of a fixed size (``TREES`` trees of at most
2 * ``SAMPLE`` nodes), so what goes to the tasks does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyforge.sources.scratch import materialize

from .select import exact_quantiles

TREES, SAMPLE = 100, 256
#: Rows that go down a tree together: few enough to stay in the processor's cache.
CHUNK = 8192


def expected_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees: the feature (-1 for a leaf), its cut, the left child (the right one follows it), and the depth a leaf stands for."""

    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean depth over the expected one: near 1 for outliers. A missing feature goes right."""
        inner = self.feature >= 0
        feature, cut = np.where(inner, self.feature, 0).astype(np.intp), np.where(inner, self.cut, np.nan)
        here = np.arange(len(inner))
        # both ways of a node side by side, 0 to the left; a leaf's lead back to it
        ways = np.stack([np.where(inner, self.left, here), np.where(inner, self.left + 1, here)], axis=1).ravel()
        steps = self.steps()
        out = np.empty(len(x))
        for lo in range(0, len(x), CHUNK):
            part = np.ascontiguousarray(x[lo : lo + CHUNK].T)
            flat, n = part.ravel(), part.shape[1]
            rows, total = np.arange(n), np.zeros(n)
            node, at, value, edge, left = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n), np.empty(n, bool)
            for root, deep in zip(self.roots.tolist(), steps, strict=True):
                node.fill(root)
                for _ in range(deep):
                    feature.take(node, out=at, mode="clip")
                    at *= n
                    at += rows
                    flat.take(at, out=value, mode="clip")
                    cut.take(node, out=edge, mode="clip")
                    np.less(value, edge, out=left)
                    node *= 2
                    node += ~left
                    ways.take(node, out=at, mode="clip")
                    node, at = at, node
                total += self.depth.take(node)
            out[lo : lo + CHUNK] = total
        return 2.0 ** (-out / len(self.roots) / max(float(expected_depth(self.sample)), 1e-9))

    def steps(self) -> list[int]:
        """Steps from each root to its deepest leaf."""
        out = []
        for root in self.roots:
            level, deep = np.array([root]), 0
            while len(level := level[self.feature[level] >= 0]):
                level, deep = np.concatenate([self.left[level], self.left[level] + 1]), deep + 1
            out.append(deep)
        return out


def samples(df: DataFrame, features: list[str], trees: int, size: int, seed: int) -> DataFrame:
    """(tree, features ...): for each tree the ``size`` rows with the smallest hashes of the tree and the row's features; all rows where there are fewer.

    A threshold that leaves about twice as many rows goes before the ranking, so only those are shuffled.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    n = rows.count()
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), "tree", *features), F.lit(1 << 52)))
    if n > 2 * size:
        each = each.where(F.col("_h") <= int(2 * size / n * (1 << 52)))
    return each.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", *features))).where(F.col("_r") <= size).select("tree", *features)


def grow_forest(df: DataFrame, features: list[str], trees: int = TREES, size: int = SAMPLE, seed: int = 42) -> Forest:
    """A forest of ``trees`` trees; at most ``trees`` x ``size`` rows come to the driver.

    Cuts are drawn evenly between a node's least and largest value of a feature
    that varies there, to the depth log2 of the sample.
    """
    drawn = samples(df, features, trees, size, seed).toPandas().sort_values(["tree", *features])
    feature, cut, left, depth, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (left, 0), (depth, 0.0)):
            column.append(value)
        return len(feature) - 1

    largest = 1
    for tree, part in drawn.groupby("tree"):
        rng = np.random.default_rng([seed, int(tree)])
        x = part[features].to_numpy(float)
        largest = max(largest, len(x))
        deepest = math.ceil(math.log2(max(len(x), 2)))
        roots.append(node())
        waiting = [(roots[-1], np.arange(len(x)), 0)]
        while waiting:
            at, rows, level = waiting.pop()
            lo, hi = np.nanmin(x[rows], axis=0, initial=np.inf), np.nanmax(x[rows], axis=0, initial=-np.inf)
            varied = np.flatnonzero(lo < hi)
            if level == deepest or len(rows) < 2 or not len(varied):
                depth[at] = level + float(expected_depth(len(rows)))
                continue
            f = int(rng.choice(varied))
            value = float(lo[f] + (hi[f] - lo[f]) * (1 - rng.random()))
            below = x[rows, f] < value
            feature[at], cut[at], left[at] = f, value, node()
            node()
            waiting += [(left[at], rows[below], level + 1), (left[at] + 1, rows[~below], level + 1)]
    if not roots:
        roots.append(node())
    return Forest(features, np.array(feature), np.array(cut), np.array(left), np.array(depth), np.array(roots), largest)


def anomaly_scores(df: DataFrame, forest: Forest, share: float = 0.1) -> DataFrame:
    """Adds ``anomaly_score`` and ``anomaly``, 1 for scores above the 1 - ``share`` quantile of all.

    Scores are written once, and the exact quantile read from them by brackets.
    """

    @pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(forest.scores(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    out = materialize(df.withColumn("anomaly_score", scored(*[F.col(c).cast("double") for c in forest.features])), "anomaly-scores")
    limit = exact_quantiles(out, ["anomaly_score"], [1 - share])["anomaly_score"][0]
    return out.withColumn("anomaly", (F.col("anomaly_score") > F.lit(limit)).cast("int"))


def detection_report(df: DataFrame, y: str, predicted: str, fold: str) -> DataFrame:
    """(precision, recall, f1), each the mean over folds; 0 where a fold has nothing to count."""
    hit = F.sum((F.col(y) == 1).cast("long") * (F.col(predicted) == 1).cast("long"))
    each = df.groupBy(fold).agg(F.coalesce(F.try_divide(hit, F.sum((F.col(predicted) == 1).cast("long"))), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide(hit, F.sum((F.col(y) == 1).cast("long"))), F.lit(0.0)).alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return each.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))
