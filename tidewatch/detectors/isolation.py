"""Isolation forest: trees grown in parallel on small random samples, scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.statistics import exact_percentile
from tidewatch.sources.storage import materialise, spread

_NODE_SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, path double"
_EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n points (Liu, Ting and Zhou, 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree over at most some hundred rows; a leaf has feature -1."""
    nodes: list[list] = [[0, -1, 0.0, -1, -1, 0.0]]
    pending = [(0, np.arange(len(x)), 0)]
    while pending:
        at, rows, depth = pending.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(usable) == 0:
            nodes[at][5] = depth + average_path(len(rows))
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(low[f], high[f])
        if cut >= high[f]:  # neighbouring doubles: rounding must not leave one side empty
            cut = low[f]
        goes_below = part[:, f] <= cut
        below, above = len(nodes), len(nodes) + 1
        nodes[at][1:5] = [f, float(cut), below, above]
        nodes += [[below, -1, 0.0, -1, -1, 0.0], [above, -1, 0.0, -1, -1, 0.0]]
        pending += [(below, rows[goes_below], depth + 1), (above, rows[~goes_below], depth + 1)]
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    """``nodes``: at most ``trees * (2 * sample - 1)`` rows, a size fixed by the settings."""

    nodes: pd.DataFrame
    sample: int
    offset: float
    features: list[str]

    def _packed(self):
        """The trees as complete binary trees of equal depth, so that a step is index arithmetic:
        ``feature`` and ``threshold`` per inner place, ``path`` per place of the last level."""
        nodes = {(t, n): (f, c, lo, hi, p) for t, n, f, c, lo, hi, p in self.nodes.itertuples(index=False)}
        trees = int(self.nodes["tree"].max()) + 1
        depth = max(1, math.ceil(math.log2(max(self.sample, 2))))
        feature, threshold = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf)
        path = np.zeros((trees, 2**depth))
        pending = [(t, 0, 0, 0) for t in range(trees)]  # tree, node, level, place in level
        while pending:
            t, n, level, place = pending.pop()
            f, cut, below, above, length = nodes[t, n]
            if f < 0:
                span = 2 ** (depth - level)
                path[t, place * span : (place + 1) * span] = length
            else:
                feature[t, 2**level - 1 + place], threshold[t, 2**level - 1 + place] = f, cut
                pending += [(t, below, level + 1, 2 * place), (t, above, level + 1, 2 * place + 1)]
        return feature, threshold, path, depth

    def isolation(self) -> Column:
        """2^(-E[h] / c(sample)) of every row: near 1 is easily isolated."""
        feature, threshold, path, depth = self._packed()
        trees, inner = feature.shape
        scale = average_path(self.sample) or 1.0
        flat_feature, flat_threshold, flat_path = feature.ravel(), threshold.ravel(), path.ravel()

        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            out = np.empty(len(x))
            tree_base, leaf_base = np.arange(trees) * inner, np.arange(trees) * 2**depth
            for start in range(0, len(x), 1024):
                part = x[start : start + 1024]
                values, row_base = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
                place = np.zeros((len(part), trees), np.int64)
                for level in range(depth):
                    at = place + (tree_base + (2**level - 1))
                    place = 2 * place + (values.take(flat_feature.take(at) + row_base) > flat_threshold.take(at))
                out[start : start + 1024] = 2.0 ** (-flat_path.take(place + leaf_base).mean(axis=1) / scale)
            return pd.Series(out)

        return F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``isolation_forest_score``: 0.5 at the decision boundary, higher is more anomalous."""
        decision = -F.col("_s") - F.lit(self.offset)
        return (
            df.withColumn("_s", self.isolation())
            .withColumn("isolation_forest_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision)))
            .drop("_s")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = spark.createDataFrame([(self.sample, self.offset, self.features)], "sample int, offset double, features array<string>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/nodes").toPandas(), meta["sample"], meta["offset"], list(meta["features"]))


@dataclass(frozen=True)
class IsolationForest:
    settings: Settings = DEFAULTS
    features: tuple[str, ...] = tuple(FEATURE_NAMES)

    def fit(self, benign: DataFrame) -> IsolationForestModel:
        """Grow on benign rows. Each tree draws ``iso_sample`` of all rows by a hash of their content and the tree's
        number, the same from any partitioning; the boundary is the contamination percentile of the
        scores of all training rows."""
        s = self.settings
        x = spread(materialise(benign.select(*[F.col(c).cast("double").alias(c) for c in self.features])))
        total = x.count()
        if total == 0:
            raise ValueError("no benign rows to fit on")
        sample = min(s.iso_sample, total)
        # every row meets every tree's draw; those far from winning go before anything moves
        chance = min(1.0, 2.0 * sample / total + 16.0 / total)
        content = F.xxhash64(*[F.col(c) for c in self.features])
        lot = lambda tree: F.pmod(F.xxhash64(F.col("_key"), tree, F.lit(s.seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        trees = F.filter(F.sequence(F.lit(0), F.lit(s.iso_trees - 1)), lambda t: lot(t) <= F.lit(chance))
        drawn = (
            x.withColumn("_key", content)
            .withColumn("tree", F.explode(trees))
            .withColumn("_n", F.row_number().over(Window.partitionBy("tree").orderBy(lot(F.col("tree")), "_key")))
            .filter(F.col("_n") <= sample)
            .drop("_n", "_key")
        )
        names, seed, limit = list(self.features), s.seed, max(1, math.ceil(math.log2(max(sample, 2))))

        def build(key, rows: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[0])
            nodes = _grow(rows[names].to_numpy(np.float64), np.random.default_rng([seed, tree]), limit)
            out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "below", "above", "path"])
            out.insert(0, "tree", tree)
            return out

        # growing costs time, not bytes: without a number, small partitions would be merged into one task
        lanes = min(s.iso_trees, benign.sparkSession.sparkContext.defaultParallelism)
        placed = drawn.repartition(lanes, "tree")
        nodes = placed.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
        model = IsolationForestModel(nodes, sample, 0.0, names)
        scores = materialise(x.select((-model.isolation()).alias("v")))
        model.offset = float(exact_percentile(scores, "v", s.iso_contamination))
        return model
