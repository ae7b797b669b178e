"""Sequence detector: how well ten consecutive flows are rebuilt from a compressed form.

The compressed form is a linear one (principal components of benign windows); a caller may pass a
function of its own that rebuilds a batch of windows instead. Scores therefore have the meaning of
the original's, not its numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ewma import matrix
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.ordered import OrderedBlocks, carried_in, ordered_blocks, segments, without_carry
from tidewatch.operators.sampling import unit_hash
from tidewatch.operators.statistics import collect_moments, exact_percentile
from tidewatch.sources.storage import materialise

Rebuild = Callable[[np.ndarray], np.ndarray]


@dataclass
class SequenceModel:
    mean: list[float]
    std: list[float]
    components: list[list[float]]
    threshold: float
    length: int
    features: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))
    rebuild: Rebuild | None = None

    def _rebuild(self) -> Rebuild:
        if self.rebuild is not None:
            return self.rebuild
        p = np.array(self.components)
        return lambda w: (w @ p) @ p.T

    def _with_error(self, blocks: OrderedBlocks, before: DataFrame | None) -> DataFrame:
        """Append ``_mse`` of the window that ends at each row; NULL while fewer rows came before."""
        rebuild, length, names = self._rebuild(), self.length, self.features
        mean, std = np.array(self.mean), np.array(self.std)
        if before is None:
            before = blocks.tails(blocks.tail_elements(length - 1, names), length - 1, len(names))[0]

        def scaled(x: np.ndarray) -> np.ndarray:
            return np.nan_to_num((x - mean) / std, nan=0.0, posinf=0.0, neginf=0.0)

        def run(batches):
            block = entity = None
            nothing = np.zeros((0, len(names)))
            tail = nothing
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                cuts, numbers, entities = segments(batch)
                x, out = scaled(matrix(batch, names)), np.full(batch.num_rows, np.nan)
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if numbers[a] != block:
                        held = carried_in(batch, a, entities[k])
                        tail = nothing if held is None else scaled(held.reshape(-1, len(names)))
                    elif entities[k] != entity:
                        tail = nothing
                    block, entity = numbers[a], entities[k]
                    joined = np.vstack([tail, x[a:b]])
                    if len(joined) >= length:
                        windows = np.lib.stride_tricks.sliding_window_view(joined, length, axis=0)
                        first = b - len(windows)
                        for at in range(0, len(windows), 1024):
                            w = windows[at : at + 1024].transpose(0, 2, 1).reshape(-1, length * len(names))
                            out[first + at : first + at + len(w)] = ((w - rebuild(w)) ** 2).mean(axis=1)
                    tail = joined[len(joined) - min(length - 1, len(joined)) :]
                yield without_carry(batch).append_column("_mse", pa.array(out, mask=np.isnan(out)))

        schema = T.StructType([*blocks.rows.schema.fields, T.StructField("_mse", T.DoubleType())])
        return blocks.beside(before).mapInArrow(run, schema)

    def transform(self, blocks: OrderedBlocks, before: DataFrame | None = None) -> DataFrame:
        """Rows with ``sequence_score``: error over threshold, at most 1; 0.5 without a full window. Over blocks ordered by
        entity, windows are of one entity. ``before``: what comes before each block, when it is known already."""
        # least() skips NULLs, so rows without a window are told apart first
        capped = F.least(F.lit(1.0), F.col("_mse") / F.lit(self.threshold))
        score = F.when(F.col("_mse").isNull(), F.lit(0.5)).otherwise(capped)
        return self._with_error(blocks, before).withColumn("sequence_score", score).drop("_mse")

    def save(self, spark: SparkSession, path: str) -> None:
        schema = "mean array<double>, std array<double>, components array<array<double>>, threshold double, length int, features array<string>"
        row = (self.mean, self.std, self.components, self.threshold, self.length, self.features)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceModel:
        r = spark.read.parquet(path).first()
        components = [list(c) for c in r["components"]]
        return cls(list(r["mean"]), list(r["std"]), components, r["threshold"], r["length"], list(r["features"]))


@dataclass(frozen=True)
class SequenceDetector:
    settings: Settings = DEFAULTS
    features: tuple[str, ...] = tuple(FEATURE_NAMES)
    components: int = 16
    block: int = 1000

    def fit(self, benign: DataFrame, order: tuple[str, ...] = ("ts", "uid"), blocks: OrderedBlocks | None = None) -> SequenceModel:
        """Fit on all benign rows in event order, split by blocks of consecutive rows into training and
        held-out windows, so that no window shares rows with one on the other side. No window of a training block is built: the
        covariance of its windows follows from products of its rows with the rows some places on. The threshold is the 95th percentile of the
        held-out error of the model kept."""
        s, names = self.settings, list(self.features)
        ordered = blocks or ordered_blocks(benign.select(*order, *names), order)
        stats = collect_moments(ordered.rows, names)
        mean, std = [stats[n][0] for n in names], [stats[n][1] for n in names]
        # windows stay inside blocks of positions
        number = F.floor(F.col("_position") / self.block)
        rows = ordered.with_position().select(number.alias("_of"), "_position", *[F.col(c).cast("double").alias(c) for c in names])
        held = unit_hash(F.col("_of"), s.seed) < F.lit(s.sequence_validation_fraction)
        blocked = lambda part: part.repartition("_of").sortWithinPartitions("_of", "_position")
        train, held_out = rows.filter(~held), rows.filter(held)
        scaled = _scaling(mean, std)
        sums = blocked(train).mapInArrow(_lagged(names, s.sequence_length, scaled), "i int, v array<double>")
        k = min(self.components, len(names) * s.sequence_length)
        model = SequenceModel(mean, std, _principal(sums, k).tolist(), s.sequence_threshold, s.sequence_length, names)
        error = _errors(names, s.sequence_length, scaled, model._rebuild())
        limit = exact_percentile(materialise(blocked(held_out).mapInArrow(error, "e double")), "e", 0.95)
        if limit is None:
            limit = exact_percentile(materialise(blocked(train).mapInArrow(error, "e double")), "e", 0.95)
        if limit:
            model.threshold = float(limit)
        return model


def _scaling(mean: list[float], std: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    m, d = np.array(mean), np.array(std)
    return lambda x: np.nan_to_num((x - m) / d, nan=0.0, posinf=0.0, neginf=0.0)


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[np.ndarray]:
    """The rows of each block of positions, from batches that may cut blocks."""
    of, held = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        numbers, x = batch.column(0).to_numpy(), matrix(batch, names)
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if numbers[a] != of and held:
                yield np.concatenate(held)
                held = []
            of = numbers[a]
            held.append(x[a:b])
    if held:
        yield np.concatenate(held)


def _lagged(names: list[str], length: int, scaled: Callable[[np.ndarray], np.ndarray]):
    """Per task: for row i of the windows' covariance (element i of all windows times each element) its sums, and as row -1
    the sums of the elements with the number of windows.

    Elements i and i + l of all windows of a block are its rows from i on and those l places further. Only the first and the
    last row of that run change with i, so one product of matrices per lag serves all i."""
    f = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, total, windows = np.zeros((length, length, f, f)), np.zeros((length, f)), 0
        for block in _whole_blocks(batches, names):
            x, n = scaled(block), len(block) - length + 1
            if n < 1:
                continue
            windows += n
            total += np.array([x[i : i + n].sum(axis=0) for i in range(length)])
            for lag in range(length):
                product = x[:n].T @ x[lag : lag + n]
                cross[0, lag] += product
                for i in range(1, length - lag):
                    product = product - np.outer(x[i - 1], x[i - 1 + lag]) + np.outer(x[n + i - 1], x[n + i - 1 + lag])
                    cross[i, i + lag] += product
        if windows:
            for i in range(length):
                for j in range(i):
                    cross[i, j] = cross[j, i].T
            whole = cross.transpose(0, 2, 1, 3).reshape(length * f, length * f)
            sums = [*whole.tolist(), [*total.ravel().tolist(), float(windows)]]
            yield pa.RecordBatch.from_arrays([pa.array([*range(length * f), -1], pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _principal(sums: DataFrame, k: int) -> np.ndarray:
    """The first k principal components, as columns. A row for each element of a window comes to the driver, whatever the data."""
    added = sums.groupBy("i").agg(Summarizer.metrics("sum").summary(array_to_vector("v")).alias("s"))
    rows = {r["i"]: np.array(r["v"]) for r in added.select("i", vector_to_array("s.sum").alias("v")).collect()}
    if not rows:
        raise ValueError("no benign window to fit on")
    n, mean = rows[-1][-1], rows[-1][:-1] / rows[-1][-1]
    cross = np.stack([rows[i] for i in range(len(mean))])
    values, vectors = np.linalg.eigh((cross - n * np.outer(mean, mean)) / max(n - 1, 1))
    return vectors[:, np.argsort(-values, kind="stable")[:k]]


def _errors(names: list[str], length: int, scaled: Callable[[np.ndarray], np.ndarray], rebuild: Rebuild):
    """Per task: the mean squared error of each window of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(batches, names):
            if len(block) < length:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(scaled(block), length, axis=0)
            for at in range(0, len(windows), 1024):
                w = windows[at : at + 1024].transpose(0, 2, 1).reshape(-1, length * len(names))
                yield pa.RecordBatch.from_arrays([pa.array(((w - rebuild(w)) ** 2).mean(axis=1))], names=["e"])

    return run
