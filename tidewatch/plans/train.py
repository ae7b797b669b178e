"""Training job: clean, split, fit, keep, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ensemble import DetectorSet, evaluate_classifier, fit_detectors
from tidewatch.operators.sampling import unit_hash
from tidewatch.operators.statistics import feature_matrix
from tidewatch.sources.storage import stored_table


@dataclass
class Training:
    detectors: DetectorSet
    train: DataFrame
    test: DataFrame

    def confusion(self) -> DataFrame:
        return evaluate_classifier(self.detectors.forest, self.test)


def prepare(rows: DataFrame, settings: Settings = DEFAULTS, key: tuple[str, ...] = ()) -> DataFrame:
    """All rows, cleaned and stored, with ``_u``: a number in [0, 1) by hash of the key, so that splits agree on every
    run and partitioning. A training CSV has no key: the row's whole content takes its place, and copies go together."""
    by = [F.col(c) for c in key] if key else [F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])]
    drawn = rows.withColumn("_u", unit_hash(F.concat_ws("|", *by), settings.seed))
    return stored_table(feature_matrix(drawn.drop("uid", "ts"), keep=["Attack", "Label"]), "training")


def train(
    rows: DataFrame,
    settings: Settings = DEFAULTS,
    save_to: str | None = None,
    order: tuple[str, ...] | None = None,
    with_sequence: bool = True,
    key: tuple[str, ...] = (),
) -> Training:
    """Anomaly detectors see all benign training rows, the classifier all training rows."""
    data = prepare(rows, settings, key)
    train_rows, test_rows = (data.filter(part).drop("_u") for part in (F.col("_u") >= settings.test_fraction, F.col("_u") < settings.test_fraction))
    detectors = fit_detectors(train_rows, settings, order, with_sequence)
    if save_to:
        spark: SparkSession = rows.sparkSession
        detectors.save(spark, save_to)
    return Training(detectors, train_rows, test_rows)
