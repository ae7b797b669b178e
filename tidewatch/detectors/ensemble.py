"""The four detectors together: fit, score, keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ewma import EwmaBaseline, EwmaState
from tidewatch.detectors.forest import AttackForest, ForestModel
from tidewatch.detectors.isolation import IsolationForest, IsolationForestModel
from tidewatch.detectors.sequence import SequenceDetector, SequenceModel
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.filters import benign_only
from tidewatch.operators.ordered import OrderedBlocks, ordered_blocks


def _load(loader, spark: SparkSession, path: str):
    """A saved model, or None when there is none at the path."""
    try:
        return loader(spark, path)
    except FileNotFoundError:
        return None
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    except Exception as exc:  # Spark ML reports a missing path through the JVM
        if "Input path does not exist" in str(exc):
            return None
        raise


@dataclass
class DetectorSet:
    """Any detector may be missing; its flows then count with the untrained score."""

    isolation: IsolationForestModel | None = None
    forest: ForestModel | None = None
    sequence: SequenceModel | None = None
    baseline: EwmaState = field(default_factory=EwmaState)
    settings: Settings = DEFAULTS

    def transform_local(self, flows: DataFrame) -> DataFrame:
        """Scores that need only the row itself."""
        out = flows
        if self.isolation is not None:
            out = self.isolation.transform(out)
        if self.forest is not None:
            out = self.forest.transform(out).drop("class_probability")
        return out

    def transform(self, flows: DataFrame, blocks: int | None = None, stored: bool = False) -> DataFrame:
        """All scores. Flows are ordered and stored once for both order-dependent detectors."""
        return self.transform_ordered(ordered_blocks(flows, blocks=blocks, stored=stored))[0]

    def transform_ordered(
        self, ordered: OrderedBlocks, start: EwmaState | None = None, lead: list[list[float]] | None = None
    ) -> tuple[DataFrame, EwmaState, list[list[float]]]:
        """Scores, and the order-dependent state after the last row: baseline and trailing flows.
        ``start`` and ``lead`` are that state from an earlier batch."""
        scored, after = EwmaBaseline(self.settings).score(ordered, start or self.baseline)
        tail: list[list[float]] = []
        if self.sequence is not None:
            names, halo = self.sequence.features, self.sequence.length - 1
            before, tail = ordered.tails(ordered.tail_elements(halo, names), halo, len(names), lead)
            scored = self.sequence.transform(OrderedBlocks(scored, ordered.blocks), before)
        return self.transform_local(scored.drop("_block", "_row")), after, tail

    def top_features(self, n: int = 3) -> list[tuple[str, float]]:
        return self.forest.top_features(n) if self.forest is not None else []

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in (("isolation", self.isolation), ("forest", self.forest), ("sequence", self.sequence)):
            if model is not None:
                model.save(spark, f"{path}/{name}")
        if self.baseline.n:
            self.baseline.save(spark, f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DetectorSet:
        """Whatever was saved under the path; a detector never saved stays untrained."""
        return cls(
            _load(IsolationForestModel.load, spark, f"{path}/isolation"),
            _load(ForestModel.load, spark, f"{path}/forest"),
            _load(SequenceModel.load, spark, f"{path}/sequence"),
            _load(EwmaState.load, spark, f"{path}/baseline") or EwmaState(),
            settings,
        )


def fit_detectors(
    training: DataFrame,
    settings: Settings = DEFAULTS,
    order: tuple[str, ...] | None = None,
    with_sequence: bool = True,
) -> DetectorSet:
    """Anomaly detectors on the benign rows, the classifier on all. Both labels sit on the row, so
    they cannot fall out of step. ``order`` names the event order; without one (a training CSV has
    no time) the stored order of the rows counts."""
    benign = benign_only(training)
    keys = order or ()
    ordered = ordered_blocks(benign.select(*keys, *FEATURE_NAMES), keys)
    return DetectorSet(
        IsolationForest(settings).fit(ordered.rows),
        AttackForest(settings).fit(training),
        SequenceDetector(settings).fit(benign, keys, ordered) if with_sequence else None,
        EwmaBaseline(settings).fit(ordered),
        settings,
    )


def evaluate_classifier(model: ForestModel, test: DataFrame, label: str = "Attack") -> DataFrame:
    """Confusion counts of the held-out rows."""
    return model.transform(test).groupBy(F.col(label).alias("actual"), F.col("attack_label").alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )
