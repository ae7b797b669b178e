"""Statistical detector: z-scores against an exponentially weighted baseline, over all flows in order.

Both recurrences are affine in the state, so a block of rows acts on the state it starts from by a
few numbers per feature. With ``q = 1 - alpha``, a block of ``n`` rows whose own reference is its
first row ``r`` and which starts from mean ``m`` and variance ``v`` (``u = m - r``) ends at

    mean = r + S + q^n u
    var  = q^n v + A - 2 u B + u^2 q^n (1 - q^n)

where S, A and B come from running the block from mean ``r`` alone. One pass summarises all blocks
in parallel, summaries of neighbours are composed in a tree (``operators/scan.py``), one pass scores all blocks in parallel. Over
blocks ordered by entity the same passes keep a baseline per entity, however many blocks one spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.ordered import OrderedBlocks, carried_in, segments, summaries, without_carry
from tidewatch.operators.scan import ELEMENT, carried, outcome
from tidewatch.sources.storage import materialise

_EPSILON = 1e-8
_CHUNK = 256


@dataclass
class EwmaState:
    """Baseline after ``n`` flows; empty before the first."""

    n: int = 0
    mean: list[float] = field(default_factory=list)
    var: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        schema = "n bigint, mean array<double>, var array<double>"
        spark.createDataFrame([(self.n, self.mean, self.var)], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EwmaState:
        row = spark.read.parquet(path).first()
        return cls(row.n, list(row.mean), list(row["var"]))


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack(columns).astype(np.float64)


def _kernels(alpha: float):
    """``past[i, j]``: weight of row j in the mean before row i; ``decay[i] = q^i``."""
    q = 1.0 - alpha
    i, j = np.indices((_CHUNK, _CHUNK))
    past = np.where(j < i, alpha * q ** np.maximum(i - 1 - j, 0), 0.0)
    return past, q ** np.arange(_CHUNK + 1)


def _chunks(x: np.ndarray):
    for at in range(0, len(x), _CHUNK):
        yield x[at : at + _CHUNK]


class _Summary:
    """What rows do to any state they start from: (n, r, s, a, b) as one array."""

    def __init__(self, reference: np.ndarray) -> None:
        self.n, self.r = 0, reference
        self.s, self.a, self.total = (np.zeros(len(reference)) for _ in range(3))


def _summarise(alpha: float, names: list[str]):
    past, decay = _kernels(alpha)
    q = 1.0 - alpha

    def fresh(batch: pa.RecordBatch, at: int) -> _Summary:
        return _Summary(matrix(batch.slice(at, 1), names)[0])

    def add(own: _Summary, batch: pa.RecordBatch, begin: int, end: int) -> None:
        for c in _chunks(matrix(batch.slice(begin, end - begin), names)):
            m = len(c)
            y = c - own.r
            d = y - (past[:m, :m] @ y + decay[:m, None] * own.s)
            own.s = decay[m] * own.s + alpha * (decay[m - 1 :: -1][:m] @ y)
            own.a = decay[m] * own.a + alpha * (decay[m:0:-1] @ (d * d))
            own.total = own.total + d.sum(axis=0)
            own.n += m

    def done(own: _Summary) -> np.ndarray:
        return np.concatenate([[own.n], own.r, own.s, own.a, alpha * q**own.n * own.total])

    return lambda batches: summaries(batches, fresh, add, done)


def _parts(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return x[0], *np.split(x[1:], 4)


def _composed(alpha: float):
    """Summary of rows y after rows x, for starts relative to the reference of x."""
    q = 1.0 - alpha

    def compose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (n, r, s, a, b), (m, t, u, c, e) = _parts(x), _parts(y)
        f, g = q**n, q**m
        gap = r + s - t  # from the reference of y to the mean that x ends at
        mean = t - r + u + g * gap
        free = g * a + c - 2 * gap * e + gap * gap * g * (1 - g)
        slope = g * b + f * e - gap * f * g * (1 - g)
        return np.concatenate([[n + m], r, mean, free, slope])

    return compose


def _applied(alpha: float, own: np.ndarray, state: EwmaState) -> EwmaState:
    """The state after the summarised rows."""
    n, r, s, a, b = _parts(own)
    # the first flow sets the mean; starting from that mean is the same thing
    mean, var = (r, np.zeros(len(r))) if state.n == 0 else (np.array(state.mean), np.array(state.var))
    u, qn = mean - r, (1.0 - alpha) ** n
    after = qn * var + a - 2 * u * b + u * u * qn * (1 - qn)
    return EwmaState(state.n + int(n), (r + s + qn * u).tolist(), np.maximum(after, 0.0).tolist())


def _score(alpha: float, z_limit: float, warmup: int, names: list[str], start: EwmaState):
    def run(batches):
        past, decay = _kernels(alpha)
        q = 1.0 - alpha
        block = entity = None
        n, mean, var = 0, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cuts, blocks, entities = segments(batch)
            x, scores = matrix(batch, names), np.zeros(batch.num_rows)
            for k, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if blocks[begin] != block or entities[k] != entity:
                    before = carried_in(batch, begin, entities[k]) if blocks[begin] != block else None
                    state = _applied(alpha, before, start) if before is not None else start
                    n, mean, var = state.n, np.array(state.mean), np.array(state.var)
                    if n == 0:
                        mean, var = x[begin].copy(), np.zeros(len(names))
                    block, entity = blocks[begin], entities[k]
                    if n + end - begin <= warmup and k < len(entities) - 1:
                        continue  # an entity that ends here before it is warm: all zero
                for c in _chunks(x[begin:end]):
                    m = len(c)
                    y = c - mean
                    d = y - past[:m, :m] @ y
                    d2 = d * d
                    v = decay[:m, None] * var + q * (past[:m, :m] @ d2)
                    z = np.abs(d) / np.sqrt(v + _EPSILON)
                    combined = 0.6 * (z > z_limit).mean(axis=1) + 0.4 * np.clip(z.max(axis=1) / (z_limit * 3), 0, 1)
                    warm = np.arange(n, n + m) >= warmup
                    scores[begin : begin + m] = np.where(warm, np.clip(combined, 0.0, 1.0), 0.0)
                    mean = mean + alpha * (decay[m - 1 :: -1][:m] @ y)
                    var = decay[m] * var + alpha * (decay[m:0:-1] @ d2)
                    n, begin = n + m, begin + m
            yield without_carry(batch).append_column("statistical_score", pa.array(scores))

    return run


@dataclass(frozen=True)
class EwmaBaseline:
    settings: Settings = DEFAULTS
    features: tuple[str, ...] = tuple(FEATURE_NAMES)

    def _summaries(self, blocks: OrderedBlocks) -> DataFrame:
        slim = blocks.rows.select("_block", *(["_entity"] if blocks.by_entity else []), *self.features)
        return materialise(slim.mapInArrow(_summarise(self.settings.ewma_alpha, list(self.features)), ELEMENT))

    def fit(self, blocks: OrderedBlocks, start: EwmaState | None = None) -> EwmaState:
        """Baseline after running over the rows (pre-warming on benign traffic)."""
        return self._end(self._summaries(blocks), blocks, start or EwmaState())

    def _end(self, elements: DataFrame, blocks: OrderedBlocks, start: EwmaState) -> EwmaState:
        alpha = self.settings.ewma_alpha
        own = outcome(elements, blocks.blocks, _composed(alpha))[1]
        return start if own is None else _applied(alpha, own, start)

    def score(self, blocks: OrderedBlocks, start: EwmaState | None = None) -> tuple[DataFrame, EwmaState]:
        """Rows with ``statistical_score``, and the baseline after the last row. Over blocks ordered by entity every entity
        has a baseline of its own, each from ``start``; see ``score_entities``."""
        start = start or EwmaState()
        elements = self._summaries(blocks)
        end = self._end(elements, blocks, start)
        return self._scored(elements, blocks, start), end

    def score_entities(self, blocks: OrderedBlocks) -> DataFrame:
        """Rows with ``statistical_score`` against the baseline of their own entity."""
        if not blocks.by_entity:
            raise ValueError("order the blocks by entity")
        return self._scored(self._summaries(blocks), blocks, EwmaState())

    def _scored(self, elements: DataFrame, blocks: OrderedBlocks, start: EwmaState) -> DataFrame:
        s = self.settings
        before = carried(elements, blocks.blocks, _composed(s.ewma_alpha))
        run = _score(s.ewma_alpha, s.ewma_z, s.ewma_warmup, list(self.features), start)
        schema = T.StructType([*blocks.rows.schema.fields, T.StructField("statistical_score", T.DoubleType())])
        return blocks.beside(before).mapInArrow(run, schema)
