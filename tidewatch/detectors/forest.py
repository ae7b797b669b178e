"""Random-forest attack classifier: bootstrap samples, balanced weights, Gini gain over a random subset of features per node.

Values are binned once. Nodes of more than about ``_ROWS`` rows are split by histograms summed over all tasks, which also tell how
large the children are; what lies below is grown by one task per subtree, which gets the rows of its node. A large node that is
pure or at the full depth is a leaf already and its rows go nowhere. So the data is gone over once for each level of large nodes and
once for each wave of trees, not once for every few deep nodes. Rows travel as few bytes: features of few bins share one. One
histogram counts several features of a node at once, small nodes of a subtree are split many at a time. Trees are a stored table; only their leaves of that kind pass through the driver.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.fixed_values import BENIGN, FEATURE_NAMES, UNKNOWN_ALTERNATIVE, UNKNOWN_LABEL
from tidewatch.operators.statistics import class_weights, label_ids, with_label_id
from tidewatch.sources.storage import scratch_path, spread, stored_table

_PROBABILITY = "class_probability"
_BINS = 32
_ROWS = 1_000_000  # a node of about so many drawn rows at most is grown on by one task
_SHARE = 1 - math.exp(-1)  # drawn rows for each draw
_BELOW = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # chance of k draws of a row at most
_TIMES = np.searchsorted(_BELOW, np.arange(1 << 16) / (1 << 16), side="right").astype(np.uint8)
_UNSURE = np.searchsorted(_BELOW, (np.arange(1 << 16) + 1) / (1 << 16), side="right") != _TIMES
_CELLS = 8192  # of a histogram of several features
_FEW_CELLS = 1 << 16  # of the histograms of such nodes that are made at once
_ROUTED = 16384
_FEW = 4096  # nodes of fewer rows are split many at a time
_BUFFER_BYTES = 32_000_000  # rows that a task holds for subtrees before it sends them on
_WAVE_BYTES = 4_000_000_000  # trees grown at once: as many as their drawn rows take
_ONE = 1 << 40  # votes are whole numbers, so that their sums don't depend on the order
_GROUPS, _CHUNK = 8, 250_000  # scoring: groups of trees, rows that meet one of them in one task
_TREES = "tree int, part int, feature binary, cut binary, below binary, votes binary, importance array<double>"


def attack_score(probability: Column, labels: dict[int, str]) -> Column:
    """1 - P(benign); without a benign class, the highest probability."""
    benign = benign_id(labels)
    return F.lit(1.0) - probability[benign] if benign is not None else F.array_max(probability)


def benign_id(labels: dict[int, str]) -> int | None:
    return next((k for k, v in labels.items() if v.lower() == BENIGN.lower()), None)


def best_class(probability: Column) -> Column:
    """Class id of the highest probability, the lowest id on a tie."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def best_other_class(probability: Column, labels: dict[int, str]) -> Column:
    """As ``best_class``, with benign left out."""
    benign = benign_id(labels)
    if benign is None:
        return best_class(probability)
    masked = F.transform(probability, lambda p, i: F.when(i == benign, F.lit(-1.0)).otherwise(p))
    return best_class(masked)


def _name(class_id: Column, labels: dict[int, str], default: str) -> Column:
    entries: list[Column] = []
    for k, v in labels.items():
        entries += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*entries)[class_id], F.lit(default))


def _thresholds(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Per feature at most 31 thresholds: between all of its values if they are so few, else quantiles in which, as in the weights,
    all classes count alike."""
    valid = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in features}
    sizes = rows.agg(*[F.approx_count_distinct(v).alias(c) for c, v in valid.items()]).first()
    few = [c for c in features if sizes[c] <= 2 * _BINS]
    held = rows.agg(*[F.collect_set(valid[c]).alias(c) for c in few]).first() if few else {}
    values = {c: sorted(held[c]) for c in few if len(held[c]) <= _BINS}
    steps = [k / (8 * _BINS) for k in range(1, 8 * _BINS)]
    many = [F.percentile_approx(valid[c], steps, 4000).alias(c) for c in features if c not in values]
    by_class = rows.groupBy("label_id").agg(*many).collect() if many else []

    def cuts(c: str) -> list[float]:
        if c in values:
            return [(x + y) / 2 for x, y in zip(values[c], values[c][1:])]
        points = sorted(v for r in by_class for v in r[c] or [])
        return sorted({points[len(points) * k // _BINS] for k in range(1, _BINS)})

    return [cuts(c) for c in features]


def _binned(batch: pa.RecordBatch, features: list[str], cuts: list[list[float]]) -> np.ndarray:
    """Number of thresholds below each value; a missing one is above all."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.column_stack([np.searchsorted(np.asarray(t, dtype=np.float64), column(c)).astype(np.uint8) for c, t in zip(features, cuts, strict=True)])


def _times(rng: np.random.Generator, n: int) -> np.ndarray:
    """How often each row is drawn: Poisson of mean 1, looked up by 16 bits, and by all bits where those don't settle it."""
    bits = rng.integers(0, 1 << 16, n, dtype=np.uint16)
    times, unsure = _TIMES[bits], np.flatnonzero(_UNSURE[bits])
    times[unsure] = np.searchsorted(_BELOW, (bits[unsure] + rng.random(len(unsure))) / (1 << 16), side="right")
    return times


class _Packed:
    """Bins of all features in few bytes a row: features of few bins share a byte, those without a threshold take none."""

    def __init__(self, cuts: list[list[float]]):
        self.sizes = [len(t) + 1 for t in cuts]
        filled: list[int] = []  # by byte: the number of its values
        self.place = []  # by feature: byte, divisor, number of bins
        for size in self.sizes:
            at = next((k for k, n in enumerate(filled) if n * size <= 256), len(filled)) if size > 1 else 0
            if at == len(filled):
                filled.append(1)
            self.place.append((at, filled[at] if size > 1 else 1, size))
            filled[at] *= size
        self.width = len(filled)
        self.tables = [(np.arange(256) // d % n).astype(np.uint8) for _, d, n in self.place]

    def pack(self, bins: np.ndarray) -> np.ndarray:
        """Bytes by row from bins by row and feature."""
        packed = np.zeros((self.width, len(bins)), np.uint8)
        for f, (at, divisor, size) in enumerate(self.place):
            if size > 1:
                packed[at] += bins[:, f] * np.uint8(divisor)
        return packed

    def column(self, packed: np.ndarray, feature: int) -> np.ndarray:
        return self.tables[feature].take(packed[self.place[feature][0]])


def _joint(chosen: np.ndarray, sizes: list[int], classes: int) -> list[list[int]]:
    """Places in ``chosen`` in groups that one histogram counts; features of one bin are left out, they can't split."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for j in sorted((j for j, f in enumerate(chosen) if sizes[f] > 1), key=lambda j: -sizes[chosen[j]]):
        size = sizes[chosen[j]]
        at = next((k for k, n in enumerate(cells) if n * size <= _CELLS), len(cells))
        if at == len(cells):
            groups.append([]), cells.append(classes)
        groups[at].append(j)
        cells[at] *= size
    return groups


def _counted(groups: list[list[int]], chosen: np.ndarray, sizes: list[int], column, label: np.ndarray, times: np.ndarray, classes: int) -> list[np.ndarray]:
    """Per group the draws by the bins of its features and by class."""
    out = []
    for group in groups:
        key = column(chosen[group[0]]).astype(np.uint32)
        for j in group[1:]:
            key *= np.uint32(sizes[chosen[j]])
            key += column(chosen[j])
        key *= np.uint32(classes)
        key += label
        out.append(np.bincount(key, times, math.prod([sizes[chosen[j]] for j in group]) * classes))
    return out


def _single(groups: list[list[int]], chosen: np.ndarray, sizes: list[int], counted: list[np.ndarray], classes: int) -> np.ndarray:
    """Draws by place in ``chosen``, bin and class."""
    out = np.zeros((len(chosen), _BINS, classes))
    for group, counts in zip(groups, counted, strict=True):
        cube = counts.reshape([sizes[chosen[j]] for j in group] + [classes])
        for axis, j in enumerate(group):
            out[j, : sizes[chosen[j]]] = cube.sum(axis=tuple(k for k in range(len(group)) if k != axis))
    return out


def _parts(top: dict[str, list], wanted: set[int]) -> Iterator:
    """A function that tells for a function from a feature to its column of bins, and some rows, which of them lie in each wanted node; other nodes are left out early."""
    feature, cut, below = top["feature"], top["cut"], top["below"]
    above = [0] * len(below)
    for node, child in enumerate(below):
        if child != node:
            above[child] = above[child + 1] = node
    kept = {0}
    for node in wanted:
        while node not in kept:
            kept.add(node)
            node = above[node]

    def of(column, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(0, rows)]
        while todo:
            node, here = todo.pop()
            child = below[node]
            if node in wanted:
                yield node, here
            elif child != node:
                high = column(feature[node])[here] > cut[node]
                todo += [(c, here[side]) for c, side in ((child, ~high), (child + 1, high)) if c in kept]

    return of


def _route(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaf of every row. A leaf is its own child, and no bin is above its cut. Rows go down some thousand at a time, which stay in the cache,
    and those at their leaf are left out now and then."""
    out, width = np.empty(len(bins), np.int64), bins.shape[1]
    feature, cut, below = tree["feature"].astype(np.int32), tree["cut"].astype(np.uint8), tree["below"].astype(np.int32)
    inner = below != np.arange(len(below))
    for a in range(0, len(bins), _ROUTED):
        flat = bins[a : a + _ROUTED].ravel()
        start = np.arange(len(flat) // width, dtype=np.int32) * np.int32(width)
        rows, place = np.arange(a, a + len(start)), np.zeros(len(start), np.int32)
        while len(rows):
            for _ in range(3):
                place = below.take(place) + (flat.take(start + feature.take(place)) > cut.take(place))
            todo = inner.take(place)
            out[rows[~todo]] = place[~todo]
            rows, start, place = rows[todo], start[todo], place[todo]
    return out


def _best_splits(counts: np.ndarray, chosen: np.ndarray, histogram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the gain (weight times loss of impurity), feature and bin of the best split. ``histogram``: per place in ``chosen``
    the class weights by class, node and bin; None where no node can be split."""
    squares = lambda x, total: np.square(x).sum(axis=0) / np.maximum(total, 1e-300)
    n = np.arange(len(counts))
    gain, feature, cut = np.zeros(len(counts)), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for j in range(chosen.shape[1]):
        h = histogram(j)
        if h is None:
            continue
        low = h.cumsum(axis=2)
        all_, low = low[:, :, -1:], low[:, :, :-1]
        whole, part = all_.sum(axis=0), low.sum(axis=0)
        split = (part > 0) & (part < whole)
        high = np.maximum(all_ - low, 0)
        value = np.where(split, squares(low, part) + squares(high, high.sum(axis=0)) - squares(all_, whole), 0)
        best = value.argmax(axis=1)
        better = value[n, best] > gain
        gain, feature, cut = np.where(better, value[n, best], gain), np.where(better, chosen[:, j], feature), np.where(better, best, cut)
    return np.where(gain > 1e-9 * counts.sum(axis=1), gain, 0), feature, cut


def _chosen(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """For each node its random subset of features."""
    return rng.random((nodes, features)).argsort(axis=1)[:, : math.ceil(math.sqrt(features))]


def _votes(counts: np.ndarray) -> np.ndarray:
    return np.floor(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300) * _ONE).astype(np.int64)


def _grow(columns: np.ndarray, label: np.ndarray, times: np.ndarray, weights: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree over the rows, and the gain of each feature. Large nodes are split one by one; those of few rows level by level, all at once."""
    width, classes = len(columns), len(weights)
    sizes = [int(c.max()) + 1 if len(c) and c.max() > c.min() else 1 for c in columns]
    label, times = label.astype(np.uint8 if classes <= 256 else np.uint16), times.astype(np.float64)
    importance = np.zeros(width)
    feature, cut, below, counts = [0], [255], [0], [np.bincount(label, times, classes) * weights]
    pending, few = [(0, np.arange(len(label), dtype=np.int32), depth)], []
    while pending:
        node, rows, left = pending.pop()
        if left <= 0 or (counts[node] > 0).sum() <= 1:
            continue
        if len(rows) < _FEW:
            few.append((node, rows, left))
            continue
        chosen = _chosen(rng, 1, width)[0]
        groups = _joint(chosen, sizes, classes)
        # so many rows at a time that what is made of them stays in the cache
        sums = [0] * len(groups)
        for part in (rows[k : k + 65536] for k in range(0, len(rows), 65536)):
            found = _counted(groups, chosen, sizes, lambda f: columns[f].take(part), label.take(part), times.take(part), classes)  # noqa: B023
            sums = [x + y for x, y in zip(sums, found, strict=True)]
        draws = _single(groups, chosen, sizes, sums, classes)
        h = (draws * weights)[:, None]
        gain, best, edge = _best_splits(counts[node][None], chosen[None], lambda j: np.moveaxis(h[j], -1, 0) if sizes[chosen[j]] > 1 else None)  # noqa: B023
        if gain[0] <= 0:
            continue
        f, c, child = int(best[0]), int(edge[0]), len(below)
        split = h[int(np.flatnonzero(chosen == f)[0]), 0]
        importance[f] += gain[0]
        feature[node], cut[node], below[node] = f, c, child
        feature += [0, 0]
        cut += [255, 255]
        below += [child, child + 1]
        counts += [split[: c + 1].sum(axis=0), split[c + 1 :].sum(axis=0)]
        high = columns[f].take(rows) > c
        pending += [(child, rows[~high], left - 1), (child + 1, rows[high], left - 1)]
    arrays = [np.array(feature), np.array(cut), np.array(below), np.array(counts)]
    if few:
        arrays = _grow_few(columns, np.array(sizes), label, times, weights, arrays, few, importance, rng)
    return {"feature": arrays[0].astype(np.int16), "cut": arrays[1].astype(np.uint8), "below": arrays[2].astype(np.int32), "votes": _votes(arrays[3])}, importance


def _grow_few(columns: np.ndarray, bins_of: np.ndarray, label: np.ndarray, times: np.ndarray, weights: np.ndarray, arrays: list[np.ndarray], few: list[tuple], importance: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Grow on the nodes of few rows, one level of all of them at a time. Adds to ``importance``; returns the arrays of the whole tree."""
    classes, by_class, parts = len(weights), weights[:, None, None], [[a] for a in arrays]
    feature, cut, below, _ = arrays
    own, left = np.array([node for node, *_ in few]), np.array([depth for *_, depth in few])
    first, sizes = len(below), np.array([len(rows) for _, rows, _ in few])
    rows = np.concatenate([r for _, r, _ in few])
    # rows lie in the order of their nodes, so each level reads them from front to back
    bins, label, times = np.ascontiguousarray(columns[:, rows].T), label[rows].astype(np.int32), times[rows]
    bins[:, bins_of == 1] = 0  # never split
    while len(rows):
        n, width = len(own), bins.shape[1]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        level = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * np.int32(classes), sizes) + label, times, n * classes).reshape(-1, classes) * weights
        gain, best, edge = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        mixed = np.flatnonzero(((level > 0).sum(axis=1) > 1) & (left > 0))
        flat, step = bins.ravel(), max(1, _FEW_CELLS // (_BINS * classes))
        for some in (mixed[k : k + step] for k in range(0, len(mixed), step)):
            many, chosen = sizes[some], _chosen(rng, len(some), width)
            chosen = np.take_along_axis(chosen, np.argsort(-bins_of[chosen], axis=1, kind="stable"), axis=1)
            most = bins_of[chosen].max(axis=0)  # features of many bins come first, so that the others need small histograms
            at = np.arange(int(many.sum())) + np.repeat(edges[some] - (np.cumsum(many) - many), many)
            place, lab, w, start = np.repeat(np.arange(len(some), dtype=np.int32), many), label[at] * np.int32(len(some)), times[at], at * width

            def histogram(j: int) -> np.ndarray | None:
                if most[j] == 1:  # noqa: B023
                    return None
                values = flat.take(start + np.repeat(chosen[:, j], many))  # noqa: B023
                cells = (lab + place) * np.int32(most[j]) + values  # noqa: B023
                return np.bincount(cells, w, classes * len(some) * most[j]).reshape(classes, len(some), most[j]) * by_class  # noqa: B023

            gain[some], best[some], edge[some] = _best_splits(level[some], chosen, histogram)
        split = gain > 0
        np.add.at(importance, best[split], gain[split])
        child = np.where(split, first + 2 * (np.cumsum(split) - 1), own)
        if own[0] < len(arrays[2]):  # the nodes that are there already
            feature[own], cut[own], below[own] = np.where(split, best, 0), np.where(split, edge, 255), child
        else:
            for kept, new in zip(parts, (np.where(split, best, 0), np.where(split, edge, 255), child, level), strict=True):
                kept.append(new)
        at = np.repeat(np.arange(n), sizes)
        stays = np.flatnonzero(split[at])
        at = at[stays]
        at = child[at] - first + (flat.take(stays * width + best[at]) > edge[at])
        n = 2 * int(split.sum())
        own, left, first, sizes = first + np.arange(n), np.repeat(left[split] - 1, 2), first + n, np.bincount(at, minlength=n)
        rows = stays[np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")]  # of 16 bits: a radix sort
        bins, label, times = bins[rows], label[rows], times[rows]
    return [np.concatenate(kept) for kept in parts]


_KINDS = {"feature": np.int16, "cut": np.uint8, "below": np.int32, "votes": np.int64}


def _arrays(row: dict, classes: int) -> dict[str, np.ndarray]:
    tree = {n: np.frombuffer(row[n], kind) for n, kind in _KINDS.items()}
    return tree | {"votes": tree["votes"].reshape(-1, classes)}


@dataclass
class ForestModel:
    """``trees``: stored table of subtrees, named by tree and leaf of the tree's top. ``tops``: per tree its large nodes."""

    trees: DataFrame
    tops: list[dict[str, list]]
    thresholds: list[list[float]]
    gains: list[float]
    labels: dict[int, str]
    features: list[str]

    def _votes(self, rows: DataFrame, chunks: int) -> DataFrame:
        """_id and the votes of all trees for each class. Blocks of rows meet groups of trees, a task for each pair of a chunk and a group."""
        names, cuts, classes = self.features, self.thresholds, max(self.labels) + 1
        tops = [{n: np.asarray(t[n], np.int64) for n in ("feature", "cut", "below")} for t in self.tops]

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids):
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([zlib.crc32(ids[:1].tobytes()) % chunks], pa.int32()), "ids": [ids.tobytes()], "bins": [_binned(batch, names, cuts).tobytes()]})

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(left.column("ids").to_pylist()), np.int64)
            bins = np.frombuffer(b"".join(left.column("bins").to_pylist()), np.uint8).reshape(-1, len(names))
            votes = np.zeros((len(ids), classes), np.int64)
            parts: dict[int, list] = {}
            for row in right.to_pylist():
                parts.setdefault(row["tree"], []).append(row)
            for number, found in parts.items():
                top = _route(tops[number], bins)
                for row in found:
                    rows, tree = np.flatnonzero(top == row["part"]), _arrays(row, classes)
                    votes[rows] += tree["votes"][_route(tree, bins[rows])]
            return pa.table({"_id": ids, **{f"v{k}": votes[:, k].copy() for k in range(classes)}})

        lanes = min(_GROUPS * chunks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select("_id", *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(blocks, "chunk int, ids binary, bins binary").select("*", numbers(_GROUPS).alias("group"))
        right = self.trees.drop("importance").withColumn("group", F.col("tree") % _GROUPS).select("*", numbers(chunks).alias("chunk"))
        left, right = (x.repartition(lanes, "group", "chunk").groupBy("group", "chunk") for x in (left, right))
        votes = left.cogroup(right).applyInArrow(score, ", ".join(["_id bigint", *[f"v{k} bigint" for k in range(classes)]]))
        return votes.groupBy("_id").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(classes)])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add random_forest_score, attack_label and alternative_label from one probability vector. The rows are stored once."""
        rows = stored_table(df.withColumn("_id", F.monotonically_increasing_id()), "to-classify")
        votes = self._votes(spread(rows), max(1, math.ceil(rows.count() / _CHUNK)))
        share = F.array(*[F.col(f"v{k}") / F.lit(float(_ONE * len(self.tops))) for k in range(max(self.labels) + 1)])
        scored = rows.join(votes, "_id").withColumn(_PROBABILITY, share)
        p = F.col(_PROBABILITY)
        return scored.select(
            *df.columns,
            p,
            attack_score(p, self.labels).alias("random_forest_score"),
            _name(best_class(p), self.labels, UNKNOWN_LABEL).alias("attack_label"),
            _name(best_other_class(p, self.labels), self.labels, UNKNOWN_ALTERNATIVE).alias("alternative_label"),
        )

    def importances(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.features, self.gains, strict=True)), "feature string, importance double")

    def top_features(self, n: int = 5) -> list[tuple[str, float]]:
        """Global importances of the model, the same for every flow."""
        ranked = sorted(range(len(self.gains)), key=lambda i: (-self.gains[i], i))[:n]
        return [(self.features[i], self.gains[i]) for i in ranked]

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        meta = json.dumps({n: getattr(self, n) for n in ("tops", "thresholds", "gains", "labels", "features")})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        labels = {int(k): v for k, v in meta["labels"].items()}
        return cls(spark.read.schema(_TREES).parquet(f"{path}/trees"), meta["tops"], meta["thresholds"], meta["gains"], labels, meta["features"])


@dataclass(frozen=True)
class AttackForest:
    settings: Settings = DEFAULTS
    features: tuple[str, ...] = tuple(FEATURE_NAMES)

    def fit(self, training: DataFrame, label: str = "Attack", labels: dict[int, str] | None = None) -> ForestModel:
        """Fit on all classes with balanced weights."""
        s, names = self.settings, list(self.features)
        labels = labels or label_ids(training, label)
        found, classes = {r[label]: r["weight"] for r in class_weights(training, label).collect()}, max(labels) + 1
        weights = np.array([float(found.get(labels.get(k), 0.0)) for k in range(classes)])
        rows = with_label_id(training, label, labels).select(*[F.col(c).cast("double").alias(c) for c in names], F.col("label_id").cast("int"))
        rows = stored_table(rows, "classified")
        if not rows.filter(F.col("label_id").isNull()).isEmpty():
            raise ValueError(f"{label} is missing in some rows, or not among the given labels")
        cuts = _thresholds(rows, names)
        packed = _Packed(cuts)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    known = batch.column("label_id").to_numpy(zero_copy_only=False).astype(np.int16)
                    yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bins": [packed.pack(_binned(batch, names, cuts)).tobytes()], "labels": [known.tobytes()]})

        data = stored_table(spread(rows).mapInArrow(blocks, "rows bigint, bins binary, labels binary"), "binned")
        total = data.agg(F.sum("rows")).first()[0] or 0
        if total == 0:
            raise ValueError("no labelled rows to fit on")
        grower = _Grower(s, packed, weights, classes, [{"feature": [0], "cut": [255], "below": [0]} for _ in range(s.rf_trees)], [[0] for _ in range(s.rf_trees)], np.zeros((s.rf_trees, len(names))), {})
        grower.split_large(data, total)
        per_wave = max(1, int(_WAVE_BYTES / (total * _SHARE * (packed.width + 3))))
        path = None
        for wave in (range(k, min(k + per_wave, s.rf_trees)) for k in range(0, s.rf_trees, per_wave)):
            path = grower.grow_wave(data, wave, path)
        grower.write_leaves(training.sparkSession, path)
        trees = training.sparkSession.read.schema(_TREES).parquet(path)
        gains = grower.gains + 0
        for r in trees.select("tree", "importance").toLocalIterator():
            gains[r["tree"]] += r["importance"]
        gains /= np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
        mean = gains.mean(axis=0)
        mean = mean / mean.sum() if mean.sum() > 0 else mean
        return ForestModel(trees, grower.tops, cuts, mean.tolist(), labels, names)


@dataclass
class _Grower:
    """Growing over the binned blocks. Per tree its top (large nodes, split one level at a time), the depths of the top's nodes, and its
    gains; of the top's nodes that are leaves of the whole tree the class weights."""

    settings: Settings
    packed: _Packed
    weights: np.ndarray
    classes: int
    tops: list[dict[str, list]]
    depths: list[list[int]]
    gains: np.ndarray
    leaves: dict[tuple[int, int], np.ndarray]

    def _drawn(self, wanted: dict[int, set[int]]):
        """A function from a block to its drawn rows in the wanted nodes of each tree: tree, node, packed bins, a function from a feature to its column,
        labels, rows, how often. The draw depends on the block's content."""
        packed, seed, many = self.packed, self.settings.seed, len(self.tops) > 1
        parts = {t: _parts(self.tops[t], nodes) for t, nodes in wanted.items()}

        def blocks(batch: pa.RecordBatch):
            for bins, known in zip(batch.column("bins").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                content = zlib.crc32(known, zlib.crc32(bins))
                y = np.frombuffer(known, np.uint16)
                x = np.frombuffer(bins, np.uint8).reshape(packed.width, len(y))
                held: dict[int, np.ndarray] = {}

                def column(feature: int, x=x, held=held) -> np.ndarray:
                    if feature not in held:
                        held[feature] = packed.column(x, feature)
                    return held[feature]

                for t, of in parts.items():
                    times = _times(np.random.default_rng([seed, t, content]), len(y)) if many else np.ones(len(y), np.uint8)
                    for node, rows in of(column, np.flatnonzero(times)):
                        yield t, node, x, column, y, rows, times[rows]

        return blocks

    def split_large(self, data: DataFrame, total: int) -> None:
        """Split nodes of more than ``_ROWS`` drawn rows, one level of all trees in each pass."""
        large = {(t, 0) for t in range(len(self.tops))} if total * _SHARE > _ROWS else set()
        while large:
            by_tree: dict[int, set[int]] = {}
            for t, node in sorted(large):
                by_tree.setdefault(t, set()).add(node)
            chosen = {(t, node): _chosen(np.random.default_rng([self.settings.seed, 1, t, node]), 1, len(self.packed.sizes))[0] for t, node in large}
            drawn, weights, classes, sizes = self._drawn(by_tree), self.weights, self.classes, self.packed.sizes
            groups = {key: _joint(some, sizes, classes) for key, some in chosen.items()}

            def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums: dict[tuple[int, int], list[np.ndarray]] = {}
                for batch in batches:
                    for t, node, _, column, y, rows, times in drawn(batch):  # noqa: B023
                        key = (t, node)
                        part = _counted(groups[key], chosen[key], sizes, lambda f: column(f).take(rows), y.take(rows), times.astype(np.float64), classes)  # noqa: B023
                        if key in sums:
                            for total, new in zip(sums[key], part, strict=True):
                                total += new
                        else:
                            sums[key] = part
                for (t, node), part in sums.items():
                    whole = _single(groups[t, node], chosen[t, node], sizes, part, classes)  # noqa: B023
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "sums": [whole.tobytes()]})

            def best(key, rows: pd.DataFrame) -> pd.DataFrame:
                t, node = (int(v) for v in key)
                # draws are whole numbers, so their sums don't depend on the order
                draws = np.sum([np.frombuffer(v, np.float64) for v in rows["sums"]], axis=0).reshape(-1, 1, _BINS, classes)
                h = draws * weights
                gain, feature, cut = _best_splits(h[0].sum(axis=1), chosen[t, node][None, :], lambda j: np.moveaxis(h[j], -1, 0))  # noqa: B023
                split = draws[int(np.flatnonzero(chosen[t, node] == feature[0])[0]) if gain[0] > 0 else 0, 0]  # noqa: B023
                low, high = split[: int(cut[0]) + 1].sum(axis=0), split[int(cut[0]) + 1 :].sum(axis=0)
                return pd.DataFrame([(t, node, float(gain[0]), int(feature[0]), int(cut[0]), low.tolist(), high.tolist())], columns=["tree", "node", "gain", "feature", "cut", "low", "high"])

            sums = data.mapInArrow(histograms, "tree int, node int, sums binary")
            splits = sums.groupBy("tree", "node").applyInPandas(best, "tree int, node int, gain double, feature int, cut int, low array<double>, high array<double>").collect()
            large = set()
            for r in sorted(splits):
                t, node, top = r["tree"], r["node"], self.tops[r["tree"]]
                if r["gain"] <= 0:
                    continue
                child, depth = len(top["below"]), self.depths[t][node] + 1
                top["feature"][node], top["cut"][node], top["below"][node] = r["feature"], r["cut"], child
                top["feature"] += [0, 0]
                top["cut"] += [255, 255]
                top["below"] += [child, child + 1]
                self.depths[t] += [depth, depth]
                self.gains[t, r["feature"]] += r["gain"]
                for part, draws in ((child, np.array(r["low"])), (child + 1, np.array(r["high"]))):
                    if draws.sum() * _SHARE > _ROWS:
                        if depth < self.settings.rf_depth and (draws * weights > 0).sum() > 1:
                            large.add((t, part))
                        else:
                            self.leaves[t, part] = draws * weights

    def write_leaves(self, spark: SparkSession, path: str) -> None:
        """Add the large nodes that are leaves already, a few a tree, to the table at ``path``."""
        one = {"feature": [0], "cut": [255], "below": [0]}
        plain = [bytearray(np.array(v, _KINDS[n]).tobytes()) for n, v in one.items()]
        rows = [(t, part, *plain, bytearray(_votes(counts[None, :]).tobytes()), [0.0] * len(self.packed.sizes)) for (t, part), counts in sorted(self.leaves.items(), key=lambda r: r[0])]
        if rows:
            spark.createDataFrame(rows, _TREES).coalesce(1).write.mode("append").parquet(path)

    def grow_wave(self, data: DataFrame, wave: range, path: str | None) -> str:
        """Send the rows of each subtree to one task, which grows it; add the subtrees to the table at ``path``."""
        ends = {t: {node for node, child in enumerate(self.tops[t]["below"]) if node == child and (t, node) not in self.leaves} for t in wave}
        drawn, weights, packed, settings, depths = self._drawn(ends), self.weights, self.packed, self.settings, self.depths
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            size = 0

            def sent() -> pa.RecordBatch:
                joined = [(t, node, *(b"".join(v) for v in zip(*found, strict=True))) for (t, node), found in held.items()]
                columns = zip(*joined, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["tree", "part", "bins", "labels", "times"])

            for batch in batches:
                for t, node, x, _, y, rows, times in drawn(batch):
                    if len(rows):
                        # rows of bytes, so that blocks can be joined end to end
                        found = np.ascontiguousarray(x[:, rows].T).tobytes(), y[rows].tobytes(), times.tobytes()
                        held.setdefault((t, node), []).append(found)
                        size += sum(map(len, found))
                    if size > _BUFFER_BYTES:
                        yield sent()
                        held.clear()
                        size = 0
            if held:
                yield sent()

        def grow(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            t, part = (k.as_py() for k in key)
            # draws are whole numbers, so the order of the rows doesn't matter
            x, y, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("bins", np.uint8), ("labels", np.uint16), ("times", np.uint8)))
            x = np.ascontiguousarray(x.reshape(len(y), -1).T)
            columns = np.stack([packed.column(x, f) for f in range(len(packed.sizes))])
            tree, gain = _grow(columns, y, times, weights, settings.rf_depth - depths[t][part], np.random.default_rng([settings.seed, 2, t, part]))
            named = {"tree": pa.array([t], pa.int32()), "part": pa.array([part], pa.int32()), **{n: [tree[n].tobytes()] for n in _KINDS}}
            return pa.table(named | {"importance": pa.array([gain.tolist()], pa.list_(pa.float64()))})

        spark = data.sparkSession
        lanes = min(max(1, sum(map(len, ends.values()))), 4 * spark.sparkContext.defaultParallelism)
        dealt = data.mapInArrow(deal, "tree int, part int, bins binary, labels binary, times binary").repartition(lanes, "tree", "part")
        path = path or scratch_path(spark, "trees")
        dealt.groupBy("tree", "part").applyInArrow(grow, _TREES).write.mode("append").parquet(path)
        return path
