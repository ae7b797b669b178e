"""Detectors: bounds, repeatability, an outlier that stands out, save and load."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.config import Settings
from tidewatch.detectors.ensemble import DetectorSet, fit_detectors
from tidewatch.detectors.ewma import EwmaState
from tidewatch.detectors.isolation import IsolationForest, average_path
from tidewatch.detectors.sequence import SequenceDetector
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.filters import benign_only
from tidewatch.operators.risk import SCORE_COLUMNS
from tidewatch.operators.sampling import unit_hash
from tidewatch.sources.storage import materialise

QUICK = Settings(rf_trees=8, rf_depth=6, iso_trees=25)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return materialise(inputs.netflow(spark, sf))


@pytest.fixture(scope="module")
def detectors(rows):
    return fit_detectors(rows, QUICK, order=("ts", "uid"))


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert np.isclose(average_path(256), 10.2447, atol=1e-3)


def test_scores_and_reload(spark, rows, detectors, tmp_path):
    detectors.save(spark, str(tmp_path / "m"))
    loaded = DetectorSet.load(spark, str(tmp_path / "m"), QUICK)
    assert loaded.baseline.n == benign_only(rows).count() and loaded.top_features(3) == detectors.top_features(3)
    columns = [*SCORE_COLUMNS.values(), "attack_label", "alternative_label"]
    a, b = ({r.uid: tuple(r)[1:] for r in d.transform(rows).select("uid", *columns).collect()} for d in (detectors, loaded))
    assert a == b and len(a) == rows.count()
    assert all(0 <= s <= 1 for r in a.values() for s in r[:4])


def test_missing_models_stay_untrained(spark, tmp_path):
    empty = DetectorSet.load(spark, str(tmp_path / "nothing"))
    assert empty.isolation is None and empty.forest is None and empty.sequence is None and empty.baseline == EwmaState()


def test_isolation_is_repeatable_and_finds_an_outlier(rows):
    benign = benign_only(rows)
    one, two = (IsolationForest(QUICK).fit(benign) for _ in range(2))
    assert one.offset == two.offset
    odd = rows.limit(1).select("uid", *[F.lit(1e9).alias(c) for c in FEATURE_NAMES])
    median = one.transform(benign).agg(F.percentile("isolation_forest_score", 0.5)).first()[0]
    assert one.transform(odd).first()["isolation_forest_score"] > median + 0.1


def test_training_uses_every_training_row(rows, monkeypatch):
    """The classifier is fitted on all rows that are not held out, however many there are: no setting makes it a sample."""
    from tidewatch.detectors import ensemble
    from tidewatch.plans.train import train

    seen, fit = [], ensemble.AttackForest.fit
    monkeypatch.setattr(ensemble.AttackForest, "fit", lambda self, training, *a, **k: seen.append(training.count()) or fit(self, training, *a, **k))
    cut = {"classifier_rows": 50} if hasattr(QUICK, "classifier_rows") else {}
    done = train(rows, replace(QUICK, rf_trees=2, rf_depth=2, **cut), order=None, with_sequence=False, key=("uid",))
    held_out = done.test.count()
    assert seen == [done.train.count()] and seen[0] + held_out == rows.count() and held_out > 0
    assert "_u" not in done.train.columns + done.test.columns


def test_attack_rows_score_higher(rows, detectors):
    scored = detectors.forest.transform(rows).groupBy("Label").agg(F.avg("random_forest_score").alias("s"))
    by = {r.Label: r.s for r in scored.collect()}
    assert by[1] > by[0] + 0.3


@pytest.mark.parametrize("large", [100, 10**6])
def test_forest_of_large_and_small_nodes(spark, rows, monkeypatch, large):
    """Nodes split over all tasks or in one: no tree is deeper than allowed, votes are those of a walk by plain comparisons, missing
    values included, trees are a table, and a second fit gives the same forest."""
    from tidewatch.detectors import forest

    monkeypatch.setattr(forest, "_ROWS", large)
    monkeypatch.setattr(forest, "_WAVE_BYTES", 100_000)
    settings = Settings(rf_trees=3, rf_depth=7)
    model, again = (forest.AttackForest(settings).fit(rows) for _ in range(2))
    trees = {(r["tree"], r["part"]): forest._arrays(r, len(model.labels)) for r in model.trees.collect()}
    assert (model.tops, model.gains, model.thresholds) == (again.tops, again.gains, again.thresholds)
    assert {k: v["votes"].tobytes() for k, v in trees.items()} == {(r["tree"], r["part"]): bytes(r["votes"]) for r in again.trees.collect()}
    assert sum(model.gains) == pytest.approx(1) and all(len(t["below"]) > 1 for t in model.tops) == (large == 100)

    def walk(t, values):
        depth, node, part = 0, 0, model.tops[t]
        for inside in (False, True):
            while part["below"][node] != node:
                f, cut = part["feature"][node], part["cut"][node]
                above = values[f] is None or np.isnan(values[f]) or cut >= len(model.thresholds[f]) or values[f] > model.thresholds[f][cut]
                depth, node = depth + 1, part["below"][node] + int(above)
            if not inside:
                part, node = trees[t, int(node)], 0
        assert depth <= settings.rf_depth
        return part["votes"][node] / 2.0**40

    odd = rows.limit(40).withColumn("IN_BYTES", F.lit(None).cast("double")).unionByName(rows.limit(60).withColumn("OUT_BYTES", F.lit(float("nan")).cast("double")))
    scored = model.transform(odd).collect()
    assert len(scored) == 100
    for r in scored:
        expected = sum(walk(t, [None if r[f] is None else float(r[f]) for f in FEATURE_NAMES]) for t in range(3)) / 3
        assert r["class_probability"] == pytest.approx(expected.tolist(), abs=1e-9)
    right = model.transform(rows).filter(F.col("attack_label") == F.col("Attack")).count()
    assert right > 0.9 * rows.count()


def test_large_pure_nodes_are_not_gathered(spark, monkeypatch):
    """A large node with one class only is a leaf: none of its rows goes to a task that grows subtrees. Its children's sizes come with the split:
    one pass over the data for each level of large nodes."""
    from tidewatch.detectors import forest

    monkeypatch.setattr(forest, "_ROWS", 100)
    passes, grown, drawn = [], [], forest._Grower._drawn
    monkeypatch.setattr(forest._Grower, "_drawn", lambda self, wanted: passes.append(wanted) or drawn(self, wanted))
    monkeypatch.setattr(forest._Grower, "write_leaves", lambda self, *a, own=forest._Grower.write_leaves: grown.append(self) or own(self, *a))
    rows = spark.range(0, 4000, 1, 2).select((F.col("id") % 4).cast("double").alias("kind"), F.when(F.col("id") % 4 == 0, "Bot").otherwise("Benign").alias("Attack"))
    model = forest.AttackForest(Settings(rf_trees=3, rf_depth=5), ("kind",)).fit(rows)
    assert len(passes) == 2 and passes[1] == {0: set(), 1: set(), 2: set()}  # the roots, and a wave in which nothing is left
    assert sorted(grown[0].leaves) == [(t, node) for t in range(3) for node in (1, 2)]
    got = model.transform(rows).groupBy("Attack", "attack_label", "random_forest_score").count().collect()
    assert sorted(map(tuple, got)) == [("Benign", "Benign", 0.0, 3000), ("Bot", "Bot", 1.0, 1000)]


def test_drawn_times_are_poisson():
    from tidewatch.detectors import forest

    times = forest._times(np.random.default_rng(3), 4_000_000)
    for k, share in enumerate([0.36787944, 0.36787944, 0.18393972, 0.06131324, 0.01532831, 0.00306566, 0.00051094]):
        assert abs((times == k).mean() - share) < 6 * (share / len(times)) ** 0.5
    assert times.max() > 8 and times.mean() == pytest.approx(1, abs=0.003)



def test_own_reconstruction(rows, detectors):
    """A caller's function replaces the linear one; a perfect one leaves no error."""
    from tidewatch.operators.ordered import ordered_blocks

    perfect = replace(detectors.sequence, rebuild=lambda w: w)
    got = [r["sequence_score"] for r in perfect.transform(ordered_blocks(rows)).orderBy("ts", "uid").collect()]
    assert got[:9] == [0.5] * 9 and set(got[9:]) == {0.0}


def test_components_from_lagged_products_equal_those_of_all_windows(spark):
    """Blocks of several batches, one too short for a window, values missing and at the edges of blocks."""
    draw, n, width = np.random.default_rng(5), 1043, 100
    x = np.cumsum(draw.normal(size=(n, 3)), axis=0) * [1, 20, 0.01]
    x[draw.random(n) < 0.01, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ts int, a double, b double, c double").repartition(7)
    detector = SequenceDetector(features=("a", "b", "c"), components=4, block=width)
    model = detector.fit(df, ("ts",))
    z = np.nan_to_num((x - model.mean) / model.std)
    held = {r[0] for r in spark.range(n // width + 1).filter(unit_hash(F.col("id"), detector.settings.seed) < detector.settings.sequence_validation_fraction).collect()}
    of = lambda wanted: np.array([z[i : i + 10].ravel() for b in range(n // width + 1) if (b in held) == wanted for i in range(b * width, min((b + 1) * width, n) - 9)])
    values, vectors = np.linalg.eigh(np.cov(of(False).T))
    expected, found = vectors[:, ::-1][:, :4], np.array(model.components)
    assert held and np.allclose(np.abs((expected * found).sum(axis=0)), 1, atol=1e-6)
    w = of(True)
    errors = ((w - w @ found @ found.T) ** 2).mean(axis=1)
    assert model.threshold == pytest.approx(np.percentile(errors, 95), rel=1e-9)


def test_features_are_computed_on_all_cores(spark, tmp_path):
    """Events in one partition are dealt out before the features, which cost the time, are computed; no row is lost."""
    events = spark.range(0, 500, 1, 1).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "id % 7 as user_id", "'view' as event_type", "id / 10.0D as value",
        "concat('{\"k\": ', id % 50, '}') as props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = inputs.netflow(spark, str(tmp_path))
    sizes = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 500 and sum(n > 0 for n in sizes) == spark.sparkContext.defaultParallelism > 1


def test_packed_bins_and_joint_histograms():
    """Bins come back from few bytes a row, and one histogram of several features gives the counts of each of them."""
    from tidewatch.detectors import forest

    draw, sizes, classes = np.random.default_rng(8), [1, 32, 2, 5, 1, 32, 16, 3, 2, 9], 5
    packed = forest._Packed([list(range(n - 1)) for n in sizes])
    bins = np.column_stack([draw.integers(0, n, 3000) for n in sizes]).astype(np.uint8)
    bytes_ = packed.pack(bins)
    assert packed.width == len(bytes_) <= 4 and all((packed.column(bytes_, f) == bins[:, f]).all() for f in range(len(sizes)))
    assert forest._Packed([[], []]).pack(bins[:, :2] * 0).shape == (1, 3000)
    label, times, chosen = draw.integers(0, classes, 3000).astype(np.uint16), draw.integers(1, 4, 3000).astype(float), np.array([1, 0, 3, 5, 2, 6])
    groups = forest._joint(chosen, sizes, classes)
    assert sorted(j for g in groups for j in g) == [0, 2, 3, 4, 5] and len(groups) < 5
    found = forest._single(groups, chosen, sizes, forest._counted(groups, chosen, sizes, lambda f: bins[:, f], label, times, classes), classes)
    for j, f in enumerate(chosen):
        plain = np.zeros((32, classes))
        np.add.at(plain, (bins[:, f], label), times * (sizes[f] > 1))
        assert (found[j] == plain).all()


@pytest.mark.parametrize("features", [1, 7])
def test_nodes_one_by_one_and_many_at_a_time(monkeypatch, features):
    """Subtrees grown one node at a time, level by level, or first so and then so: leaves hold the class weights of their rows; with one feature, which leaves
    nothing to chance, all predict alike. A column of one high bin is no matter."""
    from tidewatch.detectors import forest

    draw, n, weights = np.random.default_rng(9), 6000, np.array([0.5, 2.0, 7.0])
    bins = np.column_stack([draw.integers(0, 32, n), np.full(n, 31), *[draw.integers(0, k, n) for k in (2, 3, 5, 9, 16)]])[:, :features].astype(np.uint8)
    label, times, seen = ((bins[:, 0] // 3 + (draw.random(n) < 0.2)) % 3).astype(np.uint16), draw.integers(1, 4, n).astype(np.uint8), []
    for few in (1, 500, 10**6):
        monkeypatch.setattr(forest, "_FEW", few)
        tree, gain = forest._grow(np.ascontiguousarray(bins.T), label, times, weights, 9, np.random.default_rng(1))
        leaf = forest._route({k: v.astype(np.int64) for k, v in tree.items()}, bins)
        held = np.zeros((len(tree["below"]), 3))
        np.add.at(held, (leaf, label), times * weights[label])
        ends = np.flatnonzero(tree["below"] == np.arange(len(tree["below"])))
        assert set(leaf) == set(ends) and np.allclose(tree["votes"][ends] / 2**40, held[ends] / held[ends].sum(axis=1, keepdims=True), atol=1e-9)
        assert gain[0] > 0 and (features == 1 or gain[1] == 0)
        seen.append(tree["votes"][leaf])
    assert features > 1 or all((v == seen[0]).all() for v in seen)


def test_rows_go_down_a_tree_some_at_a_time(monkeypatch):
    """Rows of several parts, trees deeper than the steps between which rows at their leaf are left out, a tree of one leaf, no rows."""
    from tidewatch.detectors import forest

    draw = np.random.default_rng(12)
    bins, label = draw.integers(0, 32, (1000, 4)).astype(np.uint8), draw.integers(0, 2, 1000).astype(np.uint16)
    tree, _ = forest._grow(np.ascontiguousarray(bins.T), label, np.ones(1000, np.uint8), np.ones(2), 8, np.random.default_rng(1))
    monkeypatch.setattr(forest, "_ROUTED", 300)

    def walk(row):
        node = 0
        while tree["below"][node] != node:
            node = tree["below"][node] + int(row[tree["feature"][node]] > tree["cut"][node])
        return node

    assert forest._route(tree, bins).tolist() == [walk(r) for r in bins]
    one = {"feature": np.array([0]), "cut": np.array([255]), "below": np.array([0])}
    assert forest._route(one, bins[:7]).tolist() == [0] * 7 and len(forest._route(tree, bins[:0])) == 0
