"""Exact near-duplicate join of embeddings by cosine, block against block.

On the unit sphere, cosine >= t means a distance of at most r = sqrt(2 - 2t). Vectors belong to the cell of their nearest
pivot. A vector within r of one in another cell lies within r of the plane between the two pivots (the
triangle inequality, sharpened to planes: (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= r). Vectors are put in the order of length, label and cell
and stored once, as blocks that know their labels, their cells and the cells whose planes any of their vectors is that near. Two blocks are
compared if their labels meet and each reaches a cell of the other; other pairs can't hold a link.

Vectors are compared only under equal labels. Equal vectors of a label are one with a number of copies, so a group of copies costs one row.
Pairs of blocks are formed where the stored blocks are read (a Cartesian product of their partitions), so no vector is written or sent once for
every block or cell it meets: the disk taken is a fixed multiple of the input, whatever the number of cells and blocks. The time still grows with the square
of the vectors that pivots can't tell apart. A pair is a matrix product in single precision; what comes near the threshold is decided in double
precision. Links are counted, not written; a spanning forest of them goes on to the components.

Pivots are vectors drawn by hash, as many as there are cells of ``cell_vectors`` to fill, at most ``most_pivots``: they
steer only how the work is dealt, never what is compared. The input is read more than once.

Defined results: a vector that is null, zero, or holds a null or a non-finite component links with nothing and stands
alone, as does one without a label. Vectors of different length never link. Rows that repeat an id, or have none, are vectors of
their own: links are counted by vector, not by id, and a component is named by the smallest id in it (null where it has
none). kept compares ids so that two nulls are equal. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, forest, stored_table
from tidewatch.sources.storage import scratch_path

BLOCK_VECTORS = 1024
_BLOCK_NUMBERS = 1 << 19  # of a block of long vectors
_GROUP_BYTES = 16 << 20  # of stored blocks that are read at once


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1: by the largest component first, so that no square is lost to overflow or underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _mixed(z: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, well mixed."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the length of its vector and two hashes of its label and unit vector, by which a group of copies is known; null without a vector."""
    salts = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest())) for k in range(2)]
    for batch in batches:
        column = batch.column("numbers")
        size = np.where(column.is_null(), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        hashes, known = np.zeros((2, len(column)), np.uint64), {}
        for n in np.unique(size[size > 0]):
            where = np.flatnonzero(size == n)
            for at in (where[k : k + step] for step in [max(1, (1 << 20) // int(n))] for k in range(0, len(where), step)):
                bits = (_units(_matrix(column.take(pa.array(at)))) + 0.0).view(np.uint64)  # no two kinds of zero
                for label in (labels := batch.column("label").take(pa.array(at)).dictionary_encode()).dictionary.to_pylist():
                    if label not in known:
                        known[label] = np.frombuffer(hashlib.blake2b(label.encode(), digest_size=16).digest(), np.uint64)
                of = np.stack([known[v] for v in labels.dictionary.to_pylist()])[labels.indices.to_numpy()]
                for k, salt in enumerate(salts):
                    places = _mixed(salt + np.arange(int(n), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    hashes[k, at] = _mixed(_mixed(bits ^ places).sum(axis=1, dtype=np.uint64) + of[:, k])
        none = size == 0
        values = {name: batch.column(name) for name in batch.schema.names} | {"size": pa.array(size.astype(np.int32))}
        values |= {f"h{k + 1}": pa.array(h.view(np.int64), mask=none) for k, h in enumerate(hashes)}
        yield pa.RecordBatch.from_pydict(values)


def _homes(pivots: dict[int, np.ndarray]):
    """Each vector with its cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for a in range(0, own.num_rows, 4096):
                    part = own.slice(a, 4096)
                    p = pivots.get(int(size))
                    cell = np.zeros(part.num_rows, np.int32) if p is None else (_units(_matrix(part.column("numbers"))) @ p.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], names=[*part.schema.names, "cell"])

    return place


def _blocks(pivots: dict[int, np.ndarray], radius: float, most: int):
    """Runs of sorted vectors of one length as blocks: labels and how often each comes, cells, cells within reach, vectors."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        size, numbers = rows.column("size")[0].as_py(), _matrix(rows.column("numbers"))
        labels, home = rows.column("label").combine_chunks().dictionary_encode(), rows.column("cell").to_numpy()
        labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
        reach, p = np.zeros(1, np.int32), pivots.get(size)
        if p is not None:
            gaps = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
            apart = 2 - 2 * (_units(numbers) @ p.T)  # squared distances
            near = apart - apart[np.arange(len(home)), home][:, None] <= 2 * radius * gaps[home] + 1e-9
            near[np.arange(len(home)), home] = True
            reach = np.flatnonzero(near.any(axis=0))
        vec = rows.column("vec").to_numpy()
        known = labels.dictionary.to_pylist()  # in order, as the rows are
        values = {
            "block": int(vec[0]), "size": size, "low": known[0], "high": known[-1], "labels": known, "times": np.bincount(labels.indices.to_numpy(), minlength=len(known)).tolist(),
            "cells": np.unique(home).tolist(), "reach": reach.tolist(), "vecs": vec.tobytes(), "copies": rows.column("copies").to_numpy().tobytes(), "numbers": numbers.tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values.values(), _KINDS, strict=True)], names=list(values))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held is not None:
                sizes = held.column("size").to_numpy()
                full = max(1, min(most, _BLOCK_NUMBERS // int(sizes[0])))
                same = int((sizes == sizes[0]).argmin()) or len(sizes)
                if same == len(sizes) < full:
                    break
                end = min(full, same)
                yield made(held.slice(0, end))
                held = held.slice(end) if end < len(sizes) else None
        if held is not None:
            yield made(held)

    return form


_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
_BLOCK = "block long, size int, low string, high string, labels array<string>, times array<int>, cells array<int>, reach array<int>, vecs binary, copies binary, numbers binary"
_SENT = ["block", "size", "labels", "times", "vecs", "copies", "numbers"]


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b that may have links, and between them which do, in double precision."""
    margin = 1e-5 + 1e-6 * a.shape[1]  # far above the error of a product in single precision
    rough = a.astype(np.float32) @ b.astype(np.float32).T >= threshold - margin
    rows, others = np.flatnonzero(rough.any(axis=1)), np.flatnonzero(rough.any(axis=0))
    return rows, others, a[rows] @ b[others].T >= threshold


def _linked(threshold: float, kind: str):
    """Per pair of blocks the links of the vectors of both, and edges of a spanning forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            found: list[np.ndarray] = []
            for k in range(batch.num_rows):

                def block(side: str) -> tuple:
                    at = lambda c: batch.column(f"{side}_{c}")[k]  # noqa: B023, E731
                    vec, copies = (np.frombuffer(at(c).as_buffer(), np.int64) for c in ("vecs", "copies"))
                    edges = np.concatenate([[0], np.cumsum(at("times").as_py())])
                    parts = {label: slice(a, b) for label, a, b in zip(at("labels").as_py(), edges[:-1], edges[1:], strict=True)}
                    return at("block").as_py(), vec, copies, parts, _units(np.frombuffer(at("numbers").as_buffer(), kind).reshape(len(vec), -1))

                number = batch.column("a_block")[k].as_py()
                if last is None or last[0] != number:
                    last = block("a")
                left, right = last, last if batch.column("b_block")[k].as_py() == number else block("b")
                for label in left[3].keys() & right[3].keys():
                    (vec, copies, unit), (other, more, units) = ((s[1][s[3][label]], s[2][s[3][label]], s[4][s[3][label]]) for s in (left, right))
                    rows, others, near = _near(unit, units, threshold)
                    if left is right:
                        near &= rows[:, None] != others[None, :]
                    if not near.any():
                        continue
                    names = np.unique(np.concatenate([vec[rows], other[others]]))
                    u, v = np.nonzero(near)
                    place, at = np.searchsorted(names, vec[rows]), np.searchsorted(names, other[others])
                    root = names[forest(len(names), place[u], at[v])]
                    sides = [(vec[rows], root[place], near @ more[others])]
                    if left is not right:
                        sides.append((other[others], root[at], near.T @ copies[rows]))
                    for ends, roots, links in sides:
                        found.append(np.stack([ends, roots, links])[:, links > 0])
            if found:
                x = np.concatenate(found, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "links"])

    return compare


def cosine_links(vectors: DataFrame, threshold: float = 0.93, cell_vectors: int = 2048, most_pivots: int = 256) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    radius, spark = (2 - 2 * threshold) ** 0.5, vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    numbers = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(numbers).alias("numbers"))
    largest = F.array_max(F.transform("numbers", lambda v: F.abs(v)))
    sound = F.col("label").isNotNull() & (F.size("numbers") > 0) & ~F.exists("numbers", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & (largest > 0)
    sound = F.coalesce(sound, F.lit(False))
    held = f"vec_id long, label string, numbers {numbers}, size int, h1 long, h2 long"
    known = stored_table(rows.withColumn("numbers", F.when(sound, F.col("numbers"))).mapInArrow(_keyed, held).drop("numbers"), "keys")
    usable = rows.filter(sound).mapInArrow(_keyed, held).drop("vec_id")
    groups = known.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.first("size").alias("size"))
    # a row per group goes on; groups have numbers of their own: ids may repeat or be missing
    groups = stored_table(groups.withColumn("vec", F.monotonically_increasing_id()), "groups")
    labels = {r[0]: r[1] for r in known.filter("h1 is not null").groupBy("size").agg(F.countDistinct("label")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for size, n in groups.groupBy("size").count().collect():
        wanted = min(most_pivots, ceil(n / labels[size] / cell_vectors))
        if wanted > 1:
            drawn = groups.filter(F.col("size") == size).orderBy(F.xxhash64("vec", F.lit(3)), "vec").limit(wanted).select("h1", "h2")
            drawn = usable.join(F.broadcast(drawn), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).orderBy("h1", "h2").select("numbers").collect()
            pivots[size] = _units(np.array([r["numbers"] for r in drawn]))
    # of a group of copies every task sends one row at most
    reps = usable.dropDuplicates(["h1", "h2"]).join(groups.select("h1", "h2", "vec", "copies"), ["h1", "h2"]).select("label", "size", "vec", "copies", "numbers")
    placed = reps.mapInArrow(_homes(pivots), f"label string, size int, vec long, copies long, numbers {numbers}, cell int")
    order = ["size", "label", "cell", "vec"]
    path = scratch_path(spark, "blocks")
    made = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(pivots, radius, BLOCK_VECTORS), _BLOCK)
    made.write.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    a, b = (spark.read.schema(_BLOCK).parquet(path).select(*[F.col(f.name).alias(f"{side}_{f.name}") for f in made.schema.fields]) for side in ("a", "b"))
    # no equality, by which Spark would send the blocks to one task a label
    meet = (F.col("a_block") <= F.col("b_block")) & (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") >= F.col("b_size"))
    meet &= (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    meet &= F.arrays_overlap("a_cells", "b_reach") & F.arrays_overlap("b_cells", "a_reach")
    pairs = a.join(b, meet).select(*[f"{side}_{c}" for side in ("a", "b") for c in _SENT])
    links = stored_table(pairs.mapInArrow(_linked(threshold, "<f4" if single else "<f8"), "a long, b long, links long"), "linked")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    placed_in = groups.join(counts, groups["vec"] == counts["a"], "left").join(components(links.select("a", "b")), F.col("vec") == F.col("id"), "left")
    placed_in = placed_in.select("h1", "h2", "lowest", F.coalesce("component", "vec").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed_in = stored_table(placed_in, "found")
    named = placed_in.groupBy("component").agg(F.min("lowest").alias("component_id"))
    found = placed_in.join(named, "component").select("h1", "h2", "component_id", "n_links")
    joined = known.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
