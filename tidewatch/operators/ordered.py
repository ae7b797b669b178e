"""Global event order without one global partition.

Rows are range-partitioned by the order into blocks, sorted inside and stored once. Order-dependent
operators then run per block and exchange only a small, fixed amount of state between blocks. With an ``entity``
its columns come first in the order, so every entity has an order of its own and a busy one spans many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.scan import ELEMENT, carried, outcome
from tidewatch.sources.storage import drop_tables, materialise, scratch_path

ORDER = ("ts", "uid")
_ROW_BITS = (1 << 33) - 1
_BLOCK_ROWS = 10_000_000
_BROADCAST_BLOCKS = 5_000  # a carried state has some hundred numbers at most, so 15 MB


@dataclass(frozen=True)
class OrderedBlocks:
    """``rows`` carries ``_block`` (below ``blocks``), ``_row`` (place inside the block) and, where ordered by entity, ``_entity``."""

    rows: DataFrame
    blocks: int

    @property
    def total(self) -> int:
        return self.rows.count()

    @property
    def sizes(self) -> list[tuple[int, int]]:
        """Rows of each block, for inspection; no operator asks for them."""
        return sorted((r["_block"], r["n"]) for r in self.rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())

    @property
    def by_entity(self) -> bool:
        return "_entity" in self.rows.columns

    def beside(self, per_block: DataFrame) -> DataFrame:
        """The rows, blocks whole and in order, with ``_entity_before`` and ``_before`` of their block on its first row at least."""
        own = per_block.select(F.col("block").cast("int").alias("_block"), F.col("entity").alias("_entity_before"), F.col("acc").alias("_before"))
        if self.blocks <= _BROADCAST_BLOCKS:
            joined = self.rows.join(F.broadcast(own.withColumn("_row", F.lit(0).cast("long"))), ["_block", "_row"], "left")
        else:
            joined = self.rows.join(own.hint("merge"), "_block", "left").sortWithinPartitions("_block", "_row")
        return joined.select(*self.rows.columns, "_entity_before", "_before")

    def with_position(self, name: str = "_position") -> DataFrame:
        """Global place in the order."""
        n = F.array(F.count(F.lit(1)).cast("double"))
        everyone = F.lit("")
        sizes = self.rows.groupBy(F.col("_block").cast("long").alias("block")).agg(n.alias("head"))
        sizes = sizes.select("block", F.lit(True).alias("only"), everyone.alias("first"), everyone.alias("last"), "head", F.col("head").alias("tail"))
        before = carried(sizes, self.blocks, np.add)
        offsets = before.select(F.col("block").cast("int").alias("_block"), F.coalesce(F.col("acc")[0].cast("long"), F.lit(0).cast("long")).alias("_offset"))
        offsets = F.broadcast(offsets) if self.blocks <= _BROADCAST_BLOCKS else offsets.hint("merge")
        joined = self.rows.join(offsets, "_block")
        return joined.withColumn(name, F.col("_offset") + F.col("_row")).drop("_offset")

    def with_entity_position(self, name: str = "_nth") -> DataFrame:
        """Place of each row (from 0) in the order of its entity."""
        counts = self.rows.select("_block", "_entity").mapInArrow(_counted, ELEMENT)
        placed = self.beside(carried(counts, self.blocks, np.add))
        schema = T.StructType([*self.rows.schema.fields, T.StructField(name, T.LongType())])
        return placed.mapInArrow(_numbered(name), schema)

    def tail_elements(self, length: int, columns: list[str]) -> DataFrame:
        """Of each block the last ``length`` rows of its first and of its last entity, as one array of numbers each."""
        held = [F.col(c).cast("double").alias(c) for c in columns]
        entity = ["_entity"] if self.by_entity else []
        return materialise(self.rows.select("_block", *entity, *held).mapInArrow(_tails(length, columns), ELEMENT))

    def tails(self, elements: DataFrame, length: int, width: int, lead: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
        """What comes before each block (see ``carried``), and the rows, ``length`` at most, that end the last one.
        ``lead``: rows that came before the first block."""
        first = ("", [float(v) for row in (lead or [])[-length:] for v in row]) if lead else None
        keep = length * width

        def compose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([x, y])[-keep:]

        _, end = outcome(elements, self.blocks, compose, first)
        rows = [] if end is None else np.reshape(end, (-1, width)).tolist()
        return carried(elements, self.blocks, compose, first), rows


def segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where runs of one block and one entity begin (and the end of the batch), the block of each row, and the entity of each run."""
    names = batch.schema.names
    block = batch.column(names.index("_block")).to_numpy()
    new = np.ones(len(block), dtype=bool)
    new[1:] = block[1:] != block[:-1]
    if "_entity" not in names:
        starts = np.flatnonzero(new)
        return np.append(starts, len(block)), block, [""] * len(starts)
    entity = batch.column(names.index("_entity"))
    new[1:] |= pc.not_equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    return np.append(starts, len(block)), block, entity.take(pa.array(starts)).to_pylist()


def element_rows(rows: list[tuple]) -> pa.RecordBatch:
    """(block, only, first, last, head, tail) as a batch."""
    types = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in ELEMENT.split(", ")])


def summaries(batches: Iterator[pa.RecordBatch], fresh, add, done) -> Iterator[pa.RecordBatch]:
    """One element per block. ``fresh(batch, at)`` starts an entity's summary, ``add(summary, batch, a, b)`` takes rows in, ``done``
    gives its numbers. Only the first and the last entity of a block are summarised: no other one reaches beyond it."""
    block = entity = first = head = summary = None

    def element() -> tuple:
        own = done(summary).tolist()
        return (block, True, entity, entity, own, own) if head is None else (block, False, first, entity, head, own)

    out = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts, blocks, entities = segments(batch)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if block is None or blocks[a] != block:
                if block is not None:
                    out.append(element())
                block, entity, first, head, summary = int(blocks[a]), entities[k], entities[k], None, fresh(batch, a)
            elif entities[k] != entity:
                if head is None:
                    head = done(summary).tolist()
                entity, summary = entities[k], fresh(batch, a)
            last = k == len(entities) - 1 or blocks[b] != blocks[a]
            if head is None or last:
                add(summary, batch, a, b)
    if block is not None:
        out.append(element())
    yield element_rows(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def add(count: np.ndarray, batch: pa.RecordBatch, a: int, b: int) -> None:
        count += b - a

    return summaries(batches, lambda batch, at: np.zeros(1), add, lambda count: count)


def _tails(length: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(held: list[np.ndarray], batch: pa.RecordBatch, a: int, b: int) -> None:
            own = batch.slice(max(a, b - length), b - max(a, b - length))
            x = np.column_stack([own.column(own.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            held[:] = [np.vstack([*held, x])[-length:]]

        return summaries(batches, lambda batch, at: [], add, lambda held: held[0].reshape(-1))

    return run


def carried_in(batch: pa.RecordBatch, at: int, entity: str) -> np.ndarray | None:
    """The state carried into the block whose first row is at ``at``, if it is that of the row's entity."""
    before = batch.column(batch.schema.get_field_index("_entity_before"))[at].as_py()
    return np.array(batch.column(batch.schema.get_field_index("_before"))[at].as_py()) if before is not None and before == entity else None


def without_carry(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select([n for n in batch.schema.names if n not in ("_entity_before", "_before")])


def _numbered(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = entity = None
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts, blocks, entities = segments(batch)
            out = np.empty(batch.num_rows, dtype=np.int64)
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if blocks[a] != block:
                    before = carried_in(batch, a, entities[k])
                    n = 0 if before is None else int(before[0])
                elif entities[k] != entity:
                    n = 0
                block, entity = blocks[a], entities[k]
                out[a:b] = np.arange(n, n + b - a)
                n += b - a
            yield without_carry(batch).append_column(name, pa.array(out))

    return run


def block_count(rows: int, least: int) -> int:
    """Blocks of about ten million rows; one beyond its memory share is sorted with spilling."""
    return max(least, rows // _BLOCK_ROWS + 1)


def ordered_blocks(
    df: DataFrame, order: tuple[str, ...] = ORDER, blocks: int | None = None, stored: bool = False, entity: tuple[str, ...] = ()
) -> OrderedBlocks:
    """Order ``df`` into blocks, by ``entity`` first if given. Pass ``stored=True`` when it is read straight from files.

    Equal keys are told apart by their place in the stored input, so that even copies of one record
    spread over blocks. That place must not change between attempts of a task, hence the input is
    stored before and the blocks are stored after. The first copy is deleted then.
    """
    spark = df.sparkSession
    source, path = df, None
    if not stored:
        path = scratch_path(spark, "unordered")
        df.write.parquet(path)
        source = spark.read.schema(df.schema).parquet(path)
    count = blocks or block_count(source.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = [F.to_json(F.struct(*[F.col(c) for c in entity]), {"ignoreNullFields": "false"}).alias("_entity")] if entity else []
    keys = [*(["_entity"] if entity else []), *order, "_place"]
    sorted_rows = (
        source.select("*", *named)
        .withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(count, *keys)
        .sortWithinPartitions(*keys)
    )
    numbered = sorted_rows.select(
        *df.columns,
        *(["_entity"] if entity else []),
        F.spark_partition_id().alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )
    rows = materialise(numbered)
    if path:
        drop_tables(spark, [path])
    return OrderedBlocks(rows, count)


def sliding_windows(
    blocks: OrderedBlocks, length: int = 10, columns: list[str] | None = None, bucket_rows: int = 50_000
) -> DataFrame:
    """Every run of ``length`` consecutive rows: ``_position`` of its last row and the window as
    ARRAY<ARRAY<DOUBLE>>. Rows are bucketed by position (buckets of equal size, so none is hot) and
    each bucket borrows the ``length - 1`` rows before it."""
    names = columns or FEATURE_NAMES
    halo = length - 1
    if bucket_rows <= halo:
        raise ValueError("a bucket must be longer than its halo")
    placed = blocks.with_position()
    bucket = F.floor(F.col("_position") / bucket_rows)
    lent = F.col("_position") % bucket_rows >= bucket_rows - halo
    kept = [c for c in blocks.rows.columns if c not in names and c not in ("_block", "_row")]
    copies = placed.select(
        *kept,
        "_position",
        F.array(*[F.col(c).cast("double") for c in names]).alias("_x"),
        F.explode(F.when(lent, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))).alias("_bucket"),
    )
    trailing = Window.partitionBy("_bucket").orderBy("_position").rowsBetween(-halo, 0)
    own = F.floor(F.col("_position") / bucket_rows) == F.col("_bucket")
    return (
        copies.withColumn("window", F.collect_list("_x").over(trailing))
        .filter(own & (F.size("window") == length))
        .drop("_bucket", "_x")
    )


def trailing_counts(blocks: OrderedBlocks, length: int = 10) -> DataFrame:
    """How many flows the trailing buffer holds when each flow is scored."""
    placed = blocks.with_position()
    return placed.withColumn("buffered", F.least(F.col("_position") + 1, F.lit(length))).drop("_block", "_row")


def entity_counts(blocks: OrderedBlocks, length: int = 10) -> DataFrame:
    """As ``trailing_counts``, with a buffer for each entity of blocks ordered by entity."""
    placed = blocks.with_entity_position("_nth")
    return placed.withColumn("buffered", F.least(F.col("_nth") + 1, F.lit(length))).drop("_block", "_row", "_entity", "_nth")
