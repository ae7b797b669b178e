"""What several operators of this package share: stored intermediates, runs of rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import stored_table

WORD = r"[^\x20\x09-\x0D]+"
_HUB_PARTS = 8

__all__ = ["WORD", "components", "documents", "forest", "remainder", "runs", "small_batches", "stored_table", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Whole texts go to Python by the thousand at most: ten thousand, the default, cost executors hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def remainder(key: Column, of: int) -> Column:
    """crc32 of a key's text, modulo ``of``: a split that any tool can repeat. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches, cut so that no group of equal keys is torn: tables with the offsets of their groups."""

    def borders(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = borders(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(borders(t), t.num_rows)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the smallest thing reachable over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (id, component) for every id in a link, the
    component named by its smallest id.

    Large stars and small stars in turn; every half round is a map-side combined minimum and a join on
    the id. The links of a hub, which may hold a third of all, are dealt to several tasks. Each round is stored.
    """
    spark = edges.sparkSession
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    nodes = stored_table(edges.select("a", "b").distinct(), "links")
    links, before = nodes.filter("a <> b"), None
    while True:
        both = links.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a hub's links are dealt to several tasks: its minimum is sent to each
        dealt = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(_HUB_PARTS)))
        low = low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_HUB_PARTS - 1))))
        large = dealt.join(low, ["u", "part"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        links = stored_table(small, "links")
        state = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ids = nodes.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return stored_table(
        ids.join(links.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component")),
        "components",
    )
