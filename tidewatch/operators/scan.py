"""Scan over blocks of ordered rows, segmented by entity, without gathering blocks or an entity anywhere.

What a block does to the state carried through it is a short array of numbers, and arrays of neighbouring blocks compose to one. In rows
ordered by entity first, an entity that goes on into the next block is the last one of its block, so two arrays say all about a
block: that of its first entity (``head``) and that of its last (``tail``), both the same where the block holds ``only`` one.

Blocks are composed ``fan`` at a time, level by level, until one group is left; on the way back every
group hands each of its members what came before. A task sees ``fan`` rows, at any number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.storage import materialise

Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]

ELEMENT = "block long, only boolean, first string, last string, head array<double>, tail array<double>"
CARRY = "block long, entity string, acc array<double>"


@dataclass(frozen=True)
class _Element:
    only: bool
    first: str
    last: str
    head: np.ndarray
    tail: np.ndarray


def _then(x: _Element | None, y: _Element, compose: Compose) -> _Element:
    """What x and y after it do together."""
    if x is None:
        return y
    meet = x.last == y.first
    joined = compose(x.tail, y.head) if meet else None
    head = joined if x.only and meet else x.head
    tail = (joined if meet else y.head) if y.only else y.tail
    return _Element(x.only and y.only and meet, x.first, y.last, head, tail)


def _elements(rows: pd.DataFrame):
    for r in rows.sort_values("block").itertuples(index=False):
        yield r.block, _Element(bool(r.only), r.first, r.last, np.asarray(r.head), np.asarray(r.tail))


def _grouped(compose: Compose, fan: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, own in _elements(rows):
            whole = _then(whole, own, compose)
        parent = int(rows["block"].iloc[0]) // fan
        return pd.DataFrame([(parent, whole.only, whole.first, whole.last, whole.head, whole.tail)], columns=["block", "only", "first", "last", "head", "tail"])

    return run


def _handed_down(compose: Compose):
    """Rows of a group and what was carried into it -> what is carried into each member, and beyond the last."""

    def run(rows: pd.DataFrame, into: pd.DataFrame) -> pd.DataFrame:
        before = None
        for r in into.itertuples(index=False):
            if r.acc is not None and r.entity is not None:
                acc = np.asarray(r.acc, dtype=np.float64)
                before = _Element(True, r.entity, r.entity, acc, acc)
        out = []
        for block, own in _elements(rows):
            out.append((block, before.last if before else None, before.tail if before else None))
            before = _then(before, own, compose)
        return pd.DataFrame(out, columns=["block", "entity", "acc"])

    return run


def carried(elements: DataFrame, blocks: int, compose: Compose, lead: tuple[str, list[float]] | None = None, fan: int = 256) -> DataFrame:
    """One row per block of ``elements``: the entity that the rows before it end with, and the composed array of that entity's rows there
    (NULLs before the first). ``lead`` is what comes before the first block. ``blocks``: block numbers are below it."""
    spark = elements.sparkSession
    parent = F.expr(f"block div {fan}")
    if blocks <= fan:
        into = spark.createDataFrame([(0, *(lead or (None, None)))], CARRY)
    else:
        elements = materialise(elements)
        above = elements.groupBy(parent).applyInPandas(_grouped(compose, fan), ELEMENT)
        into = carried(above, -(-blocks // fan), compose, lead, fan)
    return elements.groupBy(parent.alias("of")).cogroup(into.groupBy("block")).applyInPandas(_handed_down(compose), CARRY)


def outcome(elements: DataFrame, blocks: int, compose: Compose, lead: tuple[str, list[float]] | None = None, fan: int = 256) -> tuple[str | None, np.ndarray | None]:
    """The last entity of all, and the composed array of its rows. ``fan`` rows at most come to the driver, at any number of blocks."""
    while blocks > fan:
        elements = elements.groupBy(F.expr(f"block div {fan}")).applyInPandas(_grouped(compose, fan), ELEMENT)
        blocks = -(-blocks // fan)
    before = _Element(True, lead[0], lead[0], np.asarray(lead[1]), np.asarray(lead[1])) if lead else None
    for _, own in _elements(elements.toPandas()):
        before = _then(before, own, compose)
    return (before.last, before.tail) if before else (None, None)
