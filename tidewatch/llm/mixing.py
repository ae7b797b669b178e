"""Mixing sources to target weights along a curriculum that varies over the training.

Sources in code point order (null last) have the weights given, repeating. They share ``share`` times the words of all
documents, no source more than ``most`` times its own words; what a source can't take goes to the others by weight.
Each source reads its documents in a fixed pseudo-random order, again from the start where its target exceeds
its words, and stops at its target: the last document is cut at that word. A source's weight follows
a schedule over the training, given as a polyline of (time, weight). Its integral, scaled to the source's
target, is its cumulative demand; the word at which a document begins is inverted through it to the
training time at which the document is due. The mix is range-sorted by that time.

Running totals per source are exact and never gather a source: documents are cut into slots by the leading
digits of the hash that orders them, slots into coarser ones, and totals of slots precede their rows.

Defined results: a null text has no words and is not taken (nor is an empty one); a null source is a source;
where there are no words all targets are 0; rows that repeat are documents of their own, told apart by nothing, taken in turn.
Extra columns pass through ``mixed``.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, stored_table

Schedule = tuple[tuple[float, float], ...]

#: early, late and even sources, in turn
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
    ((0.0, 1.0), (1.0, 1.0)),
)
_ROWS_IN_SLOT = 128
_EARLIER = Window.unboundedPreceding, -1
_NO_SOURCE = "n"


def due(share: Column, schedule: Schedule) -> Column:
    """The time by which the schedule's integral has reached this share of its whole; beyond 1 the share itself."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), sum(areas), share
    for (t0, w0), (t1, w1), area in reversed(list(zip(schedule, schedule[1:], areas, strict=False))):
        before -= area
        part = share * F.lit(whole) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        time = F.lit(t0) + F.lit(2.0) * part / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * part))
        out = F.when(share * F.lit(whole) < F.lit(before + area), F.when(part <= 0, F.lit(t0)).otherwise(time)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: place, weight and target, from rows (source, source_size). The only single task; it sees a
    row per source.

    Weights raise all targets alike until sources reach their cap, those with the least cap per weight first, so
    the common level follows from running sums in that order.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source") == _NO_SOURCE, "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(full.rowsBetween(*_EARLIER)), F.lit(0.0)))
        / F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    above = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    ranked = ranked.withColumn("reached", F.first(above, ignorenulls=True).over(whole))
    return ranked.select(
        "source", "source_size", "place", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("reached")), F.col("cap")).alias("target")
    )


def sized(docs: DataFrame) -> DataFrame:
    """The rows as a struct ``row``, beside it the source as a key that is never null (so that joins and windows by
    it share one partitioning), the size in words and the hash that gives a document its turn."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(_NO_SOURCE)).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"),
    )


def _starts(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """Per source and slot the words before it, with the source's size, place and target; the digits of a slot."""
    digits = max(1, ceil(log(max(rows.count(), 1) / _ROWS_IN_SLOT, 16)))
    coarse = (digits + 1) // 2
    slots = rows.groupBy("source", F.substring("turn", 1, digits).alias("slot")).agg(F.sum("size").alias("words"))
    slots = stored_table(slots.withColumn("block", F.substring("slot", 1, coarse)), "slots")
    blocks = slots.groupBy("source", "block").agg(F.sum("words").alias("words"))
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    blocks = blocks.withColumn("block_start", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(*_EARLIER)), F.lit(0)))
    in_block = Window.partitionBy("source", "block").orderBy("slot").rowsBetween(*_EARLIER)
    slots = slots.withColumn("slot_start", F.coalesce(F.sum("words").over(in_block), F.lit(0)))
    targets = stored_table(source_targets(sources, weights, share, most), "targets")
    s, b, t = slots.alias("s"), blocks.alias("b"), targets.alias("t")
    starts = s.join(b, (F.col("s.source") == F.col("b.source")) & (F.col("s.block") == F.col("b.block")))
    starts = starts.join(t, F.col("s.source") == F.col("t.source"))
    begin = (F.col("slot_start") + F.col("block_start")).alias("begin")
    starts = starts.select(F.col("s.source").alias("of"), F.col("s.slot").alias("in_slot"), begin, "source_size", "place", "target")
    return stored_table(starts, "starts"), digits


def _assigned(rows: DataFrame, starts: DataFrame, digits: int, most: float, schedules: tuple[Schedule, ...]) -> DataFrame:
    rows = rows.withColumn("slot", F.substring("turn", 1, digits))
    placed = rows.join(starts, (rows["source"] == starts["of"]) & (rows["slot"] == starts["in_slot"]))
    own = Window.partitionBy("source", "slot").orderBy("turn", "size").rowsBetween(*_EARLIER)
    placed = placed.withColumn("begin", F.col("begin") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    stop, reads = F.round("target").cast("long"), []
    for k in range(ceil(most)):
        begin = F.col("begin") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), stop - begin)).cast("long")
        u = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(1.0))
        time = F.coalesce(*[F.when(F.col("place") % len(schedules) == i, due(u, s)) for i, s in enumerate(schedules)])
        reads.append(F.struct(words.alias("words"), time.alias("due")))
    placed = placed.withColumn("passes", F.array(*reads))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return placed.select("row", "source", "turn", "size", "source_size", "target", taken.alias("taken"), "passes")


def assigned(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    schedules: tuple[Schedule, ...] = SCHEDULES,
) -> DataFrame:
    """One row per document, range-sorted by the time it is first due: doc_id, size, source_size, target, taken,
    first_due (null if nothing of it is taken) and ``passes``: for each reading the words taken and the time due."""
    rows = stored_table(sized(docs).withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id"))), "sizes")
    placed = _assigned(rows, *_starts(rows, weights, share, most), most, schedules)
    first = F.col("passes")[0]
    placed = placed.orderBy(first["due"], "turn")
    return placed.select("row.doc_id", "size", "source_size", "target", "taken", F.when(first["words"] > 0, first["due"]).alias("first_due"), "passes")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    schedules: tuple[Schedule, ...] = SCHEDULES,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, cut where its source stops, range-sorted by the time
    it is due. Columns as given; of a cut text, ``n_chars`` follows the text where there is such a column."""
    rows = stored_table(sized(docs).drop("row"), "sizes")
    placed = _assigned(sized(docs), *_starts(rows, weights, share, most), most, schedules)
    reads = placed.select("row", "turn", "size", F.explode("passes").alias("read")).filter("read.words > 0")
    parts = F.split(F.col("row.text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    short = F.array_join(F.slice(parts, F.lit(1), (F.col("read.words") + lead).cast("int")), "")
    text = F.when(F.col("read.words") < F.col("size"), short).otherwise(F.col("row.text"))
    out = reads.orderBy("read.due", "turn")
    columns = {"text": text} | ({"n_chars": F.when(F.col("read.words") < F.col("size"), F.length(short)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
