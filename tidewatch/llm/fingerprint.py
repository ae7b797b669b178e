"""Homomorphic multiset fingerprints of texts, in DataFrame operations only.

A text is the multiset of its paragraphs, long ones cut after sentences. Each piece's md5 gives a wide vector: four
32-bit numbers, summed modulo 2**32, and 128 bits, each counted modulo 2**16. Sums don't depend on
the order of pieces, and a piece is added to or taken from a fingerprint without the text (``combined``,
``without``). Equal multisets have equal fingerprints. A bit counts as +1 or -1, so two texts' counts are a sketch of how
many pieces they share: the likeness is twice their inner product over the sum of their squares, cut to 0..1, with a
standard error of about 0.09; equal fingerprints have likeness 1.

A fingerprint is a struct: n (pieces), e (4 sums), c (128 counts). All of it fits any length of text.

Defined results: a null text is the empty text, which has one empty piece. ``edited_next`` orders rows by id, descending,
null last, rows of one id by their text's md5; a single document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored_table

_BITS, _WORDS = 128, 4
_WIDE, _NARROW = 1 << 32, 1 << 16
_ROWS_IN_BLOCK = 50_000
_NO_ID = -(1 << 63)


def pieces(text: Column) -> Column:
    """Paragraphs (lines), cut after full stops, exclamation and question marks that a space follows."""
    for mark in ".!?":
        text = F.replace(text, F.lit(mark + " "), F.lit(mark + "\n"))
    return F.split(text, "\n")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The key columns of each row (which must tell rows apart) and ``fp``, the fingerprint of its text."""
    words = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(_WORDS)]
    hashed = rows.select(*keys, F.explode(pieces(F.coalesce(F.col(text), F.lit("")))).alias("piece"))
    hashed = hashed.select(*keys, F.md5(F.col("piece").cast("binary")).alias("h")).select(*keys, *words)
    pairs = [F.shiftleft(F.col(f"w{2 * k + 1}"), 32).bitwiseOR(F.col(f"w{2 * k}")).alias(f"p{k}") for k in range(_WORDS // 2)]
    hashed = hashed.select(*keys, *[f"w{k}" for k in range(_WORDS)], *pairs)
    both = F.lit((1 << 32) | 1)  # two bits are counted in one sum, 32 places apart
    counts = [F.sum(F.shiftright(f"p{k}", i).bitwiseAND(both)).alias(f"c{k}_{i}") for k in range(_WORDS // 2) for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"e{k}") for k in range(_WORDS)], *counts)
    packed = F.array(*[F.col(f"c{k}_{i}") for k in range(_WORDS // 2) for i in range(32)])
    low, high = F.lit(_NARROW - 1), 32
    lanes = F.flatten(F.transform(packed, lambda x: F.array(x.bitwiseAND(low).cast("int"), F.shiftright(x, high).bitwiseAND(low).cast("int"))))
    sums = F.array(*[F.col(f"e{k}") % _WIDE for k in range(_WORDS)])
    return summed.select(*keys, F.struct(F.col("n"), sums.alias("e"), lanes.alias("c")).alias("fp"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together."""
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["e"], b["e"], lambda x, y: F.pmod(x + sign * y, F.lit(_WIDE))).alias("e"),
        F.zip_with(a["c"], b["c"], lambda x, y: F.pmod(x + sign * y, F.lit(_NARROW)).cast("int")).alias("c"),
    )


def without(a: Column, b: Column) -> Column:
    """The fingerprint of a multiset after the pieces of ``b``, all among its own, are taken out."""
    return combined(a, b, -1)


def written(fp: Column) -> Column:
    """As lower-case hexadecimal text: 8 digits for the number of pieces, 32 for the sums, 512 for the counts."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(fp["n"], 8), F.array_join(F.transform(fp["e"], lambda x: digits(x, 8)), ""), F.array_join(F.transform(fp["c"], lambda x: digits(x, 4)), ""))


def signs(fp: Column) -> Column:
    """The sum of +1 and -1 of each bit, known from counts modulo 2**16 while it is below 2**16. Only texts that repeat a piece
    tens of thousands of times go beyond; their likeness says nothing, while equality still holds."""
    n, whole = fp["n"], F.lit(2 * _NARROW)
    return F.transform(fp["c"], lambda c: F.pmod(F.lit(2) * c - n + F.lit(_NARROW), whole) - F.lit(_NARROW))


def likeness(a: Column, b: Column) -> Column:
    """From two sign vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)
    squares = dot(a, a) + dot(b, b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * dot(a, b) / squares)))


def next_rows(rows: DataFrame) -> DataFrame:
    """Rows (key, nth, n_chars) in descending order, each with the key, nth and n_chars of the row after it; the first
    follows the last. Blocks of a range partitioning are ordered each on its own; only their first rows meet."""
    n_blocks = max(1, ceil(rows.count() / _ROWS_IN_BLOCK))
    order = [F.col("key").desc(), F.col("nth").desc()]
    blocks = stored_table(rows.repartitionByRange(n_blocks, *order).withColumn("block", F.spark_partition_id()), "order")
    own = F.struct("key", "nth", "n_chars")
    heads = blocks.groupBy("block").agg(F.max(own).alias("head"))
    by_block = Window.orderBy("block")
    ends = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("block").alias("of"), F.coalesce(F.lead("head").over(by_block), F.first("head").over(ends)).alias("after"))
    led = blocks.withColumn("next", F.lead(own).over(Window.partitionBy("block").orderBy(*order)))
    led = led.join(heads, F.col("block") == F.col("of")).withColumn("next", F.coalesce("next", "after"))
    return stored_table(
        led.select("key", "nth", "n_chars", F.col("next.key").alias("next_key"), F.col("next.nth").alias("next_nth"), F.col("next.n_chars").alias("next_chars")), "next"
    )


def edited_next(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    where the edited text is the text with its second half replaced by as much of the next document."""
    # no column but these three, which both uses of the texts need: then they are moved by id once
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key")
    base = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("mark", F.md5(F.col("text").cast("binary")))
    after = next_rows(_numbered(base.select("key", "mark", F.length("text").alias("n_chars"))))
    base = _numbered(base)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    lent = base.select(F.col("key").alias("from_key"), F.col("nth").alias("from_nth"), F.col("text").alias("lent"))
    # the number of an id's row is compared outside the join key, so that the texts' partitioning by id serves twice
    lent = lent.join(after, (F.col("from_key") == F.col("next_key")) & (F.col("from_nth") - F.col("next_nth") == 0))
    lent = lent.select(F.col("key").alias("to_key"), F.col("nth").alias("to_nth"), "n_chars", "next_key", "next_nth", F.substring("lent", F.lit(1), half).alias("lent"))
    both = base.join(lent, (F.col("key") == F.col("to_key")) & (F.col("nth") - F.col("to_nth") == 0))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.col("lent"))
    keys = ["key", "nth", "n_chars", "next_key", "next_nth"]
    both = both.select(*keys, "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    keys.append("edited_sha256")
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("text")) for v, c in enumerate(("text", "edited"))])
    both = both.select(*keys, F.explode(versions).alias("v")).select(*keys, "v.version", "v.text")
    made = fingerprints(both, [*keys, "version"], "text")
    # both versions of a text are in one partition: bringing them into one row moves nothing
    made = made.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("version", "fp"))).alias("v"))
    made = stored_table(made.select(*keys, F.col("v")[0]["fp"].alias("own"), F.col("v")[1]["fp"].alias("of_edited")), "fingerprints")
    other = made.select(F.col("key").alias("k2"), F.col("nth").alias("m2"), F.col("own").alias("of_next"))
    joined = made.join(other, (F.col("next_key") == F.col("k2")) & (F.col("next_nth") - F.col("m2") == 0))
    joined = joined.withColumns({"s0": signs(F.col("own")), "s1": signs(F.col("of_edited")), "s2": signs(F.col("of_next"))})
    return joined.select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"),
        likeness(F.col("s0"), F.col("s2")).alias("near_next"),
    )


def _numbered(base: DataFrame) -> DataFrame:
    """Rows of one id are told apart by the md5 of their text; of equal rows any may come first."""
    return base.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("mark")))
