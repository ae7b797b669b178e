"""Token ids of whole documents in ORC files: stripes that are read in parallel, row indexes, Bloom filters on document ids.

``write_token_ids`` deals the documents out by ranges of one total order (doc_id with nulls last, hash of the text, place in
the input), so that neither an id that repeats nor missing ids come to one task. A task tokenizes its range as it
arrives and writes files of its rows in that order. A row is a document: doc_id, part (the range it is in), before (ids of the part before it), n_tokens,
ids. ORC run-length encodes the integers; a stripe has about ``stripe_bytes`` and stands alone, so several tasks
read one file. Each ``index_rows`` rows have a minimum and maximum of every column, and a Bloom filter of their
doc_ids. Beside the ``ids`` lies ``parts``: the place of every part's first id among the ids of all documents. It has one row per
part, so a document's place in the whole is known without a pass over documents.

``read_token_ids`` gives all documents, ``find_documents`` those of some ids (ORC skips what its filters rule out)
and ``token_range`` the ids at places [first, last) of the whole, for which only parts and row groups that hold
such places are read.

Defined results: a null or empty text has only the end id; repeated rows are written once each, as are rows that share
an id; null ids come last; an empty table has no documents. Columns other than doc_id and text are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewatch.llm.packing import WordIds, held_word_ids
from tidewatch.llm.words import chunks, text_bytes

_AT_ONCE = 4 << 20
_ROWS = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def _encoded(tokenizer: str, end_id: int, held_words: int):
    """Per task: documents in their order with their ids, and the number of ids before them."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: WordIds = held_word_ids(tokenizer, held_words)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, _AT_ONCE):
                ids = [own + end for own in words.of([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(a, b)])]
                starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
                flat = pa.Array.from_buffers(pa.int32(), int(starts[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.full(b - a, part, dtype=np.int32)),
                        pa.array(before + starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(starts[-1])

    return encode


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    stripe_bytes: int = 16 << 20,
    index_rows: int = 1000,
    false_positives: float = 0.01,
    held_words: int = 500_000,
) -> None:
    """Writes ``ids`` and ``parts`` under ``path``. ``held_words`` bounds the words a worker remembers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    # keys that stay the same over a retry of the task: they come from a row and its place in the input alone
    rows = rows.select("doc_id", "text", order[1].alias("h"), order[2].alias("place"))
    keys = [order[0], F.col("h"), F.col("place")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(false_positives),
        "orc.stripe.size": str(stripe_bytes),
        "orc.row.index.stride": str(index_rows),
        "orc.create.index": "true",
        "compression": "zstd",
    }
    dealt.mapInArrow(_encoded(tokenizer, end_id, held_words), _ROWS).write.options(**options).orc(f"{path}/ids")
    held = _files(docs.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"))
    # one row per written part, so the running sum is over as many rows as there are files
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held.withColumn("first", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.orc(f"{path}/parts")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).orc(f"{path}/ids")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, n_ids long, n_docs long, first long").orc(f"{path}/parts")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _placed(spark, path, _files(spark, path))


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("part", "before")]
    placed = rows.join(_parts(spark, path).select("part", "first"), "part").withColumn("start", F.col("first") + F.col("before"))
    return placed.select("doc_id", "start", *[c for c in kept if c != "doc_id"])


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """As ``read_token_ids``, for the documents of the given ids. Stripes and row groups without them are not read."""
    return _placed(spark, path, _files(spark, path).filter(F.col("doc_id").isin(doc_ids)))


def token_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, start, ids: the ids at places [first, last) of all ids; ``start`` is the place of a row's first one.
    A filter per part that overlaps the range, so a range should not span more than some hundred parts."""
    found = _parts(spark, path).filter((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first)).select("part", "first").orderBy("part").collect()
    wanted = F.lit(False)
    for row in found:
        inside = (F.col("before") < last - row["first"]) & (F.col("before") + F.col("n_tokens") > first - row["first"])
        wanted |= (F.col("part") == row["part"]) & inside
    placed = _placed(spark, path, _files(spark, path).filter(wanted))
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("start"))
    take = F.least(F.lit(last) - F.col("start"), F.col("n_tokens")) - skip
    return placed.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


@F.arrow_udf(LongType())
def ids_crc32(column: pa.Array) -> pa.Array:
    """crc32 of each list of ids as little-endian unsigned 32-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
    return pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], type=pa.int64())


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. The ids themselves stay where they are read."""
    rows = _files(spark, path).select("doc_id", "part", "before", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
    return _placed(spark, path, rows)
