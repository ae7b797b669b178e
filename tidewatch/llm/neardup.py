"""N-gram Jaccard join: a MinHash LSH forest finds candidates, whole shingle sets verify them.

``jaccard_join`` compares the sets of word shingles of all texts and links texts whose Jaccard similarity
reaches the threshold.

1. Texts of equal words are one text with a number of copies, known by a 128-bit key of its words. Texts are numbered
   in the order of their smallest id (nulls last); the number stands for the text, so ids need not name texts.
2. Each text has ``trees`` signatures of ``depth`` minimum hashes. Sorted, the signatures of a tree are the leaves of a
   prefix trie: texts below one node share that node's prefix. Leaves that are alone at the shortest prefix go.
3. Each text asks every tree at a prefix length of its own. All start at the full depth. While a partner at the threshold
   would be missed by all trees with a probability above 1 - ``recall``, the text shortens one prefix by one value: in
   the tree where the next node is the least crowded (by powers of two above ``CROWD`` texts), of these the longest, of these
   the first tree. So crowded nodes are asked by long prefixes, and others make up for it. Up to ``CROWD`` texts a node's size
   decides nothing, so the bound holds; among more, trees where a text stands apart from its like are preferred, and the bound
   may fall towards that of the full depth in all trees (0.9996 for the defaults, where ``recall`` is 0.9999).
   A text that asks a node is compared by whole signatures with all texts below it; only pairs far below the threshold (four
   standard errors) go. Pairs are never written: a node hands on a spanning forest of what it keeps.
4. Each connected group of such texts is gathered once, with whole texts, and all its pairs are compared by
   their exact shingle sets. A row per text leaves: its number of links and the smallest text linked to it.

Nodes and groups of any size are cut into blocks, and every pair of blocks is a task of its own, so neither
a node nor a group is ever in one place.

Defined results: a null text is an empty one; a text without words links with nothing, not even its like; a
text of fewer words than a shingle has one shingle of all its words. Repeated rows are copies of each other.
Different texts under one id, or without an id, are compared like any others. A class without any id has a null
class_id. Of each class exactly one row is kept: of its smallest id, of the text that comes first, whichever of
rows that repeat both. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.common import components, forest, runs, stored_table
from tidewatch.llm.words import chunks, mixed, shingle_hashes, text_bytes, word_hashes

BLOCK_TEXTS = 256
CROWD = 64
BLOCK_BYTES = 8 << 20
_PAIRS = 1 << 15
_KEY = ["k1", "k2", "n_words"]


def prefix_length(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold still meets in one of the trees often enough."""
    for r in range(depth, 0, -1):
        if 1 - (1 - threshold**r) ** trees >= recall:
            return r
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at similarity {threshold}")


def _text_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of the words of each text, in their order."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1].astype(np.uint64), np.diff(first))
    keys = np.zeros((2, len(first) - 1), dtype=np.uint64)
    for k in range(2):
        terms = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words + mixed(place * np.uint64(2) + np.uint64(k + 1))))])
        keys[k] = terms[first[1:]] - terms[first[:-1]]
    return keys


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _KEY]))
def _key(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    with np.errstate(over="ignore"):
        for column in columns:
            data, offsets = text_bytes(column)
            keys, sizes = [np.zeros((2, 0), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]  # of a batch without rows
            for a, b in chunks(offsets):
                words, _, _, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys.append(_text_keys(words, first)), sizes.append(np.diff(first))
            k = np.concatenate(keys, axis=1).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(k[0]), pa.array(k[1]), pa.array(np.concatenate(sizes))], names=_KEY)


def _signing(shingle: int, trees: int, depth: int, seed: int = 11):
    factors = (np.random.default_rng(seed).integers(0, 2**31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2)) + np.uint32(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for a, b in chunks(offsets):
                    words, _, _, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    shingles, start = shingle_hashes(words, first, shingle)
                    x, n = (shingles >> np.uint64(32)).astype(np.uint32), b - a
                    signature = np.zeros((n, trees * depth), dtype=np.uint32)
                    keys = _text_keys(words, first)
                    for i in range(n):
                        own = x[start[i] : start[i + 1]]
                        for at in range(0, len(own), 4096):
                            low = (factors * own[at : at + 4096]).min(axis=1)
                            signature[i] = low if at == 0 else np.minimum(signature[i], low)
                    flat = pa.py_buffer(signature.tobytes())
                    width = trees * depth * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, n),
                            pa.array(keys[0].view(np.int64)),
                            pa.array(keys[1].view(np.int64)),
                            pa.array(np.diff(first)),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), flat]),
                        ],
                        names=["doc_id", "k1", "k2", "n_words", "n_bytes", "signature"],
                    )

    return sign


def asked_lengths(crowds: np.ndarray, floor: int, threshold: float, recall: float) -> np.ndarray:
    """The prefix length at which each text asks each tree, from ``crowds[text, tree, k]``, how crowded its node of prefix length
    floor + k is."""
    n, trees, lengths = crowds.shape
    depth = floor + lengths - 1
    missed = np.log1p(-(float(threshold) ** np.arange(floor, depth + 1)))  # per length: log of the chance that a tree misses a partner
    at = np.full((n, trees), lengths - 1)
    rows, tree = np.arange(n), np.arange(trees)
    while len(rows):
        rows = rows[missed[at[rows]].sum(axis=1) > np.log1p(-recall)]
        own = at[rows]
        shorter = np.take_along_axis(crowds[rows], np.maximum(own - 1, 0)[:, :, None], axis=2)[:, :, 0].astype(np.int64)
        cost = np.where(own > 0, (shorter * lengths + (lengths - 1 - own)) * trees + tree, np.iinfo(np.int64).max)
        at[rows, cost.argmin(axis=1)] -= 1
    return at + floor


def _asking(trees: int, depth: int, floor: int, threshold: float, recall: float):
    """Per text, from its nodes that others share: which of them it asks."""

    @F.arrow_udf("array<struct<node: long, n: long, asks: boolean>>")
    def ask(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            nodes, of = column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            tree, length, n = (nodes.field(c).to_numpy(zero_copy_only=False) for c in ("tree", "length", "n"))
            crowds = np.zeros((len(column), trees, depth - floor + 1), dtype=np.int8)
            crowds[of, tree, length - floor] = np.ceil(np.log2(np.maximum(n / CROWD, 1)))
            asks = asked_lengths(crowds, floor, threshold, recall)[of, tree] == length
            out = pa.StructArray.from_arrays([nodes.field("node"), nodes.field("n"), pa.array(asks)], names=["node", "n", "asks"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(column)))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), out)

    return ask


def _met(reps: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> DataFrame:
    """The nodes that are asked, with the texts below them: rows (node, rep, n, asks), where n counts the node's texts."""
    floor = max(1, prefix_length(trees, depth, threshold, recall) - 1)
    size = 4 * depth  # bytes of one tree's signature
    leaf = [F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")]
    leaves = reps.select("rep", "signature", *leaf).select("rep", "tree", F.substring("signature", F.col("tree") * size + 1, F.lit(size)).alias("leaf"))
    node = F.xxhash64("tree", "length", F.substring("leaf", F.lit(1), 4 * F.col("length")))
    roots = leaves.withColumn("length", F.lit(floor)).withColumn("root", node)
    shared = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    # sorted, so that a node's leaves lie together and are counted where they are; a crowded node goes over several partitions
    tries = roots.join(shared, "root").select("rep", "tree", "leaf")
    tries = stored_table(tries.repartitionByRange("tree", "leaf", "rep").sortWithinPartitions("tree", "leaf", "rep"), "tries")
    nodes = tries.withColumn("length", F.explode(F.sequence(F.lit(floor), F.lit(depth)))).select("rep", "tree", "length", node.alias("node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    own = nodes.join(sizes, "node").groupBy("rep").agg(F.collect_list(F.struct("tree", "length", "n", "node")).alias("nodes"))
    asked = own.select("rep", F.explode(_asking(trees, depth, floor, threshold, recall)("nodes")).alias("a"))
    asked = stored_table(asked.select("rep", "a.node", "a.n", "a.asks"), "asked")
    return asked.join(asked.filter("asks").select("node").distinct(), "node")


def _signatures(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, _ = text_bytes_binary(column)
    return data.view(np.uint32).reshape(len(column), width)


def text_bytes_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data), offsets - offsets[0]


def _near_by_signature(width: int, least: float):
    """Per run (a pair of blocks of a node): compare the signatures of those that ask with all others, hand on a spanning forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["node", "i", "j"]):
            reps = t.column("rep").to_numpy()
            asks = t.column("asks").to_numpy()
            own = _signatures(t.column("signature"), width)
            found_a, found_b = [], []
            for size in np.unique(np.diff(at)):
                starts = at[:-1][np.diff(at) == size]
                x, y = np.triu_indices(size, 1)
                step = max(1, _PAIRS // max(1, len(x)))
                for s in range(0, len(starts), step):
                    a = (starts[s : s + step, None] + x[None, :]).reshape(-1)
                    b = (starts[s : s + step, None] + y[None, :]).reshape(-1)
                    for p in range(0, len(a), _PAIRS):
                        u, v = a[p : p + _PAIRS], b[p : p + _PAIRS]
                        met = asks[u] | asks[v]
                        u, v = u[met], v[met]
                        near = np.count_nonzero(own[u] == own[v], axis=1) >= least * width
                        found_a.append(u[near])
                        found_b.append(v[near])
            a, b = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in (found_a, found_b))
            root = forest(len(reps), a, b)
            moved = np.flatnonzero(root != np.arange(len(reps)))
            pairs = np.unique(np.stack([reps[moved], reps[root[moved]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return compare


def _verified(shingle: int, threshold: float):
    """Per run (a pair of blocks of a group): exact Jaccard of all its pairs, a row per text that has a link."""

    def common(sets: list[np.ndarray]) -> np.ndarray:
        if len(sets) == 2:
            n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return np.array([[len(sets[0]), n], [n, len(sets[1])]])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
        last = int(column[-1]) + 1
        for low in range(0, last, 4096):
            p, q = np.searchsorted(column, [low, low + 4096])
            has = np.zeros((len(sets), min(4096, last - low)), dtype=np.float32)
            has[owner[p:q], column[p:q] - low] = 1
            shared += has @ has.T
        return np.rint(shared).astype(np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for t, at in runs(batches, ["gid", "i", "j"]):
                reps, copies, block = (t.column(c).to_numpy() for c in ("rep", "copies", "block"))
                i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
                out_rep, out_root, out_links = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    data, offsets = text_bytes(t.column("text").slice(a, b - a))
                    sets = []
                    for p, q in chunks(offsets):
                        words, _, _, first = word_hashes(data[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p])
                        s, start = shingle_hashes(words, first, shingle)
                        sets += [np.unique(s[start[k] : start[k + 1]]) for k in range(q - p)]
                    if len(sets) < 2:
                        continue
                    size = np.array([len(s) for s in sets])
                    shared = common(sets)
                    near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                    np.fill_diagonal(near, False)
                    if i[a] != j[a]:
                        near &= block[a:b, None] != block[None, a:b]
                    u, v = np.nonzero(near)
                    linked = np.flatnonzero(near.any(axis=1))
                    own = reps[a:b]
                    order = np.argsort(own, kind="stable")
                    rank = np.empty(len(own), dtype=np.int64)
                    rank[order] = np.arange(len(own))
                    root = own[order][forest(len(own), rank[u], rank[v])][rank]
                    out_rep.append(own[linked])
                    out_root.append(root[linked])
                    out_links.append((near @ copies[a:b])[linked])
                if out_rep:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_rep, out_root, out_links)], names=["a", "b", "links"])

    return verify


def _blocks(members: DataFrame, group: str, n_blocks: str) -> DataFrame:
    """Each row into one block of its group, then one copy for every pair of blocks it is part of."""
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(n_blocks) - 1).cast("int")))
    dealt = members.withColumn("block", block).withColumn("other", other)
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", n_blocks)
    return dealt.repartition(F.col(group), F.col("i"), F.col("j")).sortWithinPartitions(group, "i", "j", "rep")


def _classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, recall: float = 0.9999, trees: int = 20, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, text key), and one row per text with words: key, first_id and first_row (of its smallest id),
    copies, class_id, n_links, head (its class keeps this text)."""
    width = trees * depth
    least = threshold - 4 * (threshold * (1 - threshold) / width) ** 0.5
    signed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signing(shingle, trees, depth), "doc_id long, k1 long, k2 long, n_words long, n_bytes long, signature binary"
    )
    signed = stored_table(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("lowest")
    texts = signed.filter("n_words > 0").groupBy(*_KEY).agg(lowest, F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    texts = texts.select(*_KEY, "copies", "n_bytes", F.col("lowest.doc_id").alias("first_id"), F.col("lowest.row").alias("first_row"))
    texts = texts.orderBy(F.asc_nulls_last("first_id"), *_KEY).withColumn("rep", F.monotonically_increasing_id())
    texts = stored_table(texts, "texts")
    reps = stored_table(signed.select(F.col("row").alias("first_row"), "signature").join(texts.select("first_row", "rep"), "first_row").select("rep", "signature"), "reps")
    members = _met(reps, trees, depth, threshold, recall).join(reps, "rep")
    members = members.select("node", "rep", "asks", F.ceil(F.col("n") / BLOCK_TEXTS).alias("n_blocks"), "signature")
    candidates = _blocks(members, "node", "n_blocks").mapInArrow(_near_by_signature(width, least), "a long, b long")
    groups = components(candidates).select(F.col("id").alias("rep"), F.col("component").alias("gid"))
    sized = groups.join(texts.select("rep", *_KEY, "first_id", "copies", "n_bytes"), "rep")
    sizes = sized.groupBy("gid").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n_bytes") / BLOCK_BYTES)).alias("n_blocks")
    )
    sized = stored_table(sized.join(sizes, "gid").select("gid", "rep", "copies", "n_blocks", *_KEY, "first_id"), "groups")
    # by key and id, so that copies are dealt to many tasks; rows that repeat both are equal in words
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", _key("text"))
    same = F.col("id").eqNullSafe(F.col("first_id"))
    for c in _KEY:
        same &= F.col(f"key.{c}") == F.col(c)
    # texts move once at any size: a broadcast would do for few groups only, and the disk needed would jump where it ends
    compared = keyed.join(sized.hint("merge"), same).select("rep", "text", "gid", "copies", "n_blocks").dropDuplicates(["rep"])
    links = stored_table(_blocks(compared, "gid", "n_blocks").mapInArrow(_verified(shingle, threshold), "a long, b long, links long"), "exact")
    classes = components(links.select("a", "b")).withColumnRenamed("id", "rep")
    heads = classes.filter("rep = component").select("component").join(texts.select(F.col("rep").alias("component"), F.col("first_id").alias("head_id")), "component")
    classes = classes.join(stored_table(heads, "heads"), "component")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = texts.join(counts, "rep", "left").join(classes, "rep", "left")
    known = known.select(
        *_KEY,
        "first_id",
        "first_row",
        "copies",
        F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("head_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce(F.col("component") == F.col("rep"), F.lit(True)).alias("head"),
    )
    return signed.select("row", "doc_id", *_KEY), stored_table(known, "known")


def jaccard_join(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, recall: float = 0.9999, trees: int = 20, depth: int = 5
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id reachable over links, its own if it has none),
    n_links (other documents it is directly linked with, copies included), kept (one row of each class)."""
    rows, known = _classes(docs, shingle, threshold, recall, trees, depth)
    result = rows.join(known, _KEY, "left")
    alone = F.col("head").isNull()  # a text without words
    return result.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("head") & (F.col("row") == F.col("first_row")))).alias("kept"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each class of near copies: a row of the smallest id stays. Columns as given."""
    rows, known = _classes(docs, **options)
    # texts of which some row goes; rows are found again by the words they have, whatever their ids
    torn = known.filter("copies > 1 or not head").select(*[F.col(c).alias(f"torn_{c}") for c in _KEY], F.col("head").alias("torn_head"), F.col("first_id").alias("torn_id"))
    torn = stored_table(torn, "torn")
    same = rows["doc_id"].eqNullSafe(torn["torn_id"])
    for c in _KEY:
        same &= rows[c] == torn[f"torn_{c}"]
    again = rows.join(torn.filter("torn_head"), same).groupBy(*[F.col(f"torn_{c}") for c in _KEY]).agg(F.count("*").alias("torn_rows")).filter("torn_rows > 1")
    again = stored_table(again, "again")
    torn = stored_table(torn.join(again, [f"torn_{c}" for c in _KEY], "left"), "torn")
    # the row travels as one struct, so that no column of it meets a name of ours
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("torn_row"), F.col("doc_id").cast("long").alias("own_id"), _key(F.col("text").cast("string")).alias("own_key"))
    fits = F.lit(True)
    for c in _KEY:
        fits &= F.col(f"own_key.{c}") == F.col(f"torn_{c}")
    first = F.col("torn_head") & F.col("own_id").eqNullSafe(F.col("torn_id"))
    joined = keyed.join(torn, fits, "left")
    kept = joined.filter(F.col("torn_head").isNull() | (first & F.col("torn_rows").isNull())).select("torn_row.*")
    if again.isEmpty():
        return kept
    several = keyed.join(torn.filter("torn_rows is not null"), fits & first).dropDuplicates([f"torn_{c}" for c in _KEY])
    return kept.unionByName(several.select("torn_row.*"))
