"""Alignment of the tokens of two tokenizers over the same bytes, and how often their tokens meet in the whole corpus.

Documents go through Arrow in slices of about half a megabyte:

1. Both tokenizers give a list of ids per document. The lists are flattened beside the index of the document they came from, and
   cumulative sums of the tokens' byte lengths, less their value where a document begins, give the byte where each token ends.
2. A full outer Acero hash join of both sides on (document, end) gives every byte where a token of either side ends. In order of
   the key, each row is one link: the tokens of A and B that cover the bytes up to it are the next ones to end, filled in from
   behind. Rows found on both sides end a group.
3. ``Table.group_by`` counts the links of each document by pair of ids. A block of about ``block_bytes`` numbers its pairs and
   holds the partial count of each.

Spark sums the partial counts of all blocks to the corpus count of each pair and finds the highest of each B id. They come
back to the blocks that hold the pair, where the documents' numbers meet them. A frequent pair is a row per block, never one per occurrence;
a block, not a key, is what one task gets.

Defined results: a text that is null or empty, or whose tokens don't give back its bytes on both sides, has no tokens: zeros
and empty strings. Repeated rows are documents of their own and count again. A null doc_id is kept. Other columns
are not used.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored_table
from tidewatch.llm.words import chunks, text_bytes

_AT_ONCE = 1 << 19
_LONG = 1 << 32
_UNIT = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
_OTHER_SPACE = re.compile(r"[^\S \n\t]")
_STORED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "numbers array<int>, times array<int>, pairs array<long>, counts array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: itself if it prints, else the next one from 256 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenPairs:
    """Ids of both tokenizers for whole texts. A space is put before the text for A; B adds its own.

    Neither tokenizer joins tokens over the start of white space, so ids of short units (white space and what follows) are held
    from text to text, the less recent half being forgotten when there are too many. Texts with other white space, or
    vocabularies with pieces over such a border, go through the tokenizers whole."""

    def __init__(self, a_path: str, b_path: str, most: int) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # a task has one core: without this the tokenizers library starts a thread for each core of the machine in every worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b, self.most = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), most
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        entries = self.a.get_vocab()
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            # special tokens are never produced: their strings in texts are plain text
            a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.names = pa.array([str(i) for i in range(max(len(a_bytes), len(b_bytes)))])
        self.space = next((i for i, p in enumerate(pieces) if p == "▁"), None)
        inner = any(not self.b.is_byte(i) and ("\n" in p or "\t" in p or "▁" in p.lstrip("▁")) for i, p in enumerate(pieces))
        self.unit_wise = not inner and self.space is not None and self._same_in_units("One  two\n\tthree's  \n x1!? ä.\n\n  End ")
        self.held: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _same_in_units(self, text: str) -> bool:
        whole, units = self._plain([text])[0], self._of_units(_UNIT.findall(" " + text))
        return tuple(b"".join(u[k] for u in units) for k in (0, 1)) == whole

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        b = [np.array(ids, dtype=np.int32).tobytes() for ids in self.b.encode(texts, num_threads=1)]
        return list(zip(self._encoded([" " + t for t in texts]), b, strict=True))

    def _of_units(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        out = []
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for u, a_ids, b_ids in zip(units, self._encoded(units), b, strict=True):
            if u == " ":  # at the end of a text; B adds no space to an empty one
                b_ids = [self.space]
            elif u[0] != " ":  # the space that B adds to every text
                b_ids = b_ids[1:] if b_ids[:1] == [self.space] else b_ids
            out.append((a_ids, np.array(b_ids, dtype=np.int32).tobytes()))
        return out

    def forget(self) -> None:
        self.old = {}

    def of(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        if len(self.held) >= self.most:
            self.old, self.held = self.held, {}
        whole = [not self.unit_wise or _OTHER_SPACE.search(t) is not None for t in texts]
        split = [[] if w or not t else _UNIT.findall(" " + t) for t, w in zip(texts, whole, strict=True)]
        held, once, fresh = self.held, {}, []
        for u in set().union(*split):  # a difference with the keys would go through all that is held
            if u in held:
                continue
            if u in self.old:
                held[u] = self.old[u]
            else:
                fresh.append(u)
        for u, own in zip(fresh, self._of_units(fresh) if fresh else [], strict=True):
            (held if len(u) <= 64 else once)[u] = own
        plain = iter(self._plain([t for t, w in zip(texts, whole, strict=True) if w]))
        a, b = [], []
        for units, w in zip(split, whole, strict=True):
            own = [next(plain)] if w else [held.get(u) or once[u] for u in units]
            a.append(b"".join([x for x, _ in own]))
            b.append(b"".join([x for _, x in own]))
        return a, b


_HELD: dict[tuple[str, str, int], TokenPairs] = {}  # for the life of a Python worker


def _token_pairs(a_path: str, b_path: str, most: int) -> TokenPairs:
    key = (a_path, b_path, most)
    if key not in _HELD:
        _HELD[key] = TokenPairs(*key)
    return _HELD[key]


def _lists(parts: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(x) // 4 for x in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))]))


def _joined(lists: pa.ListArray, token_bytes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where each document's begin."""
    taken = token_bytes.take(lists.values)
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], dtype=np.uint8) if taken.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets[lists.offsets.to_numpy()].astype(np.int64)


def _ends(lists: pa.ListArray, sizes: pa.Array) -> pa.Array:
    """(document, end) of each token as one number: a cumulative sum in each document."""
    document = pc.list_parent_indices(lists).cast(pa.int64())
    total = pc.cumulative_sum(sizes.take(lists.values))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets)
    return pc.add(pc.multiply(document, _LONG), pc.subtract(total, before.take(document)))


def align(a: pa.ListArray, b: pa.ListArray, tokens: TokenPairs) -> tuple[pa.Table, list[str]]:
    """Of documents with equal bytes on both sides and at least one token: the number of links by (document, pair), and the groups of each as text."""
    a_ends, b_ends = _ends(a, pc.binary_length(tokens.a_bytes).cast(pa.int64())), _ends(b, pc.binary_length(tokens.b_bytes).cast(pa.int64()))
    left = pa.table({"key": a_ends, "a": a.values.cast(pa.int64())})
    right = pa.table({"key": b_ends, "b": b.values.cast(pa.int64())})
    met = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key, a_id, b_id = (met.column(c).combine_chunks() for c in ("key", "a", "b"))
    pair = pc.add(pc.multiply(pc.fill_null_backward(a_id), _LONG), pc.fill_null_backward(b_id))
    document = pc.shift_right(key, 32)
    links = pa.table({"document": document, "pair": pair}).group_by(["document", "pair"], use_threads=False).aggregate([([], "count_all")])
    both = pc.and_(a_id.is_valid(), b_id.is_valid())
    words = []
    for ids, lists in ((a_id, a), (b_id, b)):
        last = pc.cumulative_sum(ids.is_valid().cast(pa.int32())).filter(both)
        words.append(pc.binary_join(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), last]), tokens.names.take(lists.values)), ","))
    groups = pc.binary_join_element_wise(*words, "|")
    first = np.searchsorted(document.filter(both).to_numpy(), np.arange(len(a) + 1)).astype(np.int32)
    return links, pc.binary_join(pa.ListArray.from_arrays(pa.array(first), groups), ";").to_pylist()


def _aligned(a_path: str, b_path: str, block_bytes: int, held_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = _token_pairs(a_path, b_path, held_units), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []  # of a slice: ids, token counts, groups, links by document and pair
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            pairs = np.concatenate([x[-1].column("pair").to_numpy() for x in rows] or [np.zeros(0, np.int64)])
            times = np.concatenate([x[-1].column("count_all").to_numpy() for x in rows] or [np.zeros(0, np.int64)])
            names, number = np.unique(pairs, return_inverse=True)
            counts = np.bincount(number, weights=times, minlength=len(names)).astype(np.int64)
            often = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
            place = np.empty(len(names), dtype=np.int32)
            place[often] = np.arange(len(names), dtype=np.int32)
            at = 0
            for keys, n_a, n_b, n_groups, n_links, sha, first, links in rows:
                n = links.num_rows
                own = place[number[at : at + n]]
                at += n
                nothing = pa.nulls(len(keys), pa.list_(pa.int64()))
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (own, links.column("count_all").to_numpy())]
                plain = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), keys, *plain, sha, *lists, nothing, nothing], names=fields)
            one = [pa.array([None], pa.int64())] * 5
            tail = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (names[often], counts[often])]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *one, pa.array([None], pa.string()), *[pa.nulls(1, pa.list_(pa.int32()))] * 2, *tail], names=fields)
            rows.clear()
            size, block = 0, block + 1

        fields = [c.split()[0] for c in _STORED.split(", ")]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for p, q in chunks(offsets, _AT_ONCE):
                own = data[offsets[p] : offsets[q]]
                rows.append(_slice(batch.column(0).slice(p, q - p), own, offsets[p : q + 1] - offsets[p], tokens))
                size += len(own)
                if size >= block_bytes:
                    yield from flush()
        if rows:
            yield from flush()
        tokens.forget()

    return run


def _slice(keys: pa.Array, data: np.ndarray, offsets: np.ndarray, tokens: TokenPairs) -> tuple:
    n = len(keys)
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    a_parts, b_parts = tokens.of([t.decode("utf-8") for t in texts])
    sound = np.array([bool(t) for t in texts], dtype=bool)
    for parts, token_bytes in ((a_parts, tokens.a_bytes), (b_parts, tokens.b_bytes)):
        found, at = _joined(_lists(parts), token_bytes)
        for k in np.flatnonzero(sound):
            size = at[k + 1] - at[k]
            sound[k] = size == len(texts[k]) + 1 and found[at[k]] == 32 and found[at[k] + 1 : at[k + 1]].tobytes() == texts[k]
    kept = np.flatnonzero(sound)
    n_a, n_b, n_groups, n_links = (np.zeros(n, dtype=np.int64) for _ in range(4))
    sha = [""] * n
    first = np.zeros(n + 1, dtype=np.int32)
    links = pa.table({"pair": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})
    if len(kept):
        a, b = _lists([a_parts[k] for k in kept]), _lists([b_parts[k] for k in kept])
        links, groups = align(a, b, tokens)
        links = links.sort_by([("document", "ascending")])
        document = kept[links.column("document").to_numpy()]
        n_a[kept], n_b[kept] = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
        n_links[:] = np.bincount(document, weights=links.column("count_all").to_numpy(), minlength=n).astype(np.int64)
        first = np.searchsorted(document, np.arange(n + 1)).astype(np.int32)
        for k, text in zip(kept, groups, strict=True):
            n_groups[k], sha[k] = text.count(";") + 1, hashlib.sha256(text.encode("ascii")).hexdigest()
    return keys, n_a, n_b, n_groups, n_links, pa.array(sha, pa.string()), first, links


def _looked_up(documents: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a block meet the corpus counts of its pairs."""
    place = known.column("place").to_numpy()
    count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=bool)
    count[place], best[place] = known.column("total").to_numpy(), known.column("best").to_numpy()
    n = documents.num_rows
    numbers, times = documents.column("numbers").combine_chunks(), documents.column("times").combine_chunks()
    document = pc.list_parent_indices(numbers)
    number, weight = pc.list_flatten(numbers).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
    # whole numbers, also where sums go beyond what a double holds exactly
    per_link = pa.table({"document": document, "n_best": pa.array(np.where(best[number], weight, 0)), "count_sum": pa.array(weight * count[number])})
    sums = per_link.group_by("document", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    out = np.zeros((2, n), dtype=np.int64)
    at = sums.column("document").to_numpy()
    out[0, at], out[1, at] = sums.column("n_best_sum").to_numpy(), sums.column("count_sum_sum").to_numpy()
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(out[0])).append_column("count_sum", pa.array(out[1])).append_column("groups_sha256", documents.column("groups_sha256"))


def token_pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, total (links of the corpus that hold it), best (no pair of its B id has more)."""
    partial = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    # at most as many rows under a B id as A has ids
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_LONG - 1)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = 4 << 20, held_units: int = 150_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A is a byte-level file of
    the tokenizers library, B a sentencepiece model. ``held_units`` bounds what a worker remembers, ``block_bytes`` what it works on."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = stored_table(rows.mapInArrow(_aligned(a_path, b_path, block_bytes, held_units), _STORED), "aligned")
    own = blocks.filter("pairs is not null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    known = own.join(token_pair_counts(blocks), "pair").select("of_block", "place", "total", "best")
    documents = blocks.filter("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "times")
    return documents.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_looked_up, _RESULT)
