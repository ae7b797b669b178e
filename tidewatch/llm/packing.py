"""Cost-balanced packing of token sequences.

A document becomes its token ids and an end id. Documents are packed in blocks of about ``block_tokens`` tokens, each
inside one task and as they arrive, so nothing is shuffled and a task holds one block. The block's tokens are
dealt to sequences of exactly as many places: full ones, and for what is left over sequences whose lengths are
powers of two, which need no padding. A document that fills whole sequences gets them; all that is left of
the documents goes, longest first, to the sequence of the lowest cost that still has room for it, where the cost of a
piece is linear in its length plus quadratic (attention). What fits nowhere is cut: it fills
the sequence with the most room, and the rest is dealt like a piece of its own.

Defined results: a null or empty text has only the end id; repeated rows are packed once each; an empty
table gives no piece. Other columns are not carried. Sequence ids hold the partition's number, so they are
unique, and the same for the same partitions of the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import chunks, text_bytes

CAPACITY = 4096
_AT_ONCE = 2 << 20
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Token ids of texts as bytes (little-endian, 32 bits each), for tokenizers that never join words over
    white space. Ids of words are held; the less recent half is forgotten when there are too many."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.held: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.word_wise = self._is_word_wise()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:  # then the ids of many words can be told apart after one call
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _is_word_wise(self) -> bool:
        """Whether words can go through the tokenizer alone: it drops white space, lowers letters, and cuts marks from the
        letters before them. Any other tokenizer gets whole texts."""

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        marks = all(ids("Straße" + m) == ids("straße") + ids(m) for m in [*_MARKS.decode(), "...", "!?", '",'])
        return marks and ids("An ÄPFEL\tof\n\n thE") == ids("an") + ids("äpfel") + ids("of") + ids("the")

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; words of letters only go through the tokenizer together."""
        texts = [w.decode("utf-8") for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        out: list[bytes | None] = [None] * len(words)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain) and cuts[-1] == len(ids):  # else some word has several ends: each goes alone
                flat, last = ids.tobytes(), 0
                for k, cut in zip(plain, (cuts * 4).tolist(), strict=True):
                    out[k] = flat[last:cut]
                    last = cut
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _learn(self, words: set[bytes]) -> None:
        held, old = self.held, self.old
        wanted: set[bytes] = set()
        lowered: list[tuple[bytes, bytes]] = []
        cut: list[tuple[bytes, bytes, bytes]] = []
        known = old.get
        for w in words:  # a difference with the keys would go through all that is held
            if w in held:
                continue
            own = known(w)
            if own is not None:
                held[w] = own
                continue
            base = w.rstrip(_MARKS)  # marks after letters are a token run of their own
            if base == w:
                if w.isalpha() and not w.islower():
                    base = w.lower()
                    lowered.append((w, base))
                wanted.add(base)
            elif base.isalpha() or base and base.decode("utf-8").isalpha():
                marks, base = w[len(base) :], base.lower() if base.isalpha() else base
                cut.append((w, base, marks))
                wanted.add(base)
                wanted.add(marks)
            else:
                wanted.add(w)
        fresh = []
        for w in wanted:
            if w in held:
                continue
            own = known(w)
            if own is not None:
                held[w] = own
            else:
                fresh.append(w)
        held.update(zip(fresh, self._encoded(fresh), strict=True))
        for w, base in lowered:
            held[w] = held[base]
        for w, base, marks in cut:
            held[w] = held[base] + held[marks]

    def forget(self) -> None:
        """Drop the less recent half."""
        self.old = {}

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.word_wise:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
        if len(self.held) >= self.most:
            self.old, self.held = self.held, {}
        split = [t.split() for t in texts]
        self._learn(set().union(*split))
        get = self.held.__getitem__
        return [b"".join(map(get, words)) for words in split]


_HELD: dict[tuple[str, int], WordIds] = {}  # for the life of a Python worker, so later tasks find the words of earlier ones


def held_word_ids(path: str, most: int) -> WordIds:
    if (path, most) not in _HELD:
        _HELD[path, most] = WordIds(path, most)
    return _HELD[path, most]


def _capacities(tokens: int, capacity: int) -> np.ndarray:
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1], dtype=np.int64)


def deal(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every place of every document once."""
    room = _capacities(int(lengths.sum()), capacity)
    used, cost = np.zeros(len(room), dtype=np.int64), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    heap: list[tuple[int, int, int]] = []
    whole = 0
    for doc, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= capacity:
            out.append((doc, start, capacity, whole, 0))
            start, whole = start + capacity, whole + 1
        if start < length:
            heap.append((start - length, doc, start))
    used[:whole] = room[:whole]
    open_from = whole
    heapq.heapify(heap)
    left, price = room[open_from:] - used[open_from:], cost[open_from:]
    while heap:
        need, doc, start = heapq.heappop(heap)
        need = -need
        fits = left >= need
        if fits.any():
            k, take = int(np.where(fits, price, np.inf).argmin()), need
        else:
            k = int(left.argmax())
            take = int(left[k])
            heapq.heappush(heap, (take - need, doc, start + take))
        k += open_from
        out.append((doc, start, take, k, int(used[k])))
        used[k] += take
        left[k - open_from] -= take
        price[k - open_from] += linear * take + quadratic * take * take
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 2,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    block_tokens: int = 1 << 21,
    with_ids: bool = True,
    held_words: int = 300_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.
    ``held_words`` bounds what a worker remembers (some 200 bytes a word, twice that while it works): more memory, less tokenizing."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = held_word_ids(tokenizer, held_words), TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            pieces = sorted(deal(lengths, capacity, linear, quadratic), key=lambda p: (p[3], p[4]))
            doc, start, length, sequence, offset = np.array(pieces, dtype=np.int64).T
            own = [memoryview(ids[d])[4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [
                pa.array([keys[d] for d in doc], type=pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(x) for x in own], type=pa.int64()),
                pa.array(lengths[doc]),
                pa.array(first + sequence),
                pa.array(offset),
            ]
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), int(length.sum()), [None, pa.py_buffer(b"".join(own))])
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat))
            first += int(sequence.max()) + 1
            ids.clear(), keys.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in chunks(offsets, _AT_ONCE):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(a, b)]
                for key, own in zip(names[a:b], words.of(texts), strict=True):
                    ids.append(own + end)
                    keys.append(key)
                    held += len(ids[-1]) // 4
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()
        words.forget()  # the worker may serve other stages next

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, schema)
