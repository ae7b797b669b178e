"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history). Classes are the end of a text, the most frequent words, one each, and
for all other words the hash of their last two letters. Both factors are maximum-entropy models. Features of the class factor are the word before, the two words
before (n-grams), the word before that alone (a skip) and a bias, hashed into a table of ``rows`` weight vectors; all
classes' weights stand side by side.

A class's words are the leaves of a tree of choices between 16 branches at most, Huffman's, so a frequent word takes few. The word factor is the
product of the choices on a word's way. Its features, the word before and the word before that alone, are hashed together with the choice into a table of
``word_rows`` weight vectors, one weight for each branch; a choice's bias is its optimum without history, the branches' counts. Words below one in 2**20 of all training tokens share a leaf of their class, within
which counts over all training texts decide, smoothed by 0.1 with one place for all words never seen.

Training reads every training text once. In each of ``rounds`` rounds, over a share of the documents drawn by hash of their id, every partition takes
gradient steps (AdaGrad) from the common weights on its own documents in mini-batches; each weight vector then moves by the mean of the partitions'
moves, weighted by how often they met it. Only sums of the table's size travel, and they are summed in two steps.

Counts cover all training words: they are summed per batch before they are shuffled. Words that make up at
least one in 2**20 of all tokens, so at most 2**20 words (16 bytes each), are broadcast; all others' counts are joined.

Defined results: a null text is an empty one and has just its end; without training texts all counts are 0 and the classes
equally likely. Rows that repeat are scored one by one. A null id counts as the text '' where documents are split. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import remainder, stored_table
from tidewatch.llm.language import SortedHashes
from tidewatch.llm.words import chunks, mixed, text_bytes, word_hashes

END = np.uint64(0x5851F42D4C957F2D)
SMOOTH = 0.1
_BATCH, _BLOCK = 8192, 1024
_CALM = 20  # squared gradients a weight is credited with before its first step: keeps rarely met weights small
_FAN = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_CALM = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class Shape:
    rows: int = 1 << 15
    own_classes: int = 15
    ending_classes: int = 16
    word_rows: int = 1 << 16

    @property
    def classes(self) -> int:
        return 1 + self.own_classes + self.ending_classes


@dataclass
class Tree:
    """The choices on the way to each leaf: those of leaf k are ``nodes`` and ``branches`` from ``first[k]`` on, ``depth[k]`` of them."""

    first: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    bias: np.ndarray  # choices x branches

    @classmethod
    def of(cls, counts: np.ndarray, group: np.ndarray) -> Tree:
        """One Huffman tree for the leaves of each group."""
        n = len(counts)
        mass, up, slot = counts.tolist(), [-1] * n, [0] * n  # choices follow the leaves
        order = np.argsort(group, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            heap = [(mass[k], k) for k in members.tolist()]
            heapq.heapify(heap)
            take = (len(heap) - 2) % (_FAN - 1) + 2  # so that all later choices are full
            while len(heap) > 1:
                own = [heapq.heappop(heap) for _ in range(take)]
                node, take = len(mass), _FAN
                mass.append(sum(m for m, _ in own)), up.append(-1), slot.append(0)
                for k, (_, child) in enumerate(own):
                    up[child], slot[child] = node, k
                heapq.heappush(heap, (mass[node], node))
        parent, branch, total = np.array(up, dtype=np.int64), np.array(slot, dtype=np.int8), np.array(mass)
        bias = np.full((max(len(mass) - n, 1), _FAN), -60, dtype=np.float32)
        inside = parent >= 0
        bias[parent[inside] - n, branch[inside]] = np.log(total[inside])
        at, depth, steps = np.arange(n), np.zeros(n, dtype=np.int32), []
        while (going := np.flatnonzero(parent[at] >= 0)).size:
            steps.append((going, (parent[at[going]] - n).astype(np.int32), branch[at[going]]))
            depth[going] += 1
            at[going] = parent[at[going]]
        first = np.concatenate([[0], np.cumsum(depth)[:-1]]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        nodes, branches = np.zeros(int(depth.sum()), dtype=np.int32), np.zeros(int(depth.sum()), dtype=np.int8)
        for k, (leaves, nodes_met, taken) in enumerate(steps):
            nodes[first[leaves] + k], branches[first[leaves] + k] = nodes_met, taken
        return cls(first, depth, nodes, branches, bias)


@dataclass
class Model:
    """What scoring needs besides the joined counts; all of it is bounded by the shape and by 2**20 frequent words."""

    shape: Shape
    own: np.ndarray  # sorted hashes of the words that are classes of their own
    own_class: np.ndarray
    weights: np.ndarray  # (rows + 1 block) x classes; the bias is the row after the features
    word_weights: np.ndarray  # word_rows x branches
    frequent: SortedHashes
    counts: np.ndarray  # of the frequent words, in the order of their hashes
    leaf: np.ndarray  # of the frequent words in the same order; -1 for those that are a class of their own
    rare_leaf: np.ndarray  # of each class; -1 where the class is one word
    tree: Tree
    class_cost: np.ndarray  # log10 of the smoothed number of training tokens of each class that no leaf of one word stands for

    def leaves(self, tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token among the frequent words and its leaf, both -1 where there is none."""
        at = self.frequent.find(tokens)
        if not len(self.leaf):
            return at, self.rare_leaf[classes]
        return at, np.where(at >= 0, self.leaf[np.maximum(at, 0)], self.rare_leaf[classes])

    def choices(self, contexts: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The choices on the ways to the leaves: whose they are, table rows of the features, choice and branch taken."""
        whose = np.flatnonzero(leaf >= 0)
        depth = self.tree.depth[leaf[whose]]
        ends = np.cumsum(depth)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.tree.first[leaf[whose]] - ends + depth, depth)
        whose, nodes = np.repeat(whose, depth), self.tree.nodes[at]
        shift = np.uint64(64 - (self.shape.word_rows.bit_length() - 1))
        rows = ((contexts[::2, whose] ^ mixed(nodes.astype(np.uint64) + np.uint64(1))) * _ODD >> shift).astype(np.int64)
        return whose, rows, nodes, self.tree.branches[at]


def _tokens(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, the class of each by its ending, and per text the offset of its first token."""
    words, start, end, first = word_hashes(data, offsets)
    last = end.copy()
    for _ in range(3):  # marks after a word are no ending
        last -= _MARK[data[last - 1]] & (last > start + 1)
    one = _LOWER[data[last - 1]].astype(np.uint64)
    two = np.where(last - 2 >= start, _LOWER[data[np.maximum(last - 2, 0)]], 0).astype(np.uint64)
    ending = (mixed(one * np.uint64(256) + two) % np.uint64(shape.ending_classes)).astype(np.int64) + 1 + shape.own_classes
    at = first[1:]
    return np.insert(words, at, END), np.insert(ending, at, 0), first + np.arange(len(first))


def _classes(tokens: np.ndarray, ending: np.ndarray, own: np.ndarray, own_class: np.ndarray) -> np.ndarray:
    if not len(own):
        return ending
    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
    return np.where(own[at] == tokens, own_class[at], ending)


def _contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the hashes of its features."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    before = np.zeros((2, len(tokens)), dtype=np.uint64)
    for k in range(2):
        before[k, k + 1 :] = tokens[: len(tokens) - k - 1]
        before[k, place <= k] = np.uint64(k + 1)
    bigram = mixed(before[0] + np.uint64(1))
    trigram = mixed(before[0] * np.uint64(0x9E3779B97F4A7C15) + before[1] + np.uint64(2))
    skip = mixed(before[1] + np.uint64(0x632BE59BD9B4E019))
    return np.stack([bigram, trigram, skip])


def _class_rows(contexts: np.ndarray, rows: int) -> np.ndarray:
    return (contexts >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.uint16 if rows <= 1 << 16 else np.uint32)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, axis=0, mode="clip")  # several times as fast as indexing by a list


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _rows(weights, rows[0])
    for r in rows[1:]:
        z += _rows(weights, r)
    z += bias
    z -= np.maximum.reduce(list(z.T))[:, None]
    return z


def _sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table rows met, the sum of each one's gradients and how often it was met."""
    key = np.sort((rows.astype(np.int64) << 24 | np.arange(len(g))).ravel())  # sorts faster than places by row
    held, at = key >> 24, key & ((1 << 24) - 1)
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    times = np.diff(np.append(starts, len(held)))
    sums = _rows(g, at[starts])
    more = times > 1
    if more.any():  # most are met once and need no sum
        ends = np.cumsum(times[more])
        sums[more] = np.add.reduceat(_rows(g, at[np.repeat(more, times)]), ends - times[more], axis=0)
    return held[starts], sums, times


def _steps(weights: np.ndarray, n_rows: int, rows: np.ndarray, classes: np.ndarray, squares: np.ndarray, met: np.ndarray, rate: float) -> None:
    """Gradient steps in place, mini-batch by mini-batch."""
    for a in range(0, rows.shape[1], _BATCH):
        own, truth = rows[:, a : a + _BATCH], classes[a : a + _BATCH]
        g = np.exp(_logits(weights, weights[n_rows], own))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(truth)), truth] -= 1
        whole = g.sum(axis=0)
        squares[n_rows] += whole * whole
        weights[n_rows] -= rate * whole / np.sqrt(_CALM + squares[n_rows])
        met[n_rows] += len(truth)
        for r in own:
            rows_met, sums, times = _sums(r, g)
            total = _rows(squares, rows_met) + sums * sums
            squares[rows_met] = total
            weights[rows_met] = _rows(weights, rows_met) - rate * sums / np.sqrt(_CALM + total)
            met[rows_met] += times


def _word_steps(model: Model, weights: np.ndarray, contexts: np.ndarray, leaf: np.ndarray, squares: np.ndarray, met: np.ndarray, rate: float) -> None:
    """Gradient steps of the word factor in place, mini-batch by mini-batch; a weight vector's branches share their step size."""
    for a in range(0, len(leaf), _BATCH):
        _, rows, nodes, branches = model.choices(contexts[:, a : a + _BATCH], leaf[a : a + _BATCH])
        n = len(nodes)
        if not n:
            continue
        g = np.exp(_logits(weights, _rows(model.tree.bias, nodes), rows))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(n), branches] -= 1
        rows_met, sums, times = _sums(rows, g)
        squares[rows_met] += np.einsum("ij,ij->i", sums, sums)
        weights[rows_met] = _rows(weights, rows_met) - sums * (rate / np.sqrt(_WORD_CALM + squares[rows_met]))[:, None]
        met[rows_met] += times


def _counting(shape: Shape, most: int = 4_000_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, endings, n = [], [], 0

        def flush() -> pa.RecordBatch:
            tokens, ending = np.concatenate(held), np.concatenate(endings)
            words, at, counts = np.unique(tokens, return_index=True, return_counts=True)
            held.clear(), endings.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts), pa.array(ending[at].astype(np.int32))], names=["word", "n", "ending"])

        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = text_bytes(batch.column(0))
                for a, b in chunks(offsets):
                    tokens, ending, _ = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shape)
                    held.append(tokens), endings.append(ending)
                    n += len(tokens)
                    if n >= most:
                        yield flush()
                        n = 0
            if held:
                yield flush()

    return count


def _training(held, rate: float):
    """A partition's moves of the common weights, as blocks of rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        weights, words = m.weights.copy(), m.word_weights.copy()
        squares, word_squares = np.zeros_like(weights), np.zeros(len(words), dtype=np.float32)
        met, word_met = np.zeros(len(weights), dtype=np.float32), np.zeros(len(words), dtype=np.float32)
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = text_bytes(batch.column(0))
                for a, b in chunks(offsets):
                    tokens, ending, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.shape)
                    contexts, classes = _contexts(tokens, first), _classes(tokens, ending, m.own, m.own_class)
                    _steps(weights, m.shape.rows, _class_rows(contexts, m.shape.rows), classes, squares, met, rate)
                    _word_steps(m, words, contexts, m.leaves(tokens, classes)[1], word_squares, word_met, rate)
        weights -= m.weights
        words -= m.word_weights
        context = TaskContext.get()
        moves = {}
        for table, times, at in ((weights, met, 0), (words, word_met, len(weights))):
            for k in range(0, len(table), _BLOCK):
                if times[k : k + _BLOCK].any():
                    moves[(at + k) // _BLOCK] = table[k : k + _BLOCK], times[k : k + _BLOCK]
        yield _moves(moves, context.partitionId() if context else 0)

    return learn


_MOVES = "block int, part int, moved binary, met binary"


def _moves(blocks: dict[int, tuple[np.ndarray, np.ndarray]], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(blocks), type=pa.int32()),
            pa.array([part] * len(blocks), type=pa.int32()),
            pa.array([m.astype(np.float16).tobytes() for m, _ in blocks.values()], type=pa.binary()),
            pa.array([t.tobytes() for _, t in blocks.values()], type=pa.binary()),
        ],
        names=["block", "part", "moved", "met"],
    )


def _moved(moved: bytes, met: bytes) -> tuple[np.ndarray, np.ndarray]:
    times = np.frombuffer(met, dtype=np.float32)
    return np.frombuffer(moved, dtype=np.float16).reshape(len(times), -1).astype(np.float32), times


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean moves of each block, weighted by how often its rows were met."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the model's size at most
    for batch in batches:
        for block, *own in zip(*(batch.column(c).to_pylist() for c in ("block", "moved", "met")), strict=True):
            m, t = _moved(*own)
            m *= t[:, None]
            total[block] = (total[block][0] + m, total[block][1] + t) if block in total else (m, t)
    if total:
        yield _moves({k: (m / np.maximum(t, 1)[:, None], t) for k, (m, t) in total.items()}, 0)


def _scoring(held):
    schema_names = ["doc_id", "held_out", "n_tokens", "known", "logs", "classes_log", "words", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                for a, b in chunks(offsets):
                    tokens, ending, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.shape)
                    contexts, classes = _contexts(tokens, first), _classes(tokens, ending, m.own, m.own_class)
                    rows = _class_rows(contexts, m.shape.rows)
                    at, leaf = m.leaves(tokens, classes)
                    logs = np.empty(len(tokens))
                    for p in range(0, len(tokens), _BATCH):
                        z = _logits(m.weights, m.weights[m.shape.rows], rows[:, p : p + _BATCH])
                        truth = classes[p : p + _BATCH]
                        logs[p : p + _BATCH] = z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1, dtype=np.float64))
                        whose, own, nodes, branches = m.choices(contexts[:, p : p + _BATCH], leaf[p : p + _BATCH])
                        z = _logits(m.word_weights, _rows(m.tree.bias, nodes), own)
                        z = z[np.arange(len(nodes)), branches] - np.log(np.exp(z).sum(axis=1, dtype=np.float64))
                        logs[p : p + _BATCH] += np.bincount(whose, z, minlength=len(truth))
                    logs /= np.log(10)
                    seen = at >= 0
                    count_log = np.where(seen, np.log10(m.counts[np.maximum(at, 0)] + SMOOTH), 0.0) if len(m.counts) else np.zeros(len(tokens))
                    # a leaf of one word leaves nothing to its count
                    logs -= np.where(seen & (leaf >= 0), count_log, m.class_cost[classes])
                    row = np.repeat(np.arange(b - a), np.diff(first))
                    # the words whose counts are joined: each once per text
                    rare = np.flatnonzero(~seen)
                    order = rare[np.lexsort((tokens[rare], row[rare]))]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (row[order][1:] != row[order][:-1])
                    places = np.flatnonzero(new)
                    times = np.diff(np.append(places, len(order)))
                    lists = np.concatenate([[0], np.cumsum(np.bincount(row[order[places]], minlength=b - a))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(a, b - a),
                            batch.column("held_out").slice(a, b - a),
                            pa.array(np.diff(first)),
                            pa.array(np.add.reduceat(seen.astype(np.int64), first[:-1])),
                            pa.array(np.add.reduceat(count_log, first[:-1])),
                            pa.array(np.add.reduceat(logs, first[:-1])),
                            pa.ListArray.from_arrays(pa.array(lists), pa.array(tokens[order[places]].view(np.int64))),
                            pa.ListArray.from_arrays(pa.array(lists), pa.array(times)),
                        ],
                        names=schema_names,
                    )

    return score


def train(docs: DataFrame, counts: DataFrame, learn: Column, shape: Shape, rounds: int, rate: float) -> tuple[Model, int, int]:
    """The model, with the number of tokens and of distinct tokens in training."""
    spark = docs.sparkSession
    end = int(END.astype(np.int64))
    top = counts.filter(F.col("word") != end).orderBy(F.desc("n"), "word").limit(shape.own_classes).select("word", "n", "ending").collect()
    own = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(own)
    own, own_class = own[order], (np.arange(len(own)) + 1)[order]
    tokens, kinds = np.zeros(shape.classes), np.zeros(shape.classes)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["ending"]], kinds[r["ending"]] = r["n"], r["v"]
    n_all, v_all = int(tokens.sum()), int(kinds.sum())
    for k, r in enumerate(top, 1):
        tokens[k], kinds[k] = r["n"], 1
        tokens[r["ending"]] -= r["n"]
        kinds[r["ending"]] -= 1
    frequent = counts.filter(F.col("n") >= max(1.0, n_all / (1 << 20))).select("word", "n", "ending").toArrow()
    hashes = SortedHashes(frequent.column("word").to_numpy().view(np.uint64))
    names, often, kind = (frequent.column(c).to_numpy()[hashes.order] for c in ("word", "n", "ending"))
    inside = (kind > 0) & ~np.isin(names.view(np.uint64), own)
    tokens -= np.bincount(kind[inside], often[inside], minlength=shape.classes)
    kinds -= np.bincount(kind[inside], minlength=shape.classes)
    mass = tokens + SMOOTH * (kinds + 1)
    several = np.arange(1 + shape.own_classes, shape.classes)
    leaf, rare_leaf = np.full(len(names), -1), np.full(shape.classes, -1)
    leaf[inside], rare_leaf[several] = np.arange(inside.sum()), inside.sum() + np.arange(len(several))
    tree = Tree.of(np.concatenate([often[inside] + SMOOTH, mass[several]]), np.concatenate([kind[inside], several]))
    weights, words = np.zeros((shape.rows + _BLOCK, shape.classes), dtype=np.float32), np.zeros((shape.word_rows, _FAN), dtype=np.float32)
    model = Model(shape, own, own_class, weights, words, hashes, often.astype(np.float64), leaf, rare_leaf, tree, np.log10(mass))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("round")), F.lit(rounds))
    for k in range(rounds):
        held = spark.sparkContext.broadcast(model)
        moves = docs.filter(learn & (draw == k)).select("text").mapInArrow(_training(held, rate), _MOVES)
        some = moves.repartition("block", F.col("part") % 16).mapInArrow(_summing, _MOVES)
        every = some.repartition("block").mapInArrow(_summing, _MOVES).collect()  # of the model's size
        weights, words = weights.copy(), words.copy()
        for r in every:
            moved, at = _moved(r["moved"], r["met"])[0], r["block"] * _BLOCK
            table, at = (weights, at) if at < len(weights) else (words, at - len(weights))
            table[at : at + len(moved)] += moved
        model = replace(model, weights=weights, word_weights=words)
        held.unpersist()
    return model, n_all, v_all


def score_texts(docs: DataFrame, held_out: Column, shape: Shape = Shape(), rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (the model). Documents that are
    not held out are trained on."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.filter(~held_out).select("text").mapInArrow(_counting(shape), "word long, n long, ending int")
    counts = stored_table(counts.groupBy("word").agg(F.sum("n").alias("n"), F.max("ending").alias("ending")), "counts")
    model, n_all, v_all = train(docs, counts, ~held_out, shape, rounds, rate)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _scoring(held), "doc_id long, held_out boolean, n_tokens long, known long, logs double, classes_log double, words array<long>, times array<long>"
    )
    rows = stored_table(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    rare = rare.join(counts.select("word", "n"), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    joined = rows.drop("words", "times").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs + F.col("classes_log")).alias("score"),
    )


def tenth_held_out() -> Column:
    return remainder(F.col("doc_id"), 10) == 0
