"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor; composed with a transducer that makes exactly one edit (replace, insert or delete one code point) and with
the acceptor again, it accepts the pairs of near words. The composed machine is enumerated in partitions of its initial
states: a partition starts after a head, the first code points of both words, and makes its edit behind it. An edit inside
the head leaves the rest alike, so the same machines over reversed words find it: for a pair whose shorter word has L
code points, a head of k and a head from behind of k' with k + k' <= L miss no pair. Pairs that both find count once.

Machines are layered: a task's words of one length (and those one longer) are a trie whose equal rests are one state,
level by level from the end. A state knows how many words follow each arc, so a path ends in the place of its word, as in a
minimal perfect hash. The composition goes in three steps, each over whole layers: pairs of states that one edit can reach,
backwards those of them that reach an end together, then the paths that lead there.

Heads have three code points. Where more than ``cell_words`` words of a length share a head, it grows code point by code point, up to half of
the length; beyond that its words are cut into blocks and each pair of blocks is composed on its own. Small heads
share partitions by their hash. So no task gets a hot head whole, and no pair is lost.

Defined results: a null text has no words; a null doc_id counts as empty text in the hash; repeated rows count again; an
empty table has no words. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import runs, stored_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = 3
_BOTH, _LEFT, _RIGHT, _LONGER = 0, 1, 2, 3
_EMPTY = np.zeros(0, dtype=np.int64)


# ---- words


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31) -> DataFrame:
    """word, n: runs of letters with A-Z lowered, one code point deleted from those whose hash with the document's id ``damage`` divides."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    runs_ = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    runs_ = runs_.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    runs_ = runs_.select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    words = runs_.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# ---- machines


class Layers:
    """Minimised acceptor of sorted words of one length, a layer per code point. Of layer d: ``first`` (first arc of each state, and
    one beyond), ``symbol``, ``to`` (state in layer d + 1) and ``skip`` (words under the earlier arcs of the state) of each arc."""

    def __init__(self, words: np.ndarray) -> None:
        n, length = words.shape
        new = np.zeros((n, length + 1), dtype=bool)
        if n:
            new[0] = True
            np.logical_or.accumulate(words[1:] != words[:-1], axis=1, out=new[1:, 1:])
        self.first, self.symbol, self.to, self.skip = ([None] * length for _ in range(4))
        state, count = np.zeros(n, dtype=np.int64), np.ones(1, dtype=np.int64)  # state of each word's rest; words under each state
        rows = np.arange(n)  # one row for each node of the layer behind
        self.start = 0
        for d in range(length - 1, -1, -1):
            arcs = np.flatnonzero(new[:, d + 1])
            symbol = words[arcs, d].astype(np.int64)
            to = state[np.searchsorted(rows, arcs)]
            nodes = np.flatnonzero(new[:, d])
            begin = np.append(np.searchsorted(arcs, nodes), len(arcs))
            packed = ((to << 21) | symbol).astype("<i8")
            raw, seen, kept = packed.tobytes(), {}, []
            state = np.empty(len(nodes), dtype=np.int64)
            cuts = (begin * 8).tolist()
            for k in range(len(nodes)):
                own = raw[cuts[k] : cuts[k + 1]]
                at = seen.get(own)
                if at is None:
                    at = seen[own] = len(kept)
                    kept.append(k)
                state[k] = at
            kept = np.array(kept, dtype=np.int64)
            degree = begin[kept + 1] - begin[kept]
            first = np.concatenate([[0], np.cumsum(degree)])
            source = np.repeat(begin[kept] - first[:-1], degree) + np.arange(first[-1])
            self.first[d], self.symbol[d], self.to[d] = first, symbol[source], to[source]
            below = np.concatenate([[0], np.cumsum(count[to[source]])])
            self.skip[d] = below[:-1] - np.repeat(below[first[:-1]], degree)
            count, rows = below[first[1:]] - below[first[:-1]], nodes

    def arcs(self, d: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states: which state of the list, which arc of the layer."""
        first = self.first[d]
        degree = first[states + 1] - first[states]
        total = np.cumsum(degree)
        which = np.repeat(np.arange(len(states)), degree)
        return which, np.arange(len(which)) - np.repeat(total - degree, degree) + np.repeat(first[states], degree)


def _same_symbol(p: Layers, d: int, states: np.ndarray, q: Layers, e: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of states: which pair, arc of p and arc of q of equal symbol."""
    which, arc = p.arcs(d, states)
    first, symbol = q.first[e], q.symbol[e]
    keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 21 | symbol  # sorted: arcs lie by state and symbol
    wanted = others[which] << 21 | p.symbol[d][arc]
    found = np.searchsorted(keys, wanted)
    hit = np.flatnonzero((found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == wanted)) if len(keys) else _EMPTY
    return which[hit], arc[hit], found[hit]


def near_pairs(u: np.ndarray, v: np.ndarray, head: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in u, in v) of all words that an edit makes of each other behind the head of u's word. ``u``, ``v``: sorted words of one
    length, v's equal to u's or one longer. ``same``: both are the same words, each pair comes once."""
    length, extra = u.shape[1], v.shape[1] - u.shape[1]
    none = (_EMPTY, _EMPTY)
    if not len(u) or not len(v) or (same and len(u) < 2):
        return none
    p, q = Layers(u), (Layers(v) if not same else None)
    q = q or p
    # paths without an edit so far, as states and as places of the first word behind; every edit that a path can make
    at_p, at_q, low_u, low_v = (np.zeros(1, dtype=np.int64) for _ in range(4))
    edits: list[tuple[np.ndarray, ...]] = []
    for d in range(length + extra):
        if not len(at_p):
            edits += [(_EMPTY,) * 4] * (length + extra - d)
            break
        inside = np.flatnonzero(head[low_u] <= d)
        if extra:  # one more code point in v
            which, arc = q.arcs(d, at_q[inside])
            src = inside[which]
            edits.append((at_p[src], q.to[d][arc], low_u[src], low_v[src] + q.skip[d][arc]))
        else:
            which, arc = p.arcs(d, at_p[inside])
            src = inside[which]
            again, other = q.arcs(d, at_q[src])
            src, arc = src[again], arc[again]
            unlike = q.symbol[d][other] > p.symbol[d][arc] if same else q.symbol[d][other] != p.symbol[d][arc]
            src, arc, other = src[unlike], arc[unlike], other[unlike]
            edits.append((p.to[d][arc], q.to[d][other], low_u[src] + p.skip[d][arc], low_v[src] + q.skip[d][other]))
        if d == length:
            break
        which, arc, other = _same_symbol(p, d, at_p, q, d, at_q)
        at_p, at_q = p.to[d][arc], q.to[d][other]
        low_u, low_v = low_u[which] + p.skip[d][arc], low_v[which] + q.skip[d][other]
    # pairs of states behind an edit; layer d of u meets layer d + extra of v. An edit at d comes out at d (insert) or d + 1
    after = 0 if extra else 1
    pairs: list[np.ndarray] = []
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    carried = np.zeros(0, dtype=np.int64)
    for d in range(length + 1):
        own = edits[d - after] if 0 <= d - after < len(edits) else (_EMPTY,) * 4
        codes = np.unique(np.concatenate([carried, own[0] << 32 | own[1]]))
        pairs.append(codes)
        if d == length:
            break
        which, arc, other = _same_symbol(p, d, codes >> 32, q, d + extra, codes & 0xFFFFFFFF)
        carried = p.to[d][arc] << 32 | q.to[d + extra][other]
        steps.append((which, arc, other, carried))
    alive = [None] * (length + 1)
    alive[length] = pairs[length]
    for d in range(length - 1, -1, -1):
        which, _, _, to = steps[d]
        alive[d] = pairs[d][np.unique(which[np.isin(to, alive[d + 1])])]
    # the paths
    code, left, right = _EMPTY, _EMPTY, _EMPTY
    for d in range(length + 1):
        own = edits[d - after] if 0 <= d - after < len(edits) else (_EMPTY,) * 4
        fresh = own[0] << 32 | own[1]
        good = np.isin(fresh, alive[d])
        code, left, right = np.concatenate([code, fresh[good]]), np.concatenate([left, own[2][good]]), np.concatenate([right, own[3][good]])
        if d == length or not len(code):
            continue
        which, arc, other = _same_symbol(p, d, code >> 32, q, d + extra, code & 0xFFFFFFFF)
        to = p.to[d][arc] << 32 | q.to[d + extra][other]
        good = np.isin(to, alive[d + 1])
        which, arc, other = which[good], arc[good], other[good]
        code, left, right = to[good], left[which] + p.skip[d][arc], right[which] + q.skip[d + extra][other]
    both = np.unique(left * len(v) + right)  # an insert into a run of equal code points has several paths
    return both // len(v), both % len(v)


# ---- partitions


def _matrix(words: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: of each of its words the number of near words found, the largest n of one and the first word that has it."""
    for t, at in runs(batches, ["length", "turned", "bundle", "i", "j"]):
        words, n, side = t.column("s").combine_chunks(), t.column("n").to_numpy(), t.column("side").to_numpy()
        length, turned = t.column("length").to_numpy(), t.column("turned").to_numpy()
        head, front = t.column("head").to_numpy().astype(np.int64), t.column("front").to_numpy().astype(np.int64)
        left, right = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            size, own = int(length[a]), side[a:b]
            u_at = np.flatnonzero(own <= _LEFT) + a
            u = _matrix(words.take(pa.array(u_at)), size)
            for kind in ((_BOTH,), (_RIGHT,), (_LONGER,)):
                same, extra = kind == (_BOTH,), int(kind == (_LONGER,))
                v_at = np.flatnonzero(np.isin(own, kind)) + a
                if not len(v_at) or not len(u_at):
                    continue
                v = u if same else _matrix(words.take(pa.array(v_at)), size + extra)
                x, y = near_pairs(u, v, head[u_at], same)
                if turned[a] and len(x):  # those alike in the head in front are found there
                    k = front[u_at[x]]
                    apart = np.zeros(len(x), dtype=bool)
                    for d in range(int(k.max())):
                        apart |= (d < k) & (u[x, size - 1 - d] != v[y, size + extra - 1 - d])
                    x, y = x[apart], y[apart]
                left.append(u_at[x]), right.append(v_at[y])
        x, y = np.concatenate([*left, *right] or [_EMPTY]), np.concatenate([*right, *left] or [_EMPTY])
        if not len(x):
            continue
        own = [w[::-1] if r else w for w, r in zip(words.to_pylist(), turned.tolist(), strict=True)]
        # by word, then the largest n, then code-point order of the near word
        order = np.lexsort((np.unique([own[k] for k in y.tolist()], return_inverse=True)[1], -n[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([own[k] for k in x[first].tolist()]),
                pa.array(np.diff(np.append(first, len(x)))),
                pa.array(n[y[first]]),
                pa.array([own[k] for k in y[first].tolist()]),
            ],
            names=["word", "near", "top_n", "top"],
        )


def _grown(base: DataFrame, s: str, k: str, limit: Column, cell_words: int) -> DataFrame:
    """Heads that too many words share grow by a code point, as often as it takes and the limit allows."""
    size = _HEAD
    while True:
        sharing = base.filter((F.col(k) == size) & (limit > size)).groupBy("length", F.substring(s, 1, size).alias("hot_head"))
        hot = stored_table(sharing.agg(F.count("*").alias("hot_n")).filter(F.col("hot_n") > cell_words).drop("hot_n"), "hot-heads")
        if hot.isEmpty():
            return base
        hot = hot.withColumnRenamed("length", "hot_length")
        meets = (F.col("length") == F.col("hot_length")) & (F.substring(s, 1, size) == F.col("hot_head")) & (F.col(k) == size) & (limit > size)
        grown = base.join(hot, meets, "left").withColumn(k, F.when(F.col("hot_head").isNull(), F.col(k)).otherwise(size + 1))
        base = grown.select(*base.columns)
        size += 1


def _partitions(words: DataFrame, cell_words: int) -> DataFrame:
    """Rows for the tasks: each word by the length it has and by the one before it, in both directions, in every block pair it is part of."""
    size = F.char_length("word")
    roles = F.explode(F.array(F.struct(size.alias("length"), F.lit(False).alias("longer")), F.struct((size - 1).alias("length"), F.lit(True).alias("longer"))))
    base = words.select("word", F.reverse("word").alias("turned_word"), "n", roles.alias("role")).select("word", "turned_word", "n", "role.*")
    base = base.withColumns({"front": F.lit(_HEAD), "back": F.lit(_HEAD)})
    half = F.floor(F.col("length") / 2).cast("int")
    base = base.filter(F.col("length") >= 2 * _HEAD)  # below the shortest words: only longer ones, no pair
    base = _grown(base, "word", "front", half, cell_words)
    base = _grown(base, "turned_word", "back", F.col("length") - half, cell_words)
    ways = F.explode(
        F.array(
            F.struct(F.lit(False).alias("turned"), F.col("word").alias("s"), F.col("front").alias("head")),
            F.struct(F.lit(True).alias("turned"), F.col("turned_word").alias("s"), F.col("back").alias("head")),
        )
    )
    rows = base.select("length", "longer", "n", "front", ways.alias("w")).select("length", "longer", "n", "front", "w.*")
    rows = stored_table(rows.withColumn("cell", F.xxhash64(F.substring(F.col("s"), F.lit(1), F.col("head")), "head")), "heads")
    cell = ["length", "turned", "cell"]
    # partitions for the small cells of a length, and blocks for those that stay large
    lengths = rows.groupBy("length").agg(F.ceil(F.count("*") / (2 * cell_words)).alias("bundles"))
    large = rows.groupBy(*cell).agg(F.ceil(F.count("*") / cell_words).alias("blocks")).filter("blocks > 1")
    dealt = rows.join(lengths, "length").join(stored_table(large, "large-cells"), cell, "left")
    dealt = dealt.withColumn("bundle", F.when(F.col("blocks").isNull(), F.pmod(F.col("cell"), F.col("bundles"))).otherwise(F.col("cell")))
    blocks = F.coalesce("blocks", F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("s", F.lit(5)), blocks).cast("int")
    dealt = dealt.withColumns({"block": block, "blocks": blocks})
    others = F.sequence(F.lit(0), F.col("blocks") - 1)

    def place(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    own = F.transform(others, lambda o: place(F.col("block"), o, F.when(o == F.col("block"), _BOTH).otherwise(_LEFT)))
    lent = F.transform(F.filter(others, lambda o: o < F.col("block")), lambda o: place(o, F.col("block"), F.lit(_RIGHT)))
    longer = F.transform(others, lambda o: place(o, F.col("block"), F.lit(_LONGER)))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("longer"), longer).otherwise(F.concat(own, lent))))
    return dealt.select("length", "turned", "bundle", "place.*", "s", "n", "head", "front")


def near_words(words: DataFrame, cell_words: int = 20_000) -> DataFrame:
    """word, n_near, top, top_n: how many words are one edit away, and the most frequent of them (ties: the first)."""
    keys = ["length", "turned", "bundle", "i", "j"]
    rows = _partitions(words, cell_words).repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "s")
    found = rows.mapInArrow(_composed, "word string, near long, top_n long, top string")
    best = F.min_by("top", F.struct((-F.col("top_n")).alias("less"), "top"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top"), F.max("top_n").alias("top_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word that has a form, over forms of forms to the last. Pointers double, so rounds grow with the log of the longest way."""
    now = stored_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored_table(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31, ratio: int = 10, cell_words: int = 20_000) -> DataFrame:
    """One row per word: word, n, n_near, form (its most frequent near word, if ``ratio`` times as frequent), form_n, root."""
    if least_length < 2 * _HEAD + 1:
        raise ValueError(f"heads of {_HEAD} code points from both sides need words of at least {2 * _HEAD + 1}")
    words = stored_table(vocabulary(docs, least_length, least_count, damage), "words")
    near = words.join(near_words(words, cell_words), "word", "left")
    strong = F.col("top_n") >= ratio * F.col("n")
    near = stored_table(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("top")).alias("form"), F.when(strong, F.col("top_n")).alias("form_n")),
        "near-words",
    )
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
