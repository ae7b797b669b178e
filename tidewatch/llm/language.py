"""Language identification by interpolated Kneser-Ney character models, one per language.

A model holds, for every n-gram of its training text, the interpolated Kneser-Ney probability of the last
character after the others, in arrays sorted by hash; a context's back-off weight lies beside them. A text
belongs to the language with the lowest cross-entropy per character over the whole text. A limit per length, learned
from labelled texts kept out of the counts, says when even the best language is too poor a fit: the text is
then rejected. Limits are medians and quantiles of pieces of each length, without the texts whose label the model
contradicts, and aim at rejecting less than one in a hundred texts of a language.

Training is bounded: at most about ``sample_docs`` labelled documents per language, chosen by a hash of
their id, and of each at most ``sample_chars`` characters; a fifth of them calibrates. Everything else, so every
prediction, covers whole texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and rejected; an unlabelled
document is never trained on; where no labelled document exists nothing is learned, all texts are ``und`` and none is
rejected. Ties go to the language that sorts first. Repeated rows get the same answer each. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UNKNOWN = "und"
_PAD = "\x02"
_PIECE = 1 << 17
_BANDS = np.array([12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400])  # characters
_TAIL = 3.5  # a quarter of normal deviations exceed 1.15 sigma, so this is 4 sigma
_LEAST = 1.7  # texts in capitals or lists of one word are that much above the median and still of the language
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class SortedHashes:
    """Keys as a sorted array of 64-bit hashes, found through the place where each hash prefix begins."""

    def __init__(self, keys: np.ndarray) -> None:
        h = keys * _SPREAD
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(2**64 - 1))
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those that are not there."""
        h = keys * _SPREAD
        at = self.first[h >> self.shift]
        late = np.flatnonzero(self.hashes[at] < h)
        while len(late):
            at[late] += 1
            late = late[self.hashes[at[late]] < h[late]]
        at[(self.hashes[at] != h) | (at == len(self.hashes) - 1)] = -1
        return at


@dataclass
class _Order:
    grams: SortedHashes
    logs: np.ndarray  # log2 probability, gram x language
    contexts: SortedHashes
    weights: np.ndarray  # log2 back-off weight, context x language


def _codes(pieces: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c > 0xFFFF, (c & 0x7FFF) | 0x8000, c).astype(np.uint64)


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place as one number, last character in the lowest bits."""
    key = codes.copy()
    for k in range(1, order):
        key[k:] |= codes[:-k] << np.uint64(16 * k)
    return key


def _lower(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (16 * order)) - 1)


class Languages:
    """Kneser-Ney character models of several languages over one set of n-grams."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4) -> None:
        self.names, self.order = sorted(texts), order
        self.scale, self.limits = 8.0, None
        counts: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for name in self.names:
            held, seen = {}, []
            for text in texts[name]:
                codes = _codes([_PAD * (order - 1), text.lower()])
                seen.append(_grams(codes, order)[order - 1 :])
            keys, n = np.unique(np.concatenate([*seen, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            held[order] = keys, n
            for m in range(order - 1, 0, -1):  # below the top: in how many ways the gram is preceded
                keys, n = np.unique(_lower(keys, m), return_counts=True)
                held[m] = keys, n
            counts.append(held)
        self.orders: dict[int, _Order] = {}
        below = None
        for m in range(1, order + 1):
            union = np.unique(np.concatenate([c[m][0] for c in counts]))
            contexts = np.unique(union >> np.uint64(16))
            p, w = np.zeros((len(union), len(self.names))), np.zeros((len(contexts), len(self.names)))
            where = np.searchsorted(contexts, union >> np.uint64(16))
            for k, c in enumerate(counts):
                keys, n = c[m]
                own = np.zeros(len(union))
                own[np.searchsorted(union, keys)] = n
                once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
                discount = once / (once + 2 * twice) if once else 0.5
                total = np.bincount(where, weights=own, minlength=len(contexts))
                kinds = np.bincount(where, weights=own > 0, minlength=len(contexts))
                w[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                base = 1.0 / (len(union) + 1) if below is None else below[1][np.searchsorted(below[0], _lower(union, m - 1)), k]
                p[:, k] = np.where(total[where] > 0, np.maximum(own - discount, 0) / np.maximum(total[where], 1), 0) + w[where, k] * base
            grams, held = SortedHashes(union), SortedHashes(contexts)
            self.orders[m] = _Order(grams, np.log2(p[grams.order]).astype(np.float32), held, np.log2(w[held.order]).astype(np.float32))
            below = union, p
        self.unseen = -np.log2(float(len(np.unique(np.concatenate([c[1][0] for c in counts]))) + 1))

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each n-gram's last character, in each language."""
        out = np.zeros((len(keys), len(self.names)), dtype=np.float32)
        left = None
        for m in range(self.order, 0, -1):
            own = _lower(keys if left is None else keys[left], m)
            at, part = self.orders[m].grams.find(own), self.orders[m]
            hit = at >= 0
            if left is None:
                out[hit] = part.logs[at[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += part.logs[at[hit]]
                left = left[~hit]
            if not len(left):
                return out
            context = part.contexts.find(own[~hit] >> np.uint64(16))
            held = context >= 0
            out[left[held]] += part.weights[context[held]]
        out[left] += self.unseen
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the cross-entropy in bits per character; the number of characters."""
        total, n = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), dtype=np.int64)
        pieces, owners, sizes, held = [], [], [], 0
        context = self.order - 1

        def flush() -> None:
            nonlocal held
            codes = _codes(pieces)
            logs = self._logs(_grams(codes, self.order))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            for k in range(context):
                logs[starts + k] = 0
            np.add.at(total, owners, np.add.reduceat(logs, starts, axis=0, dtype=np.float64))
            pieces.clear(), owners.clear(), sizes.clear()
            held = 0

        for i, text in enumerate(texts):
            text = text.lower()
            n[i] = len(text)
            for at in range(0, len(text), _PIECE):
                piece = (_PAD * context if at == 0 else text[at - context : at]) + text[at : at + _PIECE]
                pieces.append(piece), owners.append(i), sizes.append(len(piece))
                held += len(piece)
                if held >= _PIECE:
                    flush()
        if pieces:
            flush()
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Fit the sharpness of the score, and per language how poor a fit of its own texts is still usual."""
        own, rest = [], []
        limits = np.zeros((len(self.names), len(_BANDS)))
        for k, name in enumerate(self.names):
            held = [t for t in texts.get(name, []) if t.strip()]
            bits, _ = self.bits(held)
            own += list(bits)
            rest += [k] * len(held)
            limits[k] = self._limits(k, [t for t, b in zip(held, bits, strict=True) if b.argmin() == k] or held)
        self.limits = limits
        if rest:
            b, k = np.array(own), np.array(rest)

            def loss(scale: float) -> float:
                z = -scale * (b - b.min(axis=1, keepdims=True))
                return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(k)), k]).mean())

            self.scale = min((1.0, 2.0, 4.0, 8.0, 16.0), key=loss)

    def _limits(self, k: int, texts: list[str]) -> np.ndarray:
        """Per length the bits a character that less than one text in a hundred of the language exceeds: the median and
        ``_TAIL`` times the deviation that a quarter exceed, so that less than a quarter of wrong labels can't lift it beyond reason, or ``_LEAST`` bits."""
        centre, wide, n = np.full(len(_BANDS), np.nan), np.full(len(_BANDS), np.nan), np.zeros(len(_BANDS))
        for m, size in enumerate(_BANDS):
            pieces = [t[at : at + size] for t in texts for at in sorted({0, len(t) // 2}) if len(t) - at >= size]
            if pieces:
                usual = self.bits(pieces)[0][:, k]
                centre[m], n[m] = np.median(usual), len(usual)
                wide[m] = np.quantile(np.abs(usual - centre[m]), 0.75)
        if not n.any():  # nothing as long as the shortest band
            usual = self.bits(texts)[0][:, k] if texts else np.array([4.0])
            centre[:], wide[:] = np.median(usual), 0.0
        have = np.flatnonzero(n >= min(20, n.max())) if n.any() else np.arange(len(_BANDS))
        logs = np.log(_BANDS)
        centre, wide = np.interp(logs, logs[have], centre[have]), np.interp(logs, logs[have], wide[have])
        return centre + np.maximum(_TAIL * wide, _LEAST + 4 / np.sqrt(_BANDS))

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, bits per character and whether the text is rejected."""
        lettered = np.array([next((True for c in t if c.isalpha()), False) for t in texts], dtype=bool)
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        bits, n = self.bits(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        score = 1 / np.exp(-self.scale * (bits - low[:, None])).sum(axis=1)
        poor, length = np.zeros(len(texts), dtype=bool), np.log(np.maximum(n, 1))
        for k in np.unique(best):
            own = best == k
            poor[own] = low[own] > np.interp(length[own], np.log(_BANDS), self.limits[k])
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0), np.where(n > 0, low, 0.0), poor | ~lettered


def train(
    docs: DataFrame, learn: Column, sample_docs: int = 400, sample_chars: int = 20_000, order: int = 4, text: str = "text", label: str = "lang", key: str = "doc_id"
) -> Languages:
    """Models from the labelled documents for which ``learn`` holds."""
    rows = docs.filter(learn & F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return _Nothing()
    # by id and text, so that rows without an id, or of one id, have draws of their own; rows that repeat both are one
    rows = rows.select(F.col(label).cast("string").alias(label), F.col(text).cast("string").alias(text), F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key))
    draw = F.pmod(F.xxhash64(key, text, F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample_docs / n))])
    picked = rows.select(F.col(label).cast("string").alias("label"), F.substring(F.col(text), 1, sample_chars).alias("text"), draw.alias("draw"))
    picked = picked.filter(F.col("draw") < share[F.col("label")]).distinct()
    fit: dict[str, list[str]] = {}
    check: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["label"], r["draw"], r["text"])):
        into = check if int(r["draw"] * (1 << 30)) % 5 == 0 and fit.get(r["label"]) else fit
        into.setdefault(r["label"], []).append(r["text"])
    for name in sizes:
        fit.setdefault(name, [])
    fit = {name: texts for name, texts in fit.items() if texts}
    if not fit:
        return _Nothing()
    model = Languages(fit, order)
    model.calibrate({name: check.get(name) or fit[name] for name in fit})
    return model


class _Nothing(Languages):
    """What is learned from no labelled document."""

    def __init__(self) -> None:
        self.names, self.order, self.orders, self.scale, self.limits = [], 1, {}, 1.0, None


def judged(docs: DataFrame, model: Languages, text: str = "text", into: str = "language") -> DataFrame:
    """The documents with a struct column: lang_pred, score, bits (per character), rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, bits double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for texts in batches:
                parts = [held.value.judge([t or "" for t in texts.iloc[a : a + 500]]) for a in range(0, len(texts), 500)]
                names = [x for p in parts for x in p[0]]
                score, bits, rejected = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2, 3))
                yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": score, "bits": bits, "rejected": rejected.astype(bool)})

    return docs.withColumn(into, judge(F.col(text).cast("string")))


def identified(docs: DataFrame, learn: Column | None = None, **options) -> DataFrame:
    """The documents that are not rejected, columns as given, ``lang`` being the language found."""
    model = train(docs, F.lit(True) if learn is None else learn, **options)
    into = next(n for n in ("language", *(f"language_{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns)
    kept = judged(docs, model, into=into).filter(~F.col(into)["rejected"])
    found = F.when(F.col(into)["lang_pred"] == UNKNOWN, F.col("lang")).otherwise(F.col(into)["lang_pred"])
    return kept.select(*[(found if c == "lang" else F.col(f"`{c}`")).alias(c) for c in docs.columns])
