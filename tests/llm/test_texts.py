"""Operators on documents against plain versions, on odd rows and on a small table."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import classes, jaccard_links, lowered, words
from conftest import odd_rows
from pyspark.sql import functions as F

from tidewatch.llm import common, fingerprint, licenses, neardup, queries
from tidewatch.llm.language import Languages, identified, judged, train
from tidewatch.llm.mixing import assigned, mixed
from tidewatch.llm.packing import _capacities, deal, pack
from tidewatch.llm.scoring import Shape, Tree, score_texts, tenth_held_out
from tidewatch.llm.words import shingle_hashes, text_bytes, word_hashes

np.seterr(over="ignore")


# ---- helpers


def test_word_hashes_equal_exactly_for_equal_words():
    import pyarrow as pa

    texts = ["The cat", "", "cat\tTHE\x0bx", None, "é É", "a" * 3000 + " a"]
    data, offsets = text_bytes(pa.array(texts))
    h, start, end, first = word_hashes(data, offsets)
    found = [w for t in texts for w in words(t)]
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == found
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (h[i] == h[j]) == (lowered(a) == lowered(b))


def test_shingles_of_short_and_long_rows():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["a b c", "", "a b c d e f", "a b c d e"]))
    h, _, _, first = word_hashes(data, offsets)
    s, at = shingle_hashes(h, first, 5)
    assert np.diff(at).tolist() == [1, 0, 2, 1] and s[1] == s[3] and s[0] != s[1]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r["id"]: r["component"] for r in common.components(edges).collect()}
    assert found == classes({x for p in chain for x in p}, chain)
    assert common.components(edges.limit(0)).count() == 0


# ---- mixing


def _targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * level > 2 * sizes[n]}
        if not over:
            target |= {n: weight[n] * level for n in open_}
            break
        for n in over:
            target[n] = 2 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing_meets_targets(spark, odd):
    found = assigned(odd).collect()
    sizes = Counter()
    for _, text, _, source, _ in odd_rows():
        sizes[source] += len(words(text))
    target = _targets(sizes)
    assert len(found) == len(odd_rows())
    taken = Counter()
    by_id = {r[0]: r[3] for r in odd_rows()}
    for r in found:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], target[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_due"] is None or 0 <= r["first_due"] < 1)
        taken[source] += r["taken"]
    assert all(abs(taken[n] - target[n]) <= 1 for n in target)
    again = assigned(odd.repartition(7)).groupBy("doc_id").agg(F.sum("taken")).collect()
    assert sorted(map(str, again)) == sorted(map(str, assigned(odd).groupBy("doc_id").agg(F.sum("taken")).collect()))


def test_the_mix_has_the_words_taken_in_order(spark, odd, empty):
    mix = mixed(odd)
    assert mix.columns == odd.columns and mixed(empty).count() == 0 and assigned(empty).count() == 0
    taken = {r[0]: r[1] for r in assigned(odd).groupBy("doc_id").agg(F.sum("taken")).collect()}
    got = Counter()
    for r in mix.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == {k: v for k, v in taken.items() if v}


# ---- language model


def test_scores_against_counts(spark, odd, empty):
    shape = Shape(rows=1 << 10, own_classes=5, ending_classes=4)
    rows = score_texts(odd, tenth_held_out(), shape).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*words(lowered(t)), None]) for i, t, *_ in odd_rows()]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for i, ws in tokens:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        expected[i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert score_texts(empty, tenth_held_out(), shape).count() == 0
    untrained = score_texts(odd.filter("doc_id = 10"), F.lit(True), shape).first()
    assert untrained["n_known"] == 0 and untrained["train_tokens"] == 0 and math.isfinite(untrained["score"])


def test_the_model_beats_the_base_on_held_out_texts(spark, sf):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    r = score_texts(docs, tenth_held_out()).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_history_reaches_the_words_of_a_class(spark):
    """Both words have one ending, so one class, and one count: only the word before tells them apart."""
    texts = [f"{a} {b}ing" for a, b in (("left", "walk"), ("right", "talk"))] * 400
    docs = spark.createDataFrame([*enumerate(texts), (-1, "left walking"), (-2, "left talking")], "doc_id long, text string")
    rows = score_texts(docs, F.col("doc_id") < 0, Shape(rows=1 << 10, own_classes=0, ending_classes=4, word_rows=1 << 10)).filter("held_out").collect()
    of = {r["doc_id"]: r for r in rows}
    assert abs(of[-1]["base_score"] - of[-2]["base_score"]) < 1e-9 and of[-1]["score"] > of[-2]["score"] + 0.5


def test_choices_without_history_give_the_counts():
    counts, group = np.arange(1.0, 301.0), np.array([0] * 250 + [1] * 49 + [2])
    tree = Tree.of(counts, group)
    logs = tree.bias - np.log(np.exp(tree.bias).sum(axis=1, keepdims=True))
    for k in range(300):
        way = slice(tree.first[k], tree.first[k] + tree.depth[k])
        assert math.isclose(math.exp(logs[tree.nodes[way], tree.branches[way]].sum()), counts[k] / counts[group == group[k]].sum(), rel_tol=1e-4)


# ---- fingerprints


def _pieces(text):
    text = text or ""
    for mark in ".!?":
        text = text.replace(mark + " ", mark + "\n")
    return text.split("\n")


def _fingerprint(text):
    e, c = [0] * 4, [0] * 128
    for piece in _pieces(text):
        h = hashlib.md5(piece.encode()).hexdigest()
        w = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        for k in range(4):
            e[k] = (e[k] + w[k]) % 2**32
        for k in range(2):
            for i in range(32):
                for j in range(2):
                    c[64 * k + 2 * i + j] += w[2 * k + j] >> i & 1
    n = len(_pieces(text))
    return f"{n:08x}" + "".join(f"{x:08x}" for x in e) + "".join(f"{x % 65536:04x}" for x in c)


def test_fingerprints_of_odd_texts(spark, odd, empty):
    rows = fingerprint.edited_next(odd).collect()
    docs = sorted(((i, t or "") for i, t, *_ in odd_rows()), key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    expected = Counter()
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), _fingerprint(text), _fingerprint(edited)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.edited_next(empty).count() == 0
    one = fingerprint.edited_next(odd.filter("doc_id = 10")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_are_homomorphic(spark):
    texts = [(0, "a. b\nc"), (1, "c\nb\na."), (2, "a.\nb"), (3, "c")]
    made = fingerprint.fingerprints(spark.createDataFrame(texts, "id long, text string"), ["id"], "text")
    fp = {r["id"]: r["fp"] for r in made.collect()}
    assert fp[0] == fp[1] != fp[2]
    pair = made.alias("x").join(made.alias("y"), F.expr("x.id = 2 and y.id = 3")).select(fingerprint.combined(F.col("x.fp"), F.col("y.fp")).alias("s"))
    assert pair.first()["s"] == fp[0]
    less = made.alias("x").join(made.alias("y"), F.expr("x.id = 0 and y.id = 3")).select(fingerprint.without(F.col("x.fp"), F.col("y.fp")).alias("s"))
    assert less.first()["s"] == fp[2]


# ---- packing


def test_deal_covers_everything_once():
    rng = np.random.default_rng(3)
    for lengths in ([1], [4096], [8192, 1, 5], rng.integers(1, 9000, 300).tolist()):
        pieces = deal(np.array(lengths), 4096, 1.0, 1 / 2048)
        cover = {d: sorted((s, n) for e, s, n, _, _ in pieces if e == d) for d in range(len(lengths))}
        for d, parts in cover.items():
            assert [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) == lengths[d]
        room = _capacities(sum(lengths), 4096)
        filled = np.bincount([q for _, _, _, q, _ in pieces], weights=[n for _, _, n, _, _ in pieces], minlength=len(room))
        assert (filled == room).all() and all(x == 4096 or x & (x - 1) == 0 for x in room.tolist())


def test_packing_odd_texts(spark, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer())
    rows = pack(odd, queries.tokenizer()).collect()
    ids = Counter()
    for i, t, *_ in odd_rows():
        ids[i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    per_doc, used = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] == len(r["ids"])
        per_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (i, own), n in ids.items():
        covered = np.zeros(len(own), dtype=int)
        for start, part in per_doc[i, len(own)]:
            assert tuple(part) == own[start : start + len(part)]
            covered[start : start + len(part)] += 1
        assert (covered == n).all()
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert pack(empty, queries.tokenizer()).count() == 0


# ---- licences


def test_licence_scan_finds_planted_lines_only(spark, sf, odd, empty):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    planted = {"cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "proprietary": "All rights reserved."}
    expected = Counter()
    for r in docs.collect():
        for line in r["text"].split("\n"):
            for family, text in planted.items():
                expected[r["doc_id"], family] += line == text
    found = licenses.scan(docs).collect()
    assert Counter((r["doc_id"], r["family"]) for r in found if r["family"] != "unknown") == +expected
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].decode() == r["paragraph_text"] for r in found)
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


PLAIN = "The committee met on Tuesday and agreed on the plan for the new bridge over the river"
FILLER = ["\n".join(f"{PLAIN} number {i * 7 + k} {w}." for k, w in enumerate("see the notice of the use in a list".split())) for i in range(40)]


def test_all_five_notices_are_found(spark, sf):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    planted = {"cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "proprietary": "All rights reserved."}
    expected = Counter()
    for r in docs.collect():
        for n, line in enumerate(r["text"].split("\n")):
            for family, text in planted.items():
                expected[r["doc_id"], n, family] += line == text
    found = Counter((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(docs).collect())
    assert found == +expected and len({k[2] for k in found}) == 5


def test_standard_paragraphs_wrapped_or_not(spark):
    software = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    law = "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    texts = [f"{PLAIN}.\n\n{software}\n\n{PLAIN}.", law.replace("\n", " "), f"{PLAIN}.\n{law}\n{PLAIN}.", "All rights reserved.\nAll rights reserved."]
    found = {(r["doc_id"], r["paragraph"]): (r["family"], r["paragraph_text"]) for r in licenses.scan(_documents(spark, texts + FILLER)).collect()}
    assert found.pop((0, 2)) == ("mit", software) and found.pop((1, 0)) == ("apache", law.replace("\n", " "))
    assert found.pop((3, 0)) == found.pop((3, 1)) == ("proprietary", "All rights reserved.")
    (place, (family, text)), = found.items()
    assert place[0] == 2 and family == "apache" and law in text


# ---- languages


def test_probabilities_sum_to_one():
    model = Languages({"a": ["abcabcabd", "aab"], "b": ["zzyx abc"]}, order=3)
    letters = sorted({c for t in ("abcabcabd", "aab", "zzyx abc") for c in t})
    for before in ("ab", "zz", "qq", "\x02a"):
        logs = np.stack([model._logs(np.array([ord(c) | ord(before[1]) << 16 | ord(before[0]) << 32], dtype=np.uint64))[0] for c in [*letters, "ŋ"]])
        assert np.allclose((2.0**logs).sum(axis=0), 1, atol=1e-5)


def test_held_out_languages(spark, sf, odd, empty):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    third = common.remainder(F.col("doc_id"), 3)
    model = train(docs, third != 1)
    held = judged(docs.filter(third == 1), model).agg(F.avg(F.expr("cast(lang = language.lang_pred as int)")).alias("right"), F.avg(F.expr("cast(language.rejected as int)")).alias("gone")).first()
    assert held["right"] > 0.98 and held["gone"] < 0.01
    rows = judged(odd.drop("language"), model).select("doc_id", "text", "language.*").collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1 and (lettered or r["rejected"])
    assert judged(empty, model).count() == 0
    none = judged(odd, train(odd.filter("lang = 'xx'"), F.lit(True)), into="found").select("found.*").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0, 0.0, False)]


def test_wrong_labels_do_not_lift_the_limit(spark, sf):
    rows = common.documents(spark, sf.replace("sf0.001", "sf0.01")).filter("lang is not null and length(text) >= 400").orderBy("doc_id").collect()
    fit, check, fresh = {}, {}, {}
    for n, r in enumerate(rows):
        (fit, check, fresh)[0 if n % 5 < 3 else n % 5 - 2].setdefault(r["lang"], []).append(r["text"][:6000])
    rng = np.random.default_rng(6)
    random = lambda n: "".join(rng.choice(list("qxzjkvwyþðø#@[]{}|~^0123456789 "), n))
    greek = "και το δεν είναι για την από με που θα στο μια ότι αυτό "
    model = Languages(fit)
    model.calibrate({name: [*texts, *([random(6000)] * max(1, len(texts) // 20)), greek * 100] for name, texts in check.items()})
    for n in (100, 1000, 5000):
        assert model.judge([random(n), (greek * 100)[:n]])[3].all()
    for n in (100, 400, 6000):
        texts = [t[:n] for own in fresh.values() for t in own]
        assert np.mean(model.judge(texts)[3]) < 0.01


def test_long_texts_are_scored_in_pieces_as_a_whole(monkeypatch):
    from tidewatch.llm import language

    model = Languages({"a": ["abc abd abe " * 20], "b": ["xyz xyw " * 20]})
    text = "abc xyz abd " * 50
    whole = model.bits([text, "abe"])[0]
    monkeypatch.setattr(language, "_PIECE", 17)
    assert np.allclose(model.bits([text, "abe"])[0], whole, atol=1e-5)


def test_identified_keeps_columns(spark, odd, empty):
    kept = identified(odd)
    assert kept.columns == odd.columns and identified(empty).count() == 0
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 7, 10}


# ---- near copies


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_join_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(6):
        base = rng.choice(vocabulary, 120).tolist()
        for k in range(9):
            own = list(base)
            for at in rng.choice(len(own), k // 2, replace=False):
                own[at] = f"x{g}{k}{at}"
            texts[len(texts)] = " ".join(own)
    texts |= {100 + i: t for i, (_, t, *_) in enumerate(odd_rows())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = jaccard_links(texts)
    assert len(links) > 60
    n, of = Counter(x for p in links for x in p), classes(texts, links)
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in neardup.jaccard_join(docs).collect()}
    assert found == {i: (of[i], n[i], of[i] == i) for i in texts}


def test_one_of_each_keeps_columns_and_rows(spark, odd, empty):
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and neardup.one_of_each(empty).count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 9, 10, 11, None}


def test_one_row_of_each_class_whatever_the_ids(spark):
    words_of = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = words_of("a", 80) + " end"
    rows = [
        (1, words_of("a", 80)), (1, words_of("a", 80)), (1, words_of("b")), (1, words_of("b")), (2, near), (2, words_of("c")),
        (None, words_of("d", 80)), (None, words_of("d", 80)), (None, words_of("d", 80) + " end"), (None, words_of("b")), (7, words_of("e")), (None, words_of("e")),
        (None, words_of("f")), (8, None), (8, None), (9, words_of("c") + " \n"),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    kept = Counter((r["doc_id"], (r["text"] or "-").split()[0]) for r in neardup.one_of_each(docs).collect())
    assert kept == Counter({(1, "a0"): 1, (1, "b0"): 1, (2, "c0"): 1, (None, "d0"): 1, (7, "e0"): 1, (None, "f0"): 1, (8, "-"): 2})
    found = neardup.jaccard_join(docs)
    assert found.count() == len(rows) and found.filter("kept").count() == kept.total()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found.filter("doc_id = 2 or doc_id is null").collect()) == Counter(
        {(2, 1, 2): 1, (2, 2, 1): 1, (None, None, 2): 3, (None, 1, 2): 1, (None, 7, 1): 1, (None, None, 0): 1}
    )


def test_prefix_length_gives_the_recall():
    r = neardup.prefix_length(20, 5, 0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (r + 1)) ** 20
    with pytest.raises(ValueError):
        neardup.prefix_length(1, 5, 0.1, 0.9999)


def test_texts_shorten_their_prefixes_where_it_is_least_crowded():
    rng = np.random.default_rng(3)
    crowds = rng.integers(0, 4, (50, 20, 3)).cumsum(axis=2)[:, :, ::-1]
    crowds[0] = 0
    lengths = neardup.asked_lengths(crowds, 3, 0.8, 0.9999)
    missed = np.prod(1 - 0.8**lengths, axis=1)
    assert (missed <= 1e-4 * 1.000001).all() and (missed > 1e-4 * 0.4).all()
    assert lengths[0].tolist() == [4] * 10 + [5] * 10  # nothing crowded: in the order of the trees, no further than needed
    for own, crowd in zip(lengths.tolist(), crowds, strict=True):
        plain = [5] * 20
        while np.prod([1 - 0.8**k for k in plain]) > 1e-4:
            t = min((t for t in range(20) if plain[t] > 3), key=lambda t: (crowd[t, plain[t] - 4], -plain[t], t))
            plain[t] -= 1
        assert own == plain


@pytest.mark.parametrize("crowd", [64, 4])
def test_forest_recall_against_all_pairs(spark, monkeypatch, crowd):
    """Lone pairs of a similarity of 0.8 to 0.9, and a crowd that shares most of its words: at least 0.999 of links are found."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(400):
        base = [f"v{x}" for x in rng.integers(0, 5000, 150)]
        changed = list(base)
        for at in rng.choice(30, rng.integers(1, 4), replace=False):
            changed[5 * at] = f"y{g}"
        texts |= {2 * g: " ".join(base), 2 * g + 1: " ".join(changed)}
    shared = [f"s{x}" for x in range(150)]
    for k in range(120):
        own = list(shared)
        for at in rng.choice(30, rng.integers(0, 4), replace=False):
            own[5 * at] = f"z{k}"
        texts[1000 + k] = " ".join(own)
    links = jaccard_links(texts)
    n = Counter(x for p in links for x in p)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["n_links"] for r in neardup.jaccard_join(docs).collect()}
    assert all(found[i] <= n[i] for i in texts) and sum(found.values()) >= 0.999 * sum(n.values()) > 2000
