"""Token files, alignment of tokenizers and spelling variants against plain versions."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import aligned, spelling
from conftest import odd_rows
from pyspark.sql import functions as F

from tidewatch.llm import alignment, variants
from tidewatch.llm.packing import WordIds
from tidewatch.llm.queries import llm_queries, tokenizer
from tidewatch.llm.tokenfiles import digests, find_documents, read_token_ids, token_range, write_token_ids


def _plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# ---- token files


@pytest.fixture(scope="module")
def files(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    write_token_ids(odd, path, tokenizer())
    return path


def test_token_files_hold_every_row_in_order(spark, files):
    rows = sorted(digests(spark, files).collect(), key=lambda r: r["start"])
    want = odd_rows()
    crc = sorted((str(r[0]), len(i), _crc(i)) for r, i in zip(want, _plain_ids([r[1] for r in want]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == crc
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is None, i))
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    whole = {r["start"]: r["ids"] for r in read_token_ids(spark, files).collect()}
    assert all(_crc(whole[r["start"]]) == r["ids_crc32"] for r in rows)


def test_token_files_find_documents_and_places(spark, files):
    everything = sorted(read_token_ids(spark, files).collect(), key=lambda r: r["start"])
    found = find_documents(spark, files, [1, 11, 999])
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 1, 11]
    assert "In(doc_id" in found._jdf.queryExecution().toString() and find_documents(spark, files, [999]).count() == 0
    flat = [i for r in everything for i in r["ids"]]
    for first, last in [(0, 1), (10, 90), (60, 61), (0, len(flat)), (len(flat) - 5, len(flat) + 9), (len(flat), len(flat) + 1)]:
        got = sorted(token_range(spark, files, first, last).collect(), key=lambda r: r["start"])
        assert [i for r in got for i in r["ids"]] == flat[first:last]
        assert all(flat[r["start"] : r["start"] + len(r["ids"])] == r["ids"] for r in got)


def test_token_files_of_nothing_and_of_one_hot_id(spark, empty, tmp_path):
    write_token_ids(empty, str(tmp_path / "none"), tokenizer())
    assert digests(spark, str(tmp_path / "none")).count() == 0 and token_range(spark, str(tmp_path / "none"), 0, 9).count() == 0
    rows = [(None if i % 3 else 7, f"wort {i % 50}") for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would be one part
    write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "hot"), tokenizer())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = digests(spark, str(tmp_path / "hot")).collect()
    assert len(got) == 6000 and len({r["start"] for r in got}) == 6000
    parts = spark.read.orc(str(tmp_path / "hot" / "ids")).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 2500  # neither id came to one task
    assert sum(r["n_tokens"] for r in got) == sum(map(len, _plain_ids([t for _, t in rows])))


def test_row_groups_without_an_id_are_not_read(spark, tmp_path):
    path = str(tmp_path / "pruned")
    docs = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a few words").alias("text"))
    write_token_ids(docs.repartition(5), path, tokenizer())

    def rows_read(doc_id):
        found = spark.read.orc(f"{path}/ids").filter(F.col("doc_id") == doc_id)
        n = len(found.collect())
        return n, found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert rows_read(30_000) == (1, 1000)  # the one row group by its minimum and maximum
    missing = [rows_read(k) for k in range(20_001, 20_061, 2)]
    assert all(n == 0 for n, _ in missing) and sum(read == 0 for _, read in missing) > 20  # inside the range: by the Bloom filter


def test_a_tokenizer_that_is_not_word_wise_gets_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = WordIds(path)
    text = "Two  words\nand MORE"
    assert not words.word_wise and WordIds(tokenizer()).word_wise
    assert np.frombuffer(words.of([text.encode()])[0], dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# ---- alignment

ODD_TEXTS = [
    "plain words, and  two   spaces",
    " starts with a space",
    "\nline\n\n  indented\tand tab \n",
    "nbsp here wide  \n x",
    "▁ already a piece mark",
    "<s> </s> <unk> <|endoftext|> <0x41> text",
    "emoji 😀👩‍👩‍👧 é ﬁ Ⅷ ½",
    "control \x00\x01\x1c\x1d\x85 chars \x0b\x0c\r\n",
    "   ",
    "x" * 500 + " " + "ab " * 300,
    "it's we'll I'M 123456 3.14",
    "中文字符 кириллица ελληνικά",
]


def _paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_alignment_equals_link_by_link(spark, odd, empty):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "pair": F.lit("x")}).repartition(3)
    for block_bytes in (8 << 20, 1):  # many blocks, too: counts are merged over them
        got = alignment.align_tokens(docs, *_paths(), block_bytes=block_bytes).collect()
        assert sorted(map(tuple, got), key=str) == sorted(aligned(rows), key=str)
    assert alignment.align_tokens(empty, *_paths()).count() == 0
    assert alignment.align_tokens(odd, *_paths()).count() == len(odd_rows())


def test_held_units_are_forgotten_and_tokenized_again():
    tokens = alignment.TokenPairs(*_paths(), most=5)
    assert tokens.unit_wise
    for text in ODD_TEXTS * 2:
        a, b = tokens.of([text])
        assert (a[0], b[0]) == tokens._plain([text])[0]
        assert len(tokens.held) <= 5 + len(text) and len(tokens.old) <= 5 + max(map(len, ODD_TEXTS))


def test_alignment_query_on_whole_documents(spark, sf):
    got = sorted(map(tuple, llm_queries()["op12_align_tokenizers"][0](spark, sf).collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(aligned([(r["doc_id"], r["text"]) for r in docs]))


# ---- spelling variants


def _edited(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abcäö")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :], word[:k] + c + word[k:]])


@pytest.mark.parametrize("cell_words", [3, 40, 20_000])
def test_variants_equal_all_edits(spark, odd, cell_words):
    rng = random.Random(4)
    # a hot head and a hot end, few letters so that runs of equal ones occur, and frequencies far apart
    stems = ["".join(rng.choice("aab") for _ in range(rng.randrange(6, 11))) for _ in range(60)] + ["gemeinsam" + "".join(rng.choice("ab") for _ in range(5)) + "lich" for _ in range(25)]
    words = stems + [_edited(rng, rng.choice(stems)) for _ in range(250)]
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words) for _ in range(30)) + (" Gemeinsamababalich" * 30 if k < 10 else " ÄÖGROSS äögross,Ägross")
        rows.append((None if k % 3 else k, text))
    rows += [(i, t) for i, t, *_ in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "run": F.lit("z")}).repartition(3)
    got = variants.spelling_variants(docs, cell_words=cell_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = spelling(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] is not None for w in want) > 5 and any(w[2] not in (w[0], w[1]) for w in want) or cell_words
    assert variants.spelling_variants(odd).count() >= 0


def test_variants_of_an_empty_table(spark, empty):
    assert variants.spelling_variants(empty).count() == 0


def test_roots_follow_long_ways(spark):
    ways = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [(f"v{i}", "w3") for i in range(20)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(ways, "word string, form string")).collect()}
    assert got == {w: "w9" for w, _ in ways}


def test_near_pairs_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        size, kinds = rng.randrange(3, 8), rng.choice(["ab", "abc"])
        u = sorted({"".join(rng.choice(kinds) for _ in range(size)) for _ in range(12)})
        for extra in (0, 1):
            v = u if not extra else sorted({"".join(rng.choice(kinds) for _ in range(size + 1)) for _ in range(12)})
            head = rng.randrange(0, 3)
            x, y = variants.near_pairs(*[np.array([[ord(c) for c in w] for w in s], dtype=np.uint32) for s in (u, v)], np.full(len(u), head), not extra)
            got = {(u[a], v[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
            if extra:
                want = {(a, b) for a in u for b in v if any(b[:k] + b[k + 1 :] == a for k in range(head, len(b)))}
            else:
                want = {(a, b) for a in u for b in v if a < b and sum(p != q for p, q in zip(a, b, strict=True)) == 1 and a[:head] == b[:head]}
            assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} and len(got) == len(x)


def test_alignment_tokenizes_on_its_own_core_only():
    """Threads for every core of the machine, in every worker, cost memory and time."""
    import subprocess
    import sys

    code = """
import os, public_tokenizers
from tidewatch.llm.alignment import TokenPairs
before = len(os.listdir("/proc/self/task"))
pairs = TokenPairs(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), 1000)
pairs.of([f"text {k} of many words, {k * k} in all" for k in range(500)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), *sys.path])}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.strip() == "0"


class _NotWalked(dict):
    def keys(self):
        raise AssertionError("what is held must be looked up, not gone through")


def test_tokenizers_look_held_words_up():
    texts = ["The end. the END, Äpfel! äpfel ÄPFEL... don't x1, ... (a) a", "the end?! The a, x1 ÄPFEL"]
    words, pairs = WordIds(tokenizer(), most=4), alignment.TokenPairs(*_paths(), most=4)
    plain, plain_pairs = WordIds(tokenizer()).tokenizer, alignment.TokenPairs(*_paths(), most=4)
    for _ in range(3):
        words.held, pairs.held = _NotWalked(words.held), _NotWalked(pairs.held)
        got = words.of([t.encode("utf-8") for t in texts])
        assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert [list(x) for x in zip(*pairs.of(texts))] == [list(x) for x in plain_pairs._plain(texts)]
