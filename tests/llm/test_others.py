"""Embeddings, URLs, archives, the pipeline and the registered queries."""

import hashlib
import math
import os
import sys
from collections import Counter

import numpy as np
import pytest
from brute import classes, jaccard_links
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from compare import connect, differences  # noqa: E402

from tidewatch.llm import embeddings, urls, warc  # noqa: E402
from tidewatch.llm.queries import URL_RULES, llm_queries  # noqa: E402
from tidewatch.sources.storage import scratch_path, shared_dir  # noqa: E402


@pytest.mark.parametrize("name", [n for n, (_, sql) in llm_queries().items() if sql])
def test_matches_sql(spark, sf, name):
    build, sql = llm_queries()[name]
    assert differences(build(spark, sf), connect(sf), sql) == []


# ---- embeddings


@pytest.mark.parametrize("cell,block", [(2048, 1024), (40, 16)])
def test_cosine_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        x = centres[i % 12] + rng.normal(size=16) * (0.08 if i % 3 else 0.5)
        rows.append((i, x.astype(np.float32).tolist(), i % 2 if i % 29 else None))
    rows += [(300 + k, rows[4][1], rows[4][2]) for k in range(5)] + [(310, [2 * v for v in rows[4][1]], rows[4][2])]
    rows += [(320, None, 0), (321, [0.0] * 16, 0), (322, [float("nan")] + [1.0] * 15, 0), (323, [None] + [1.0] * 15, 0), (324, [1.0] * 3, 0), (325, [1.0] * 3, 0), (326, [], 0), (327, [math.inf] * 16, 0)]
    usable = {}
    for i, x, label in rows:
        if label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            usable[i] = (np.array(x, dtype=np.float64), label)
    links = []
    for i, (x, p) in usable.items():
        for j, (y, q) in usable.items():
            if i < j and p == q and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((i, j))
    n, of = Counter(v for p in links for v in p), classes([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("unit", "cell", "vec", "x", "copies")})
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.cosine_links(df, cell_vectors=cell).collect()}
    assert found == {r[0]: (n[r[0]], of[r[0]], of[r[0]] == r[0]) for r in rows} and len(links) > 300
    assert embeddings.cosine_links(df.limit(0)).count() == 0


def test_vectors_of_one_id_or_none_are_linked_on_their_own(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near_v, near_w, lone = [1.0, 0.01, 0.0], [0.01, 1.0, 0.0], [0.0, 0.0, 1.0]

    def found(rows):
        df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, label int")
        return sorted((tuple(r) for r in embeddings.cosine_links(df).collect()), key=str)

    assert found([(1, v), (1, w), (2, near_v), (3, near_w)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert found([(1, v), (1, near_v)]) == [(1, 1, 1, True), (1, 1, 1, True)]
    assert found([(None, v), (2, near_v), (None, lone)]) == sorted([(None, 1, 2, False), (2, 1, 2, True), (None, 0, None, True)], key=str)
    assert found([(None, v), (None, near_v), (5, None)]) == sorted([(None, 1, None, True)] * 2 + [(5, 0, 5, True)], key=str)


def test_vectors_are_stored_once_whatever_the_cells(spark):
    """Vectors that pivots can't tell apart reach every cell; none is written once for each cell or block. Few vectors of many labels share blocks."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 64)).astype(np.float32)
    x[1500:1600] = x[:100] + draw.normal(size=(100, 64)) * 0.05
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    for label in ([k % 500 for k in range(3000)], [0] * 3000):
        near = close & (np.array(label)[:, None] == np.array(label)[None, :])
        df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int")
        df.write.parquet(source := scratch_path(spark, "vectors"))
        before = set(os.listdir(shared_dir(spark)))
        found = {r["vec_id"]: r["n_links"] for r in embeddings.cosine_links(spark.read.parquet(source), cell_vectors=100).collect()}
        assert found == dict(enumerate(near.sum(axis=1).tolist())) and near.sum() >= 200
    new = [os.path.join(d, f) for n in set(os.listdir(shared_dir(spark))) - before for d, _, files in os.walk(os.path.join(shared_dir(spark), n)) for f in files]
    assert sum(map(os.path.getsize, new)) < 3 * x.nbytes


# ---- urls

URLS = [
    "http://a.example.net/en/1", "https://net/x", "http://example.net/en/", "http://x.example.com/de/7?q#f", "HTTPS://W.ORG/fr/é", "http://org", "ftp://b.org?x=/fr/",
    None, "", "no scheme", "http://", "://net/", "http://annet/", "http://user@net:80/", "http://a.net", "http://B.Example.NET/EN/1", "x://y://net/",
]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(URLS * 2)], "page_id long, url string, reads int")
    for r in urls.filter_urls(pages, URL_RULES).collect():
        host, path = _parts(URLS[r["page_id"] % len(URLS)])
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else r["verdict"]) and r["verdict"] in ("allow", "block") and (r["score"] is None) == bool(fits)
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


def _ratio(good, bad, text, order):
    """Witten-Bell by the book, all contexts kept."""
    alphabet = {c for t in (*good, *bad) for c in t}

    def model(texts):
        counts = {}
        for t in texts:
            padded = urls.START * order + t
            for i in range(order, len(padded)):
                for m in range(order + 1):
                    counts.setdefault(padded[i - m : i], Counter())[padded[i]] += 1

        def p(c, context):
            below = p(c, context[1:]) if context else 1 / (len(alphabet) + 1)
            seen = counts.get(context)
            return (seen[c] + len(seen) * below) / (seen.total() + len(seen)) if seen else below

        return p

    a, b, padded = model(good), model(bad), urls.START * order + text
    at = range(order, len(padded))
    return sum(math.log(a(padded[i], padded[i - order : i])) - math.log(b(padded[i], padded[i - order : i])) for i in at) / len(at)


def test_ratio_of_character_models(spark):
    good, bad = ["ab/cd0", "ab/ce", "zab"], ["spam/0", "spam/cd", "spa"]
    rows = [(t + urls.END, ok, 1) for ts, ok in ((good, True), (bad, False)) for t in ts]
    model = urls.train_ratio(spark.createDataFrame(rows, "reads string, accepted boolean, n long"), order=2, least=0.0)
    texts = [t + urls.END for t in ("ab/cd0", "spam", "qqq", "ab/spam/é", "")]
    found = {r["reads"]: r["score"] for r in urls.scored(spark.createDataFrame([(t,) for t in texts], "reads string"), *model, order=2).collect()}
    for t in texts:
        assert math.isclose(found[t], _ratio([x + urls.END for x in good], [x + urls.END for x in bad], t, 2), abs_tol=1e-9)


def test_threshold_splits_the_kinds(spark):
    rows = [(0.9, True, 5), (0.4, True, 5), (0.1, False, 9), (-3.0, False, 1)]
    assert 0.1 < urls.threshold(spark.createDataFrame(rows, "score double, accepted boolean, n long")) < 0.4


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    nasty = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    rows = [(1, "http://a/b?c", nasty), (2, "http://a b\r\nX: y", nasty), (3, None, "é" * 600), (4, "", None), (5, "u", ""), (6, "http://h", "é" * 600), (7, "v", "short"), (8, "v", "short"), (9, "z", nasty), (None, "n", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "bytes", "own", "keeper")})
    found = {r["page_id"]: tuple(r)[1:] for r in warc.archived(pages, file_bytes=4096).collect()}
    payload = {i: (h or "").encode() for i, _, h in rows}
    keeper = {1: 9, 2: 9, 3: 6}
    assert found == {
        i: (len(p), hashlib.sha1(p).hexdigest(), "revisit" if i in keeper else "response", keeper.get(i)) for i, p in payload.items()
    }
    assert warc.archived(pages.limit(0)).count() == 0
    warc.write_archives(pages, str(tmp_path / "plain"), compression=None)
    captures = warc.captures(warc.read_records(spark, str(tmp_path / "plain"))).collect()
    assert len(captures) == len(rows) and all(c["requests"] == c["metadatas"] == 1 and c["request"]["text"].startswith("GET /") for c in captures)


def test_repeated_keepers_give_no_row_twice(spark, tmp_path):
    rows = [(9, "k", "a" * 2000)] * 3 + [(9, "k", "b" * 2000), (1, "x", "a" * 2000), (2, "y", "a" * 2000), (2, "y", "b" * 2000), (5, "z", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect())
    assert found == Counter({(9, 2000, "response", None): 4, (1, 2000, "revisit", 9): 1, (2, 2000, "revisit", 9): 2, (5, 1, "response", None): 1})
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows) == records.select("id").distinct().count()


def test_a_cut_archive_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 500)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), compression=None)
    whole = max(((tmp_path / "w").glob("part-*")), key=lambda p: p.stat().st_size).read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0.txt").write_bytes(whole[: whole.index(b"xxxx") + 100])
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(tmp_path / "cut")).count()


# ---- pipeline


def test_pipeline_stages(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_copies", "mixture", "packing"]
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns and known.count() >= 0.98 * docs.count()
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    single = stages["near_copies"](spark, known, sf)
    of = classes(texts, jaccard_links(texts))
    assert {r["doc_id"] for r in single.collect()} == {i for i in texts if of[i] == i} and single.columns == docs.columns
    mix = stages["mixture"](spark, single, sf)
    assert mix.columns == docs.columns
    n = Counter(r["doc_id"] for r in mix.collect())
    assert max(n.values()) == 2
    pieces = stages["packing"](spark, mix, sf)
    assert pieces.filter("start = 0").count() == sum(n.values())
    assert stages["packing"](spark, stages["mixture"](spark, stages["near_copies"](spark, stages["language_id"](spark, empty, sf), sf), sf), sf).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as contract

    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in contract.queries()} and "pipeline" in contract.queries()
