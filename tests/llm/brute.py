"""Plain single-process versions of what the operators compute, for small tables."""

from __future__ import annotations

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(ids, links):
    """Smallest id reachable from each id."""
    of = {i: i for i in ids}

    def top(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard_links(texts, threshold=0.8, width=5):
    """Linked pairs of a dict of texts, by an inverted index over all shingles."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for held in where.values():
        for p, a in enumerate(held):
            for b in held[p + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in shared.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def aligned(rows):
    """Per (doc_id, text): tokens of both tokenizers laid over the same bytes, link by link."""
    import hashlib

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printing} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printing)}

    def spans(ids, each):
        at, out = 0, []
        for i, x in zip(ids, each, strict=True):
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    documents, counts = [], {}
    for doc_id, text in rows:
        text = text or ""
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_each = [bytes(of[c] for c in a.id_to_token(i)) for i in a_ids]
        b_each = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        whole = (" " + text).encode()
        if not text or b"".join(a_each) != whole or b"".join(b_each) != whole:
            documents.append((doc_id, 0, 0, [], ""))
            continue
        x, y = spans(a_ids, a_each), spans(b_ids, b_each)
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, i, j, links = [], 0, 0, []
        for cut in cuts:
            p, q = i, j
            while i < len(x) and x[i][2] <= cut:
                i += 1
            while j < len(y) and y[j][2] <= cut:
                j += 1
            links += [(u, v) for u, s, e in x[p:i] for v, f, g in y[q:j] if s < g and f < e]
            groups.append(",".join(str(u) for u, _, _ in x[p:i]) + "|" + ",".join(str(v) for v, _, _ in y[q:j]))
        for pair in links:
            counts[pair] = counts.get(pair, 0) + 1
        documents.append((doc_id, len(x), len(y), links, ";".join(groups)))
    top = {}
    for (_, v), n in counts.items():
        top[v] = max(top.get(v, 0), n)
    return [
        (d, n_a, n_b, text.count(";") + 1 if text else 0, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for d, n_a, n_b, links, text in documents
    ]


def spelling(rows):
    """Per word: (word, form, root, n, n_near, form_n), by all single edits of each word."""
    import zlib
    from collections import Counter

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        edits |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near[w] = {x for x in edits if x in n and x != w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
