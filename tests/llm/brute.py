"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


def shingle_set(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [x.lower() for x in w]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs, per_cent):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    ids, links = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= per_cent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= per_cent * (len(x) + len(y) - n):
                    links.append((a, b))
    root = components(ids, links)
    return {d: (len(sets[d]), root[d]) for d in ids}


def repeats(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of {doc_id: text}."""
    return {d: (n, removed, spans, hashlib.sha256(kept).hexdigest()) for d, (n, removed, spans, kept) in without_repeats(docs, window).items()}


def without_repeats(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, bytes that stay)} of {doc_id: text}."""
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        own, gone = [], np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            own.append(s)
            if s in seen:
                gone[i : i + window] = True
        seen.update(own)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        out[d] = (len(data), int(gone.sum()), len(edges) // 2, kept)
    return out


def vector_links(vectors, least):
    """{vec_id: (n_links, component)} of {vec_id: list or None}."""
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links, n, ids = [], defaultdict(int), sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    root = components(vectors, links)
    return {i: (n[i], root[i]) for i in vectors}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


EDGE, RANKS = "\x01", 400


def ngrams(text):
    """Counts of all 1-, 2- and 3-grams of letters, with one edge for anything between them and at both ends."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = EDGE + EDGE.join(runs) + EDGE
    return Counter(x for n in (1, 2, 3) for k in range(len(s) - n + 1) if (x := s[k : k + n]) != EDGE) if runs else Counter()


def _by_rank(counts):
    code = lambda x: sum(ord(c) << 21 * k for k, c in enumerate(x))
    return sorted(counts, key=lambda x: (-counts[x], code(x)))[:RANKS]


def language_profiles(labelled):
    """{lang: {n-gram: rank}} of (lang, text) pairs."""
    counts = defaultdict(Counter)
    for lang, text in labelled:
        if lang is not None and text is not None:
            counts[lang] += ngrams(text)
    return {lang: {x: k for k, x in enumerate(_by_rank(c))} for lang, c in counts.items()}


def language(text, profiles):
    """(language, score) by the least out-of-place distance."""
    counts = ngrams(text)
    top = _by_rank(counts)
    if not top or not profiles:
        return "und", 0.0
    places = defaultdict(list)
    for k, x in enumerate(top):
        places[counts[x]].append(k)
    mean = {n: sum(ks) / len(ks) for n, ks in places.items()}
    away = {lang: sum(min(RANKS, abs(p[x] - mean[counts[x]])) if x in p else RANKS for x in top) for lang, p in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (RANKS * len(top))
