"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import functools
import hashlib

from lumenpick.llm.common import words_of
from lumenpick.llm.line_dedup import MIN_WORDS, within_one_edit


def lines_removed(rows, min_words=MIN_WORDS):
    """rows: (doc_id, text); the set of (doc_id, line number) that go."""
    lines = [(d, i, tuple(words_of(line))) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    first, by_variant = {}, {}
    for d, i, w in lines:
        first.setdefault(w, (d, i))
    for w in first:
        if len(w) < min_words:
            continue
        for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            by_variant.setdefault(v, []).append(w)
    gone = set()
    for d, i, w in lines:
        near = {w} if len(w) < min_words else {x for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for x in by_variant[v] if within_one_edit(list(w), list(x))}
        if any(first[x] < (d, i) for x in near if x != w) and first[w] == (d, i) or first[w] < (d, i):
            gone.add((d, i))
    return gone


def line_digest(rows, min_words=MIN_WORDS):
    gone = lines_removed(rows, min_words)
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [line for i, line in enumerate(lines) if (d, i) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def kept_text(rows, doc_id):
    """The text of a document without the lines that go; only for the documents of one row."""
    gone, text = _lines_removed(tuple(rows)), dict(rows)[doc_id]
    return None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if (doc_id, i) not in gone)


@functools.cache
def _lines_removed(rows):
    return lines_removed(rows)


def shingles(text, width):
    words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_components(rows, width, percent=80):
    """rows: (doc_id, text); (doc_id, set size, component, kept) of each, by an inverted index over shingles."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in index.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            index[x].append(k)
        for j, common in shared.items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                a, b = sorted((find(d), find(sets[j][0])))
                parent[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def passages(rows, window=50):
    """rows: (doc_id, text); (doc_id, words, words removed, SHA-256 of the rest) of each."""
    split = [(d, words_of(t)) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def neighbours(rows, k=20, step=20):
    """rows: (vec_id, vector of floats); (query, rank, vec_id, score) by exhaustive search in double precision."""
    import numpy as np

    ids = np.array([r[0] for r in rows], np.int64)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = []
    for i in np.flatnonzero(ids % step == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(order)]
    return sorted(out)
