"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re


def repeated(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    low: dict[bytes, int] = {}
    docs = [(i, (t or "").encode()) for i, t in rows]
    for i, t in docs:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            low[w] = min(low.get(w, i), i)
    out = {}
    for i, t in docs:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if low[t[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def shingles(text: str | None, k: int) -> set:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows: list[tuple[int, str | None]], k: int, num: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for g in by.values() for a in g for b in g if a < b}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
