"""Deep-shallow sorting of byte strings that start at given places of a buffer.

Shallow part: multikey quicksort. Its characters are eight-byte words. Every live segment picks the median of three words
as its pivot and is parted into smaller, equal and greater; only the equal part goes on to the next word. Parting is
done for all live segments at once with running counts, so a step costs a few passes over what still ties.

Deep part: segments whose strings agree in the first `shallow` bytes go into blind tries. A trie looks only at branching
bytes on the way down and compares with one leaf. The first insertions of all segments, into tries of one leaf, are done
at once; segments whose strings are all equal to their leaf need no more."""

from __future__ import annotations

import numpy as np

SHALLOW, WORD = 40, 8


def words_at(raw: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there as one number that orders as they do; places near the end see zeros."""
    padded = np.concatenate([raw, np.zeros(WORD, np.uint8)])
    return np.ndarray((len(raw) + 1,), ">u8", padded.data, strides=(1,))


class BlindTrie:
    """A trie of one segment: inner nodes know the place of the branching byte, leaves the strings that are equal."""

    __slots__ = ("raw", "length", "root")

    def __init__(self, raw: bytes, length: int, first: int):
        self.raw, self.length, self.root = raw, length, [None, [first], first]  # [children or None, leaf or depth, some string below]

    def insert(self, at: int) -> None:
        raw, node = self.raw, self.root
        while node[0] is not None:  # blind: only branching bytes count
            node = node[0].get(raw[at + node[1]]) or next(iter(node[0].values()))
        leaf, n = node[2], self.length
        mine, other = raw[at : at + n], raw[leaf : leaf + n]
        if mine == other:
            node[1].append(at)
            return
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if mine[:mid] == other[:mid]:
                lo = mid
            else:
                hi = mid
        depth, parent, node = lo, None, self.root
        while node[0] is not None and node[1] < depth:
            parent, node = node, node[0][raw[at + node[1]]]
        if node[0] is not None and node[1] == depth:
            node[0][mine[depth]] = [None, [at], at]
            return
        inner = [{other[depth]: node, mine[depth]: [None, [at], at]}, depth, at]
        if parent is None:
            self.root = inner
        else:
            parent[0][raw[at + parent[1]]] = inner

    def leaves(self) -> list[list[int]]:
        """Groups of equal strings in byte order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node[0] is None:
                out.append(node[1])
            else:
                todo += [node[0][c] for c in sorted(node[0], reverse=True)]
        return out


def _median(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _quicksort(words: np.ndarray, at: np.ndarray, length: np.ndarray, order: np.ndarray, new: np.ndarray, shallow: int) -> np.ndarray:
    """Multikey quicksort of the segments that `new` begins in `order`; returns the first places of segments that tie beyond
    `shallow` bytes. Word characters overlap at the end of a string: its last word is the last eight bytes."""
    n = len(order)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    depth = np.zeros(len(first), np.int64)
    deep: list[np.ndarray] = []
    while True:
        some = size > 1
        first, size, depth = first[some], size[some], depth[some]
        if not len(first):
            return np.concatenate(deep) if deep else np.zeros(0, np.int64)
        base = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(seg)) + (first - base)[seg]
        own = order[place]
        whole = length[order[first]]
        word = words[at[own] + np.maximum(np.minimum(depth, whole - WORD), 0)[seg]].astype(np.uint64)
        short = (whole < depth + WORD) & (whole < WORD)
        if short.any():  # strings of fewer than eight bytes: what follows them does not count
            cut = np.where(short, (WORD - whole) * 8, 0).astype(np.uint64)[seg]
            word = (word >> cut) << cut
        pivot = _median(word[base], word[base + size // 2], word[base + size - 1])[seg]
        less, equal = word < pivot, word == pivot
        n_less, n_equal = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(equal, base, dtype=np.int64)
        part = np.empty(len(seg), np.int64)
        for flag, start in ((less, base), (equal, base + n_less), (~(less | equal), base + n_less + n_equal)):
            rank = np.cumsum(flag) - flag
            to = rank - rank[base][seg] + start[seg]
            part[to[flag]] = np.flatnonzero(flag)
        order[place] = own[part]
        n_more = size - n_less - n_equal
        firsts = np.column_stack([first, first + n_less, first + n_less + n_equal]).ravel()
        sizes = np.column_stack([n_less, n_equal, n_more]).ravel()
        depths = np.column_stack([depth, depth + WORD, depth]).ravel()
        is_equal = np.tile([False, True, False], len(first))
        some = sizes > 0
        firsts, sizes, depths, is_equal = firsts[some], sizes[some], depths[some], is_equal[some]
        new[firsts] = True
        ends = is_equal & (depths >= length[order[firsts]])
        below = is_equal & ~ends & (depths >= shallow) & (sizes > 1)
        deep.append(firsts[below])
        live = ~(ends | below)
        first, size, depth = firsts[live], sizes[live], depths[live]


def sort(raw: np.ndarray, at: np.ndarray, length: int | np.ndarray, group: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings raw[at : at + length] within their groups, and for each place in this order whether it begins a
    new string. All strings must lie in the buffer; strings of a group have one length. Groups come in ascending order."""
    n = len(at)
    order, new = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, new
    length = np.full(n, length) if np.ndim(length) == 0 else np.asarray(length)
    new[0] = True
    if group is not None:
        order = np.argsort(group, kind="stable")
        new[1:] = group[order[1:]] != group[order[:-1]]
    words = words_at(raw)
    first = _quicksort(words, at, length, order, new, shallow)
    if not len(first):
        return order, new
    # deep: the first string of every segment is a trie of one leaf; all others of all segments are compared with theirs
    starts = np.flatnonzero(new)
    stop = np.append(starts, n)[np.searchsorted(starts, first) + 1]
    size = stop - first
    seg = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(seg)) + (first - (np.cumsum(size) - size))[seg]
    own, leaf, whole = order[place], order[first][seg], length[order[first]][seg]
    same = np.ones(len(seg), bool)
    for depth in range(shallow, int(whole.max()), WORD):
        open_ = np.flatnonzero(same & (whole > depth))
        d = np.minimum(depth, whole[open_] - WORD)
        same[open_] = words[at[own[open_]] + d] == words[at[leaf[open_]] + d]
    mixed = np.flatnonzero(np.bincount(seg, ~same) > 0)
    buffer = raw.tobytes() if len(mixed) else b""
    for s in mixed.tolist():
        places = np.arange(first[s], stop[s])
        members = order[places]
        where: dict[int, list[int]] = {}
        for m, p in zip(members.tolist(), at[members].tolist()):
            where.setdefault(p, []).append(m)
        keys = iter(where)
        trie = BlindTrie(buffer, int(length[members[0]]), next(keys))
        for p in keys:
            trie.insert(p)
        ordered, begins = [], []
        for equal in trie.leaves():
            begins.append(len(ordered))
            for p in equal:
                ordered += where[p]
        order[places] = ordered
        new[places[begins]] = True
    return order, new
