"""Content-chosen runs of 50-byte windows: the sampling below the suffix sort.

Every window of `length` bytes has a mark, the smallest hash among its grams of `gram` bytes. The mark depends on the
window's bytes alone, so equal windows have equal marks wherever they are. Windows that follow each other and share a
mark form a run; a run's slice is its bytes. About one byte in sixteen starts a run."""

from __future__ import annotations

import numpy as np

from .common import mix64

GRAM, MOST_RUN = 20, 96
_MULT = np.uint64(0x5851F42D4C957F2D)
_VALUES = mix64(np.arange(300, 556, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of raw[i : i + gram] for every i, by doubling."""
    with np.errstate(over="ignore"):
        done, at, width, mult, have, step = None, 0, 1, _MULT, _VALUES[raw], 1
        while True:
            if gram & width:
                if done is None:
                    done, at = have.copy(), width
                else:
                    n = len(raw) - at - width + 1
                    done = done[:n] * mult + have[at : at + n]
                    at += width
            width *= 2
            if width > gram:
                return mix64(done)
            n = len(have) - step
            have = have[:n] * mult + have[step : step + n]
            mult, step = mult * mult, width


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width, have = 1, x
    while 2 * width <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return have if width == w else np.minimum(have[: len(x) - w + 1], have[w - width : w - width + len(x) - w + 1])


def runs(raw: np.ndarray, at: np.ndarray, length: int = 50, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, start in the text, windows in the run, mark) of all runs, in order of place."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none.astype(np.uint64))
    if len(raw) < length:
        return nothing
    gram = min(gram, length)
    marks = _sliding_min(_gram_hashes(raw, gram), length - gram + 1)
    size = np.diff(at)
    whole = np.flatnonzero(size >= length)
    edge = np.zeros(len(marks) + 1, np.int8)
    np.add.at(edge, at[:-1][whole], 1)
    np.add.at(edge, at[1:][whole] - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    begin = np.ones(len(marks), bool)
    begin[1:] = marks[1:] != marks[:-1]
    begin[at[:-1][whole]] = True
    begin &= valid
    lo = np.flatnonzero(begin)
    if not len(lo):
        return nothing
    text = np.searchsorted(at, lo, side="right") - 1
    stop = np.minimum(np.append(lo[1:], len(marks)), at[text + 1] - length + 1)
    many = stop - lo
    if many.max() > MOST_RUN:  # a mark that stays for long, as in a text of one character
        parts = -(-many // MOST_RUN)
        rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, stop, text = np.repeat(lo, parts) + rank * MOST_RUN, np.repeat(stop, parts), np.repeat(text, parts)
        many = np.minimum(stop - lo, MOST_RUN)
    return text, lo - at[text], many, mix64(marks[lo])  # smallest hashes are small numbers; mixed, they spread over buckets


def marks_at(raw: np.ndarray, starts: np.ndarray, length: int = 50, gram: int = GRAM) -> np.ndarray:
    """The marks of the windows that begin at the places."""
    gram = min(gram, length)
    h = _gram_hashes(raw, gram)
    out = h[starts]
    for j in range(1, length - gram + 1):
        np.minimum(out, h[starts + j], out=out)
    return mix64(out)
