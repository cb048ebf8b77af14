import random

import numpy as np
import pytest

from sofra.llm import deep_shallow


def check(raw: bytes, at: list[int], length: list[int], group: list[int]):
    order, new = deep_shallow.sort(np.frombuffer(raw, np.uint8), np.array(at), np.array(length), np.array(group))
    keys = [(group[i], raw[at[i] : at[i] + length[i]]) for i in order]
    assert keys == sorted((g, raw[a : a + n]) for a, n, g in zip(at, length, group))
    assert sorted(order.tolist()) == list(range(len(at)))
    assert new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:])]


@pytest.mark.parametrize("seed", range(8))
def test_against_sorted(seed):
    r = random.Random(seed)
    for _ in range(25):
        length = r.choice([1, 3, 7, 8, 9, 16, 41, 48, 50, 77, 145])
        n = r.randrange(1, 300)
        letters = r.choice([b"a", b"ab", b"abc\x00\xff"])
        raw = bytes(r.choice(letters) for _ in range(n + length + 5))
        if r.random() < 0.4:  # long common prefixes
            raw = (raw[:37] * (len(raw) // 37 + 1))[: len(raw)]
        group = [r.randrange(3) for _ in range(n)]
        size = [max(1, length - g) for g in group]
        check(raw, [r.randrange(len(raw) - length + 1) for _ in range(n)], size, group)


def test_common_prefixes_end_in_tries():
    prefix = b"p" * 60
    texts = [prefix + bytes([65 + i % 7]) + b"tail" + bytes([97 + i % 3]) for i in range(200)]
    raw = b"".join(texts)
    check(raw, [i * len(texts[0]) for i in range(200)], [len(texts[0])] * 200, [0] * 200)


def test_nothing_to_sort():
    order, new = deep_shallow.sort(np.zeros(0, np.uint8), np.zeros(0, np.int64), 50)
    assert not len(order) and not len(new)
