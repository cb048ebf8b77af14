"""Documents with what operators must stand: nulls, empty and long texts, repeated rows, ties, odd characters."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, size string, shard int, id int, kept string"


def texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = ["ay", "Bir", "cı", "dört", "e", "FOO", "gül", "ham.", "içe", "jü!", "kar", "l", "ma", "\U0001f600", "na na"]
    passage = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(60))
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(r.randrange(1, 90)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]  # copies
    rows += [(200 + i, (rows[i][1] or "") + " changed") for i in range(20)]  # near copies
    rows += [(300 + i, f"{r.randrange(10**6)} " * r.randrange(5) + passage + f" {r.randrange(10**9)}" * r.randrange(9)) for i in range(12)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one"), (405, "x" * 30_000), (406, "x" * 29_000), (407, "ab " * 9000), (408, passage * 40), (None, "a null id"), (409, "ünï" * 40)]
    return rows


def documents(spark, rows=None):
    """With extra columns whose names an operator may use itself."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", None if n % 7 == 0 else "hot" if n % 3 == 0 else f"src{n % 5}", None if t is None else len(t), n, "big", n, None, "no") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)
