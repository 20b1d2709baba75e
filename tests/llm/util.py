"""What the tests of this subpackage share."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string, _rank long"


def docs(spark, texts, **columns):
    """Documents with the texts given, and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, "k", 7) for i, t in enumerate(texts)]
    for name, values in columns.items():
        at = DOCS.split(", ").index(next(d for d in DOCS.split(", ") if d.startswith(name + " ")))
        rows = [(*r[:at], v, *r[at + 1 :]) for r, v in zip(rows, values, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    r = random.Random(seed)
    return ["".join(random.Random(r.randrange(vocabulary)).choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def shingles(text: str | None, width: int = 5) -> set:
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(nodes, links) -> dict:
    """The smallest node that each node is linked with."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
