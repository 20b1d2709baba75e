"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib

import pytest
from util import docs, prose

from lakemill.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain(counts: dict, ratio: int = 10) -> list:
    form = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def words_of(rows) -> dict:
    counts: dict = {}
    small = str.maketrans(spelling.CAPITALS, spelling.SMALL)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(small)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def variants(spark, counts, ratio=10):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, ratio).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_dense_words_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    counts = {"".join(r.choices("aab", k=r.randrange(1, 7))): r.choice([1, 2, 5, 60, 700]) for _ in range(90)}
    assert variants(spark, counts, 3) == plain(counts, 3)


def test_runs_ends_and_other_letters(spark):
    counts = {"": 3, "a": 40, "aa": 500, "aaa": 6000, "ab": 2, "ba": 9, "é": 2, "漢": 50, "a漢": 4, "x" * 3000: 2, "x" * 3001: 90, "x" * 1500 + "y" + "x" * 1499: 1, "\U0001f642a": 3}
    assert variants(spark, counts) == plain(counts)


def test_any_hot_nodes_give_the_same_rows(spark, monkeypatch):
    r = random.Random(9)
    counts = {"".join(r.choices("abc", k=6)): r.randrange(1, 100) for _ in range(150)}
    for hot in (1, 5):
        monkeypatch.setattr(spelling, "HOT_NODES", hot)
        assert variants(spark, counts, 2) == plain(counts, 2)


def test_hashes_that_are_all_alike_lose_no_pair(spark, monkeypatch):
    # nodes of the trie run together: words see another heavy letter, and the same one
    r = random.Random(5)
    counts = {"".join(r.choices("abcd", k=r.randrange(3, 6))): 2 for _ in range(120)}
    import numpy as np

    monkeypatch.setattr(spelling, "mix", lambda x: x & np.uint64(3))
    assert variants(spark, counts) == plain(counts)


def test_whole_documents_with_nulls_repeats_and_other_columns(spark):
    base, other = (re.sub(r"(\w+) (\w+)( |$)", r"\1\2 ", prose(i, 400)) for i in (1, 2))
    texts = [base, base, base, None, "", "Ünder-WORDSMITH wordsmith wordsmiths wordsmiths", "naïveté naïveté " * 30, "naiveté naiveté", *[other] * 30, "q" * 5000 + " " + "Q" * 5000]
    df = docs(spark, texts, doc_id=[None, 1, 1, *range(2, len(texts) - 1)]).repartition(3)
    got = spelling.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain(words_of((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()))
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 100
    assert spelling.group_variants(df.limit(0)).collect() == []


def test_forms_that_could_run_in_circles_are_refused(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_no_plan_gathers_words_or_joins_all_with_all(spark):
    df = spark.createDataFrame([(f"word{chr(97 + i)}", 2) for i in range(20)], "word string, n long")
    plan = spelling.variants(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
