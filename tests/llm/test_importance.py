"""Importance resampling against n-grams put together and counted one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from util import docs, prose

from lakemill.llm import importance


def features(text: str | None, n: int = 3) -> list[bytes]:
    small = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return [" ".join(w[i : i + k]).encode() for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=5, least=20, size=10_000):
    bucket = lambda text: [zlib.crc32(f) % size for f in features(text)]
    source, wanted = Counter(b for _, t in rows for b in bucket(t)), Counter(b for t in target for b in bucket(t))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (all_s + size) / ((source[b] + 1) * (all_t + size)))) for b in range(size)]
    out = []
    for i, text in rows:
        own = bucket(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text, 1)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0], r[2], r[1]))
    drawn = percent * len(able) // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(ranked, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_a_ring_of_checksums_is_that_of_whole_runs():
    r = random.Random(3)
    for n in (1, 2, 3, 5):
        for text in ("", "one", "One TWO  three4 Über_straße", "\x00a\x7fb漢字 c", *("".join(r.choices("ab \n-é9", k=60)) for _ in range(50))):
            count, found = importance.scan(text.encode(), n)
            assert count == len(features(text, 1)) and sorted(found) == sorted(zlib.crc32(f) for f in features(text, n))


def test_words_cross_no_stretch(monkeypatch):
    text = prose(4, 500).encode()
    whole = importance.scan(text, 3)
    monkeypatch.setattr(importance, "STRETCH", 10)
    assert importance.scan(text, 3) == whole


def test_gains_are_smoothed_log_ratios():
    s, t = np.array([0, 10, 5]), np.array([4, 0, 5])
    want = [math.floor(1000 * math.log((b + 1) * (15 + 3) / ((a + 1) * (9 + 3)))) for a, b in ((0, 4), (10, 0), (5, 5))]
    assert importance.gains(s, t).tolist() == want


def test_all_rows_with_nulls_repeats_ties_and_other_columns(spark):
    texts = [None, "", "short text", *(prose(i, 40 + i) for i in range(60)), *[prose(7, 50)] * 40, "long " * 30_000]
    ids = [None, None, *range(len(texts) - 30), *[5] * 28]
    df = docs(spark, texts, doc_id=ids).repartition(4)
    target = [prose(3, 30), prose(5, 60), None, ""]
    bench = docs(spark, target).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(importance.resample(df, bench, percent=20)) == plain(rows, target, 20)
    assert got(importance.resample(df, bench.limit(0), percent=20)) == plain(rows, [], 20)
    assert importance.resample(df.limit(0), bench).collect() == []


def test_documents_like_the_target_are_drawn(spark):
    near, far = [prose(i, 60) for i in range(20)], [" ".join(f"zz{(i * 37 + k) % 900}" for k in range(60)) for i in range(180)]
    df = docs(spark, near + far)
    bench = docs(spark, [t for t in near for _ in range(3)])
    drawn = {r.doc_id for r in importance.resample(df, bench, percent=10).where("rank is not null").collect()}
    assert len(drawn) == 20 and drawn == set(range(20))
