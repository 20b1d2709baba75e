import random

import numpy as np
import pyarrow as pa
import pytest
from util import docs, groups, prose, shingles, words

from lakemill.llm import embedding_dedup, graph, ngram_join
from lakemill.session import ship


def brute(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold]
    return links, groups(range(len(texts)), links)


def variants(base, n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = "".join(r.choices("qrstuvwxyz", k=5))
        out.append(" ".join(w))
    return out


def texts_with_copies():
    out = [prose(i, 60) for i in range(20)]
    for i in range(4):
        out += variants(words(i, 200), 8, i)
    out += [out[3], out[3].upper(), out[5] + " ..."]
    return [*out, None, "", "...", "two words", "Two, words!", "one", prose(77, 5), prose(50, 3000), prose(50, 3000) + " more"]


@pytest.fixture(params=[(1000, 1_500_000), (5, 1_500_000), (1000, 200)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", request.param[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", request.param[1])


def test_join_equals_brute_force(spark, blocks):
    texts = texts_with_copies()
    links, group = brute(texts)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and len(links) > 30
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if shingles(u) == shingles(t) and shingles(t)] or [i]
        want = (min(same), sum(i in link for link in links), group[i], group[i] == i)
        assert (got[i].class_id, got[i].n_links, got[i].component_id, got[i].kept) == want, t


def test_tries_find_large_and_small_groups(spark):
    texts = [t for i in range(3) for t in variants(words(i, 200), 15 * i + 2, i)] + [prose(70 + i, 50) for i in range(10)]
    texts += [" ".join(words(90, n)) for n in range(1, 14)] + [" ".join(words(90, 30)[3 : 3 + n]) for n in range(4, 14)]
    links, group = brute(texts)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert all((got[i].n_links, got[i].component_id) == (sum(i in link for link in links), group[i]) for i in range(len(texts)))


def test_join_of_repeated_ids_null_ids_and_nothing(spark):
    a, b = prose(1, 40), prose(2, 40)
    df = docs(spark, [a, a, a, b, b, None], doc_id=[4, 4, None, None, 9, None])
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in ngram_join.jaccard_join(df).collect()), key=str)
    assert got == sorted([(4, 4, 2, 4, False), (4, 4, 2, 4, False), (None, 4, 2, 4, True), (None, 9, 1, 9, True), (9, 9, 1, 9, False), (None, None, 0, None, True)], key=str)
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0


def test_depth_is_shortened_until_recall_is_met():
    assert ngram_join.forest_depth(32, 8, 0.8, 0.9999) == 6
    assert 1 - (1 - 0.8**6) ** 32 >= 0.9999 > 1 - (1 - 0.8**7) ** 32
    assert ngram_join.forest_depth(1, 8, 0.1, 0.9999) == 1


def test_depths_allow_for_all_sizes_of_partners():
    depth_of = ngram_join.depths(32, 8, 0.8, 0.9999)
    for n in range(1, 64):
        could = [s / (n + m - s) for m in range(1, 2 * n) for s in range(1, min(n, m) + 1) if s < max(n, m) and s / (n + m - s) >= 0.8 - 1e-9]
        assert ngram_join.least_similarity(n, 0.8) == pytest.approx(min(could, default=2.0))
        assert depth_of[n] == (ngram_join.forest_depth(32, 8, min(could), 0.9999) if could else 0)
    assert {0, 6, 7, 8} == set(depth_of.tolist()) and depth_of[-1] == 6


@pytest.mark.parametrize("n", [5, 6, 7, 12, 60, 400])
def test_recall_of_the_forest(n):
    """Of pairs that are no more similar than they have to be, the share that meets in some trie."""
    r = np.random.default_rng(n)
    shared = next(s for s in range(n, 0, -1) if s / (2 * n - s) < 0.8) + 1 if n > 60 else None
    least, found, pairs = ngram_join.least_similarity(n, 0.8), 0, 20_000
    # of all pairs with that similarity, one with this set size on the left
    i, m = next((s, m) for s in range(1, n + 1) for m in range(s, 2 * n) if abs(s / (n + m - s) - least) < 1e-9) if shared is None else (shared, n)
    depth_of, agree = ngram_join.depths(32, 8, 0.8, 0.9999), ngram_join.least_agreement(256, 0.8, ngram_join.MISS_BY_SKETCH)
    for start in range(0, pairs, 2000):
        sets = [(x[:n], x[n - i : n - i + m]) for x in r.integers(1 << 64, size=(2000, 2 * n + m), dtype=np.uint64)]
        hashes = np.concatenate([np.sort(s) for pair in sets for s in pair])
        counts = np.array([len(s) for pair in sets for s in pair])
        paths = ngram_join.signatures(hashes, counts, 32, 8).view(np.uint64)
        apart = paths[::2] ^ paths[1::2]
        depth = max(depth_of[min(n, 64)], depth_of[min(m, 64)])
        meets = (apart >> np.uint64(64 - 8 * int(depth)) == 0).any(axis=1)
        agrees = (np.ascontiguousarray(apart).view(np.uint8) == 0).sum(axis=1) >= agree
        found += int((meets & agrees).sum())
    # 1 in 10,000 may be lost; eight in 20,000 would be six more than expected
    assert found >= pairs - 8


def test_pairs_that_share_no_prefix_are_not_compared(spark, monkeypatch, tmp_path):
    """A chain of texts, each like the next one alone, is one group, but only neighbours are verified."""
    base = words(5, 600)
    texts = [" ".join(base[9 * i : 9 * i + 150]) for i in range(50)]
    links, group = brute(texts)
    assert len(links) == 49 and set(group.values()) == {0}
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert all((got[i].n_links, got[i].component_id) == (sum(i in link for link in links), 0) for i in range(50))


def test_candidates_come_from_walking_paths_in_order():
    """All pairs that share a prefix as long as the longer of their depths, and no others; out of order they'd be lost."""
    r = np.random.default_rng(4)
    n = 300
    size = r.choice([6, 7, 8, 90], n)
    # few values, so that prefixes of all lengths are shared
    paths = r.integers(0, 2, (n, 3, 8), dtype=np.uint8).astype(np.uint64)
    paths[:, 0, :6] = r.integers(0, 2, (1, 6))
    path = (paths << np.arange(56, -1, -8, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    depth_of = ngram_join.depths(32, 8, 0.8, 0.9999)

    def batch(order):
        column = {"ckey": [bytes([i >> 8, i & 255]) for i in order], "bucket": [int(path[0, 0] >> np.uint64(16) << np.uint64(16)) & (1 << 63) - 1] * n, "one": [0] * n, "two": [0] * n, "block": [0] * n, "n": size[order].tolist()}
        return pa.RecordBatch.from_pydict({**column, "paths": path[order].view(np.int64).tolist()})

    def pairs(order):
        return {frozenset((int(order[i]), int(order[j]))) for one, two in ngram_join.met(batch(order), 0.0, depth_of, 0) for i, j in zip(one.tolist(), two.tolist(), strict=True)}

    depth = depth_of[np.minimum(size, len(depth_of) - 1)]
    want = {frozenset((i, j)) for i in range(n) for j in range(i) if (path[i, 0] ^ path[j, 0]) >> np.uint64(64 - 8 * int(max(depth[i], depth[j]))) == 0}
    ordered = np.argsort(path[:, 0].view(np.int64), kind="stable")
    assert pairs(ordered) == want and set(depth.tolist()) == {6, 7, 8} and 0 < len(want) < n * (n - 1) / 2
    assert pairs(r.permutation(n)) < want


def test_a_repeated_row_sends_its_text_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(ngram_join, "cut", lambda df, label, real=ngram_join.cut: sent.append((label, df)) or real(df, label))
    base = words(1, 60)
    df = docs(spark, [" ".join(base)] * 50 + [" ".join([*base[:-1], "other"])] * 50, doc_id=[1] * 50 + [2] * 50).coalesce(2)
    assert {r.component_id for r in ngram_join.jaccard_join(df).collect()} == {1}
    plan = next(df for label, df in sent if label == "sets")._jdf.queryExecution().toString()
    # shingles are what is joined, and they are made before
    assert plan.index("Join") < plan.index("MapInArrow")


def test_shingle_sets_equal_python_sets():
    texts = texts_with_copies()
    hashes, counts = ngram_join.shingle_sets(pa.array(texts), 5)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(parts[i], parts[j])) == len(shingles(texts[i]) & shingles(texts[j]))


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)] + [(640, i) for i in range(600, 640)]
    want = groups({n for link in links for n in link}, links)
    df = spark.createDataFrame([*links, *links[:9], (None, 1)], "x long, y long")
    assert {r.node: r.component for r in graph.components(df, "x", "y").collect()} == want
    assert graph.components(df.limit(0), "x", "y").count() == 0


def near_vectors(seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = r.normal(size=16)
        rows += [(centre + r.normal(size=16) * s, c % 3) for s in (0, 0.01, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2) for _ in range(4)]
    return [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("block", [1000, 7])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = near_vectors()
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(40)] + [(2000 + i, rows[0][1], 2) for i in range(3)]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    x = np.array([v for _, v, _ in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([label for *_, label in rows])
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    group = groups(range(len(rows)), np.argwhere(linked).tolist())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert linked.sum() > 100
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), group[i], group[i] == i)


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 0.0], 1), (10, [], 1)]
    rows += [(11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1e-30, 0.0], 1), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rid long, keys string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 0, None, True)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_more_rows_take_longer_keys_at_the_same_recall():
    agree = 1 - np.arccos(0.98) / np.pi
    for rows in (10, 10**5, 10**10):
        bits, tables = embedding_dedup.tables_for(rows, 0.98, 1e-7)
        assert (1 - agree**bits) ** tables <= 1e-7
    assert embedding_dedup.tables_for(10**10, 0.98, 1e-7)[0] > embedding_dedup.tables_for(10**5, 0.98, 1e-7)[0]


def test_sides_that_grow_are_not_sent_to_all_tasks(spark, monkeypatch):
    plans = {}

    def seen(module):
        cut = module.cut

        def run(df, label):
            plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
            return cut(df, label)

        monkeypatch.setattr(module, "cut", run)

    ship(spark)
    for module in (ngram_join, embedding_dedup, graph):
        seen(module)
    plans["texts"] = ngram_join.jaccard_join(docs(spark, texts_with_copies()))._jdf.queryExecution().executedPlan().toString()
    of_texts, used = dict(plans), {"members", "meetings", "wanted", "compared", "edges", "texts"}
    plans.clear()
    vectors = spark.createDataFrame([(i, [1.0, i % 7 / 50, 0.0], "a") for i in range(60)], "vec_id long, embedding array<double>, label string")
    plans["vectors"] = embedding_dedup.near_duplicates(vectors)._jdf.queryExecution().executedPlan().toString()
    assert used <= set(of_texts) and {"distinct", "members", "compared", "vectors"} <= set(plans)
    # the words of a bit map are bounded in number
    joins = [(label, line.strip()) for found in (of_texts, plans) for label, plan in found.items() for line in plan.splitlines() if "BroadcastHashJoin" in line and "[at#" not in line]
    assert joins == [] and any("SortMergeJoin" in p for p in of_texts.values())
