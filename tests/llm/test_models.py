import ast
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from util import docs, prose

from lakemill.llm import language_id, quality

LANGS = {"aa": "bcdf", "bb": "ghjk", "cc": "lmnp"}


def text_in(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(LANGS[lang]) + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_forward_backward_equals_all_paths(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 3)
    r = np.random.default_rng(0)
    counts = np.array([1, 2, 7, 3, 4, 6])
    scores, steps = r.normal(size=(counts.sum(), 3)) * 3, r.normal(size=(3, 3))
    got, at = language_id.marginals(scores, steps, counts), 0
    for n in counts.tolist():
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False))) * np.exp(steps[:, path[0]]).sum()
            total[np.arange(n), path] += w
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


@pytest.mark.parametrize("piece", [1, 7, 50, 1000])
def test_chains_in_pieces_equal_whole_ones(monkeypatch, piece):
    r = np.random.default_rng(3)
    emissions, steps, counts = r.normal(size=(40, 3)) * 2, r.normal(size=(3, 3)), np.array([1, 300, 49, 50, 51])
    ids = r.integers(0, 40, counts.sum())
    p = language_id.marginals(emissions[ids], steps, counts)
    monkeypatch.setattr(language_id, "PIECE", piece)
    means, states = language_id.decode(emissions, ids, counts, steps)
    assert np.allclose(means, language_id.sums(p, counts) / counts[:, None]) and (states == p.argmax(axis=1)).all()


def test_expectations_equal_marginals():
    r = np.random.default_rng(1)
    scores, steps = r.normal(size=(9, 5, 4)), r.normal(size=(4, 4))
    p, pairs = language_id.expectations(scores, steps)
    flat = language_id.marginals(scores.transpose(1, 0, 2).reshape(-1, 4), steps, np.full(5, 9))
    assert np.allclose(p.transpose(1, 0, 2).reshape(-1, 4), flat)
    assert np.isclose(pairs.sum(), 8 * 5) and np.allclose(pairs.sum(axis=0), p[1:].sum(axis=(0, 1)))


def test_very_long_chains_stay_finite():
    p = language_id.marginals(np.random.default_rng(2).normal(size=(50_000, 4)) * 20, np.eye(4) * 5, np.array([50_000]))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_features_know_affixes_and_bounds():
    one = lambda w: set(language_id.features_of(pa.array([w]))[0].tolist())
    together, counts = language_id.features_of(pa.array(["abc", "é", "zabc"]))
    parts = np.split(together, np.cumsum(counts)[:-1])
    assert [set(x.tolist()) for x in parts] == [one("abc"), one("é"), one("zabc")]
    assert len(one("abc") & one("zabc")) > 5 and len(one("abc") & one("é")) <= 1


def language_docs(spark):
    texts, langs = [], []
    for i in range(240):
        lang = sorted(LANGS)[i % 3]
        texts.append(text_in(lang, 5 + i % 40, i))
        langs.append(lang if i % 7 else None)
    return docs(spark, texts, lang=langs), [sorted(LANGS)[i % 3] for i in range(240)]


def test_languages_of_documents_never_learned_from(spark):
    df, truth = language_docs(spark)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    unseen = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in unseen]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_switched_text_is_labelled_word_by_word(spark):
    model = language_id.learn(language_docs(spark)[0])
    text = f"{text_in('aa', 12, 'x')} {text_in('bb', 30, 'y')}"
    ids, vocabulary, counts = language_id.split(pa.array([text]), language_id.NOT_LETTERS)
    p = language_id.marginals(model.emissions(vocabulary)[ids].astype(float), model.transitions, counts)
    assert np.mean(p.argmax(axis=1) == [0] * 12 + [1] * 30) > 0.9
    assert (np.diag(model.transitions) > model.transitions.T[~np.eye(3, dtype=bool)].reshape(3, 2).max(axis=1)).all()


def test_segments_cover_each_text(spark):
    model = language_id.learn(language_docs(spark)[0])
    texts = [f"{text_in('aa', 20, 'x')} {text_in('bb', 30, 'y')}", None, "12", text_in("cc", 9, "z"), "", text_in("bb", 4, "w")]
    got = {r.doc_id: r.segments for r in language_id.predict(docs(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        at = 0
        for s in got[i]:
            assert s.word == at and s.words > 0
            at += s.words
        assert at == len([w for w in (text or "").split() if w.isalpha()])
    assert [s.lang for s in got[3]] == ["cc"] and sum(s.words for s in got[0] if s.lang == "bb") >= 27


def test_texts_without_letters_are_undetermined(spark):
    df, _ = language_docs(spark)
    model = language_id.learn(df)
    odd = docs(spark, [None, "", "123 !!", "ba" * 50_000, "x"], lang=["aa", None, "bb", None, "cc"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "aa" and got[4][0] in LANGS
    assert {r.lang_pred for r in language_id.identify(docs(spark, ["a", "b"], lang=[None, None])).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_one_language_and_null_ids(spark):
    df = docs(spark, ["ba ca"] * 6, doc_id=[None, 1, 2, 3, 4, 6], lang=["aa"] * 6)
    got = language_id.identify(df).collect()
    assert len(got) == 6 and {r.lang_pred for r in got} == {"aa"} and [r.held_out for r in got if r.doc_id is None] == [False]


def test_statistics_equal_plain_counts():
    texts = [None, "", "Ab ab, ab ab!\n\nÉ 12\nÉ 12", "x" * 1000, "a\tb\r\nc | d"]
    got = quality.statistics(pa.array(texts))
    assert (got[:2] == 0).all() and np.isfinite(got).all()
    x = dict(zip(quality.STATISTICS, got[2], strict=True))
    text = texts[2]
    size = len(text.encode())
    assert np.isclose(x["upper"], 1 / size) and np.isclose(x["digit"], 4 / size) and np.isclose(x["shout"], 1 / size) and np.isclose(x["line"], 3 / size) and np.isclose(x["high"], 4 / size)
    w = text.split()
    assert np.isclose(x["log_words"], np.log1p(len(w))) and np.isclose(x["distinct_words"], len(set(w)) / len(w)) and np.isclose(x["top_word"], 2 / len(w))
    assert np.isclose(x["distinct_lines"], 2 / 3) and np.isclose(x["word_length"], np.mean([len(y) for y in w]))
    one = quality.statistics(pa.array([texts[2]]))
    assert np.allclose(one[0], got[2])


def test_isotonic_fit_rises_and_pools():
    total, ones = np.array([4.0, 0, 4, 4, 0, 8]), np.array([1.0, 0, 3, 1, 0, 8])
    fit = quality.isotonic(total, ones)
    assert (np.diff(fit) >= 0).all() and fit[2] == fit[3] == 5 / 10 and fit[0] == 2 / 6 and fit[5] == 9 / 10
    assert (quality.isotonic(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_leave_one_out_scores_are_those_of_a_refit():
    r = np.random.default_rng(0)
    z, y = r.normal(size=(30, 4)), r.integers(0, 2, 30).astype(float)
    w = r.integers(1, 4, 30).astype(float)
    inverse = np.linalg.inv((z * w[:, None]).T @ z + np.eye(4))
    fast = quality.leave_one_out(z, y, w, inverse @ (z * w[:, None]).T @ y, inverse)
    for i in range(30):
        keep = np.arange(30) != i
        without = np.linalg.solve((z[keep] * w[keep, None]).T @ z[keep] + np.eye(4), (z[keep] * w[keep, None]).T @ y[keep])
        assert np.isclose(z[i] @ without, fast[i])


def test_arrays_are_added_up_in_a_tree(spark):
    rows = [([float(i), 1.0, -2.0 * i],) for i in range(100)]
    for fan in (2, 7, 1000):
        assert quality.add_up(spark.createDataFrame(rows, "v array<double>").repartition(9), fan).tolist() == [4950.0, 100.0, -9900.0]
    assert quality.add_up(spark.createDataFrame([], "v array<double>")) is None


@pytest.fixture(scope="module")
def labelled(spark):
    good = [prose(i, 60) + "." for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(500 + i, 60).split()) for i in range(75)]
    bad += [" ".join(["same"] * 80) for _ in range(75)]
    df = docs(spark, good + bad + [None, ""])
    rows = [(i, int(i < 150), 0) for i in range(300)]
    return df, spark.createDataFrame([*rows, (5, None, 1), (9999, 0, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_of_documents_never_learned_from(spark, labelled):
    got = {r.doc_id: r for r in quality.score(*labelled).collect()}
    assert len(got) == 302
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    unseen = [i for i, r in got.items() if r.held_out and i < 300]
    assert np.mean([got[i].predicted == (i < 150) for i in unseen]) > 0.95


def test_labels_of_held_out_documents_and_other_columns_have_no_effect(spark, labelled):
    df, labels = labelled
    turned = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = ({r.doc_id: round(r.score, 9) for r in quality.score(d, x).collect()} for d, x in ((df, labels), (df.withColumn("source", quality.F.lit("z")).repartition(3), turned)))
    assert one == two


def test_quality_without_labels_or_documents(spark, labelled):
    df, labels = labelled
    assert {r.score for r in quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score(df.limit(0), labels).count() == 0
    odd = docs(spark, ["a", "a", None], doc_id=[None, None, None])
    assert len(quality.score(odd, labels).collect()) == 3


def test_quality_equals_a_plain_fit(spark, labelled):
    """Scores by statistics, features and normal equations worked out over all rows at once."""
    df, labels = labelled
    got = {r.doc_id: r.score for r in quality.score(df, labels).collect()}
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and r.doc_id < 302 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            known.setdefault(r.doc_id, []).append(r.quality)
    rows = sorted(df.select("doc_id", "text").collect())
    x = quality.statistics(pa.array([r.text for r in rows]))
    at, y, w = sorted(known), np.array([np.mean(known[i]) for i in sorted(known)]), np.array([len(known[i]) for i in sorted(known)])
    mean, spread = x[at].mean(axis=0), x[at].std(axis=0)
    random = np.random.default_rng(11)
    frequencies, phases = random.standard_normal((x.shape[1], 200)) / 3.0, random.uniform(0, 2 * np.pi, 200)
    z = np.hstack([np.cos((x - mean) / np.where(spread > 1e-9, spread, 1) @ frequencies + phases) / 10, np.ones((len(x), 1))])
    penalty = np.diag([1e-3 * len(at) / 200] * 200 + [0])
    normal = (z[at] * w[:, None]).T @ z[at] + penalty
    raw = z @ np.linalg.solve(normal, (z[at] * w[:, None]).T @ y)
    # each labelled row's score by a fit without it, then pools of bins whose shares of ones don't rise
    bin_of = lambda v: int(np.clip((v - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1))
    bins = {}
    for i, (row, share, weight) in enumerate(zip(at, y, w, strict=True)):
        rest = normal - weight * np.outer(z[row], z[row])
        own = bins.setdefault(bin_of(z[row] @ np.linalg.solve(rest, (z[at] * w[:, None]).T @ y - weight * share * z[row])), [0.0, 0.0])
        own[0] += weight * share
        own[1] += weight
    pools = [[[b], *bins[b]] for b in sorted(bins)]
    while (k := next((k for k in range(len(pools) - 1) if pools[k][1] / pools[k][2] >= pools[k + 1][1] / pools[k + 1][2]), None)) is not None:
        pools[k : k + 2] = [[pools[k][0] + pools[k + 1][0], pools[k][1] + pools[k + 1][1], pools[k][2] + pools[k + 1][2]]]
    used, fit = zip(*((b, (ones + 1) / (total + 2)) for own, ones, total in pools for b in own), strict=True)
    want = np.interp([bin_of(v) for v in raw], used, np.maximum.accumulate(fit))
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_the_query_adds_up_in_a_tree(spark, labelled, monkeypatch):
    sums, real = [], quality.add_up
    monkeypatch.setattr(quality, "add_up", lambda parts: sums.append(parts.columns) or real(parts))
    quality.score(*labelled).count()
    assert sums == [["v"], ["v"]]


def test_no_module_defines_a_name_twice():
    for path in Path(quality.__file__).parent.parent.rglob("*.py"):
        for scope in ast.walk(ast.parse(path.read_text())):
            if isinstance(scope, (ast.Module, ast.ClassDef)):
                names = [n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
                assert len(names) == len(set(names)), path


def test_quality_with_odd_column_names_long_texts_and_ties(spark, labelled):
    df, labels = labelled
    odd = df.select(quality.F.col("doc_id").alias("doc.id"), quality.F.col("text").alias("the `text`"), quality.F.lit(1).alias("x"), quality.F.lit("y").alias("held_out"))
    long = spark.createDataFrame([(1000 + i, "Word word. " * 200_000, 1, "") for i in range(2)], odd.schema)
    got = {r[0]: r.score for r in quality.score(odd.unionByName(long), labels.withColumnRenamed("doc_id", "doc.id"), id_col="doc.id", text_col="the `text`").collect()}
    plain = {r.doc_id: r.score for r in quality.score(df, labels).collect()}
    assert got[1000] == got[1001] and all(abs(got[i] - s) < 1e-9 for i, s in plain.items())


def test_language_of_each_text_by_plain_forward_backward(spark):
    df, _ = language_docs(spark)
    texts = [f"{text_in('aa', 7, 'p')} {text_in('bb', 9, 'q')}", text_in("cc", 1, "r"), None, "12 -", text_in("bb", 40, "s").upper()]
    rows = df.unionByName(docs(spark, texts, doc_id=[9000 + i for i in range(5)], lang=[None] * 5))
    got = {r.doc_id: r for r in language_id.identify(rows).collect()}
    model = language_id.learn(rows)
    step, k = np.exp(model.transitions), len(model.langs)
    for r in rows.select("doc_id", "text").collect():
        words = [w for w in re.split(r"[\W\d_]+", (r.text or "").lower()) if w]
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].segments) == ("und", 0.0, [])
            continue
        emit = np.exp(np.concatenate([model.emissions(pa.array([w])) for w in words]))
        ahead, back = [np.full(k, 1 / k)], [np.ones(k)]
        for e in emit:
            ahead.append(ahead[-1] @ step * e)
            ahead[-1] /= ahead[-1].sum()
        for e in emit[:0:-1]:
            back.append(step @ (e * back[-1]))
            back[-1] /= back[-1].sum()
        p = np.array(ahead[1:]) * np.array(back[::-1])
        p /= p.sum(axis=1, keepdims=True)
        assert got[r.doc_id].lang_pred == model.langs[p.mean(axis=0).argmax()] and np.isclose(got[r.doc_id].score, p.mean(axis=0).max())
        assert [s.lang for s in got[r.doc_id].segments for _ in range(s.words)] == [model.langs[i] for i in p.argmax(axis=1)]


def test_features_of_words_equal_plain_ones_and_are_not_sorted(monkeypatch):
    words = ["", "a", "zé", "abc", "жзк", "abcdefgh", "x" * 300, *text_in("aa", 300, 0).split()]
    sorted_ones, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *args, **named: sorted_ones.append(len(x)) or real(x, *args, **named))
    monkeypatch.setattr(language_id, "LETTERS_AT_ONCE", 50, raising=False)
    got, counts = language_id.features_of(pa.array(words))
    # sorting all features took more time than finding them
    assert sum(sorted_ones) <= len(words)

    def hashed(gram, salt=0):
        h = len(gram)
        for c in gram:
            h = h * 0x100000001B3 + ord(c)
        h = (h * 31 + salt if salt else h) * 0x9E3779B97F4A7C15 % (1 << 64)
        return h >> (64 - 16)

    for word, own in zip(words, np.split(got, np.cumsum(counts)[:-1]), strict=True):
        marked, plain = f"<{word}>", []
        for n in range(1, min(len(marked), 5) + 1):
            runs = [marked[i : i + n] for i in range(len(marked) - n + 1)]
            plain += [hashed(r) for r in (runs if n > 1 else runs[1:-1])] if n < 5 else []
            plain += [hashed(runs[0], 1), hashed(runs[-1], 2)] if n > 1 else []
        assert own.tolist() == plain


def test_a_step_of_learning_equals_a_plain_one():
    k, chains, r = 3, 2, np.random.default_rng(4)
    size = language_id.Learner(k, np.zeros(0), np.zeros(0)).shapes
    values, squares = (r.random(sum(a * b for a, b in size)).astype(np.float32) for _ in range(2))
    learner = language_id.Learner(k, values, squares)
    vocabulary, n = pa.array(["ab", "abc", "b", "xyz", "abcde"]), chains * language_id.CHAIN
    ids, states, lexical = r.integers(0, 5, n), r.integers(0, k, n), r.integers(0, size[2][0], n)
    learner.learn(vocabulary, ids, states, lexical)
    features, counts = language_id.features_of(vocabulary)
    own = np.split(features, np.cumsum(counts)[:-1])
    weights, steps, lexicon = learner.parts(values.astype(float))
    scores = np.array([weights[own[i]].sum(axis=0) + lexicon[x] for i, x in zip(ids, lexical, strict=True)])
    p, gradient = language_id.marginals(scores, steps, np.full(chains, language_id.CHAIN)), np.zeros(len(values))
    by_weight, by_step, by_lexicon = learner.parts(gradient)
    for i, wrong in enumerate(np.eye(k)[states] - p):
        np.add.at(by_weight, own[ids[i]], wrong)
        by_lexicon[lexical[i]] += wrong
    _, expected = language_id.expectations(scores.reshape(chains, language_id.CHAIN, k).transpose(1, 0, 2), steps)
    by_step -= expected
    for chain in range(0, n, language_id.CHAIN):
        np.add.at(by_step, (states[chain : chain + language_id.CHAIN - 1], states[chain + 1 : chain + language_id.CHAIN]), 1)
        by_step += np.exp(steps) / np.exp(steps).sum(axis=0) * (np.eye(k)[states[chain]] - p[chain])
    gradient /= chains
    want = squares + gradient**2
    assert np.allclose(learner.squares, want, atol=1e-5)
    assert np.allclose(learner.values, values + language_id.RATE * gradient / (np.sqrt(want) + 1e-6), atol=1e-5)
