from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_familiarity import text_in
from util import docs

from lakemill.llm import familiarity, language_id

LEARNED = {"aa": "bcdf", "bb": "ghjk"}


@pytest.fixture(scope="module")
def corpus(spark):
    # each document has a word of its own, three times
    langs = [sorted(LEARNED)[i % 2] for i in range(900)]
    own = ["".join("bcdghkfj"[int(c)] for c in f"{i:06o}") for i in range(900)]
    texts = [f"{w} {text_in(LEARNED[lang], 9, i)} {w.upper()} {w}" for i, (lang, w) in enumerate(zip(langs, own, strict=True))]
    return language_id.labelled(docs(spark, [*texts, "", "12", None, "none"], lang=[*langs, "aa", "bb", "aa", None])).cache(), own


def test_all_documents_are_learned_from(spark, corpus):
    texts, own = corpus
    df = docs(spark, [f"{w} {w} {w}" for w in own], lang=[sorted(LEARNED)[i % 2] for i in range(len(own))])
    usable = [own[r.doc_id] for r in df.where(~language_id.held_out("doc_id")).select("doc_id").collect()]
    model = language_id.learn(df)
    assert len(usable) > 2 * 300 and (model.lexicon[language_id.entry(pa.array(usable))] > 0).all()
    assert np.count_nonzero(model.lexicon) <= len(usable)


def test_words_are_counted_by_language_and_half(corpus):
    texts, _ = corpus
    rows = texts.collect()
    plain = Counter((w, r.lang, r.back) for r in rows for w in r.text.lower().split() if w.isalpha())
    assert {(r.word, r.lang, r.back): r.n for r in language_id.tally(texts).collect()} == plain


def test_character_models_of_all_documents_equal_plain_ones(corpus):
    texts, _ = corpus
    got = familiarity.fit_all(texts, language_id.tally(texts), sorted(LEARNED))
    plain = familiarity.fit([(r.lang, r.text.lower(), r.back) for r in texts.collect() if r.text not in ("", "12")])
    for a, b in zip(got.tables, plain.tables, strict=True):
        assert (a.hashes == b.hashes).all() and np.allclose(a.found, b.found) and np.allclose(a.missed, b.missed)
    assert np.allclose(got.unseen, plain.unseen) and np.abs(got.limits - plain.limits).max() < 0.02


def test_ngrams_used_least_are_left_to_shorter_ones(corpus):
    texts, _ = corpus
    counts = language_id.tally(texts)
    whole, part = (familiarity.count_grams(counts, sorted(LEARNED), most) for most in (1 << 19, 400))
    assert sum(len(level.hashes) for level, _ in part) <= 400 < sum(len(level.hashes) for level, _ in whole)
    model = familiarity.smoothed([level for level, _ in part])
    assert all(np.isin(b.context, a.hashes).all() and np.isin(b.shorter, a.hashes).all() for (a, _), (b, _) in zip(part, part[1:], strict=False))
    assert np.isfinite(model.scores(pa.array(["bacada", "жж"]))[0]).all()


def test_every_word_is_in_a_chain():
    texts = pa.array([text_in(LEARNED[lang], 40 + i, i) for i, lang in enumerate(["aa", "bb"] * 20)] + ["", None])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([*["aa", "bb"] * 20, "aa", "bb"]), pa.array([i % 3 == 0 for i in range(42)])], ["text", "lang", "back"])
    vocabulary, ids, states, back = language_id.chained(batch, ["aa", "bb"], np.random.default_rng(0))
    plain = Counter((w, ["aa", "bb"].index(r["lang"]), r["back"]) for r in batch.to_pylist() for w in (r["text"] or "").split())
    n = sum(plain.values())
    assert len(ids) == -(-n // language_id.CHAIN) * language_id.CHAIN
    words = vocabulary.to_pylist()
    assert Counter((words[i], s, b) for i, s, b in zip(ids[:n].tolist(), states[:n].tolist(), back[:n].tolist(), strict=True)) == plain
    assert np.count_nonzero(np.diff(states)) > n / language_id.SWITCH / 4


def test_a_task_adds_up_its_counts_before_spark_does(monkeypatch):
    texts = [text_in(LEARNED[lang], 30, i % 3) for i, lang in enumerate(["aa", "bb"] * 20)] + ["", None]
    langs, back = [*["aa", "bb"] * 20, "aa", "bb"], [i % 3 == 0 for i in range(42)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, ("string", "string", "bool"), strict=True)], ["lang", "text", "back"]) for row in zip(langs, texts, back, strict=True)]
    plain = Counter((w, lang, b) for lang, text, b in zip(langs, texts, back, strict=True) for w in (text or "").split())
    rows = [r for b in language_id.counted(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == len(plain) and {(r["word"], r["lang"], r["back"]): r["n"] for r in rows} == plain
    # little is held at a time
    monkeypatch.setattr(language_id, "TALLIED", 1)
    rows = [r for b in language_id.counted(iter(batches)) for r in b.to_pylist()]
    total = Counter()
    for r in rows:
        total[r["word"], r["lang"], r["back"]] += r["n"]
    assert len(rows) > len(plain) and total == plain
    assert list(language_id.counted(iter([]))) == []
