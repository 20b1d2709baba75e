import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from util import docs

from lakemill.llm import familiarity, language_id
from lakemill.llm.arrowtext import split

LEARNED = {"aa": "bcdf", "bb": "ghjk"}


def text_in(consonants, n, seed):
    r = random.Random(f"{consonants}{seed}")
    return " ".join("".join(r.choice(consonants) + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n))


def letters(alphabet, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randrange(3, 9))) for _ in range(n))


def test_the_language_stage_drops_what_is_in_no_language_learned(spark):
    learned = [(lang, text_in(c, 60, i)) for lang, c in LEARNED.items() for i in range(60)]
    aa, bb = (text_in(c, 100, "new") for c in LEARNED.values())
    good = [
        text_in("bcdf", 3, "short"), aa, f"{aa} {bb}", " ".join(w for pair in zip(aa.split(), bb.split(), strict=True) for w in pair), f"{text_in('ghjk', 20, 1)} {letters('жзклмн', 20, 1)}",
        f"token = 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde {text_in('bcdf', 5, 's')}", f"{aa}\n12 34".upper(),
    ]
    bad = [text_in("lmnp", n, 0) for n in (5, 50, 500)] + [letters(a, n, n) for a in ("жзклмнопрст", "αβγδεζη", "的一是不了人我", "bcdfghjkaeiou", "abcdefghijklmnopqrstuvwxyz") for n in (20, 300)]
    texts = [t for _, t in learned] + good + bad
    df = docs(spark, texts, lang=[lang for lang, _ in learned] + [None] * (len(good) + len(bad)))
    kept = corpus_pipeline.identify_language(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(learned) + len(good)))


def test_one_language_is_enough_to_tell_others(spark):
    texts = [text_in("bcdf", 60, i) for i in range(60)] + [letters("жзклмн", 50, 1)]
    kept = corpus_pipeline.identify_language(spark, docs(spark, texts, lang=["en"] * 60 + [None]), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_scores_are_probabilities():
    model = familiarity.learn([("aa", "ab abc b"), ("bb", "ba ba c")])
    words = ["", *(a + b for a in ["", *"abc"] for b in "abc")]
    logs, _ = model.scores(pa.array(words[1:]))
    assert (logs < 0).all() and np.exp(logs).sum() < 2
    # by hand: in "bb", 5 letters and 3 ends of 3 kinds are counted; an unseen letter gets its part of what is left
    assert np.allclose(model.unseen[1], np.log(4 / (8 + 4) / familiarity.CHARACTERS))
    assert model.scores(pa.array(["ж"]))[0][0] < model.scores(pa.array(["b"]))[0][0]


def test_shares_count_words_of_blocks(monkeypatch):
    monkeypatch.setattr(familiarity, "BLOCK", 4)
    spans = [("aa", text_in("bcdf", 32, i), i % 2 == 0) for i in range(40)]
    model = familiarity.fit(spans)
    good, bad = text_in("bcdf", 4, "x"), letters("жзк", 4, 0)
    ids, vocabulary, counts = split(pa.array([f"{good} {bad}", f"{bad} {good}", good, bad, f"{bad} {bad} {good.split()[0]}"]), language_id.NOT_LETTERS)
    assert np.allclose(model.share(vocabulary, ids, counts), [0.5, 0.5, 1, 0, 1 / 9])
    assert familiarity.fit(spans[:1]) is None and familiarity.fit([]) is None


def test_a_language_that_is_only_held_back_is_learned():
    spans = [("aa", text_in("bcdf", 32, i), i % 2 == 0) for i in range(40)] + [("bb", text_in("ghjk", 32, i), True) for i in range(9)]
    ids, vocabulary, counts = split(pa.array([text_in("ghjk", 40, "new")]), language_id.NOT_LETTERS)
    assert familiarity.fit(spans).share(vocabulary, ids, counts)[0] > 0.9
