"""Laws that hold for whatever input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import base_spans
from util import groups, shingles

from lakemill.llm import arrowtext, ngram_join, packing, quality, quotation, secrets, url_filter

SOME = settings(max_examples=200, deadline=None)
PIECES = st.lists(st.sampled_from(["token", "Secret", "passwd", "api_key", "AKIA", "=", ": ", " ", "'", "abcdef", "0123456789ab", "Z" * 16, "é", "\n", ">", "> >", "a b"]), max_size=25).map("".join)


@SOME
@given(PIECES)
def test_base_spans(text):
    found = secrets.spans(text)
    assert [s for s in found if s[2] in secrets.BASE] == base_spans(text)
    assert secrets.spans(secrets.redact(text, found).replace("[SECRET]", "")) is not None


@SOME
@given(st.lists(st.one_of(st.none(), st.text("ab \n.É", max_size=30)), max_size=12), st.integers(1, 40))
def test_slices_put_together_are_the_batch(texts, budget):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    parts = list(arrowtext.slices(batch, "t", budget))
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    assert all(p.num_rows == 1 or pc.sum(pc.binary_length(p.column("t"))).as_py() in (None, *range(budget + 1)) for p in parts)


@SOME
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_runs_are_the_groups_of_sorted_rows(keys, size):
    keys.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], ["k"]) for i in range(0, len(keys), size)]
    got = [r.column("k").to_pylist() for r in arrowtext.runs(batches, ["k"])]
    assert got == [[k] * keys.count(k) for k in sorted(set(keys))]


@SOME
@given(st.lists(st.one_of(st.none(), st.text("ab c.É1", max_size=60)), min_size=1, max_size=8))
def test_linked_sets_are_those_of_python(texts):
    hashes, counts = ngram_join.shingle_sets(pa.array(texts, pa.string()), 2)
    one, two = (np.concatenate([x, np.zeros(0, dtype=np.int64)]) for x in np.triu_indices(len(texts), 1))
    linked = ngram_join.linked_pairs(hashes, counts, one, two, 0.5)
    sets = [shingles(t, 2) for t in texts]
    assert linked.tolist() == [bool(sets[i] | sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5 for i, j in zip(one, two, strict=True)]
    lead = groups(range(len(texts)), [(int(i), int(j)) for i, j, x in zip(one, two, linked, strict=True) if x])
    assert ngram_join.leads(len(texts), one[linked], two[linked]).tolist() == [lead[i] for i in range(len(texts))]


@SOME
@given(st.lists(st.integers(0, 9), max_size=9), st.integers(1, 40))
def test_pairs_of_runs_are_all_pairs(counts, held):
    start, want = 0, set()
    for n in counts:
        want |= {(start + i, start + j) for j in range(n) for i in range(j)}
        start += n
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "PAIRS", held / 64)
        got = [(i, j) for one, two in ngram_join.pairs_of(np.array(counts, dtype=np.int64)) for i, j in zip(one.tolist(), two.tolist(), strict=True)]
    assert len(got) == len(want) and set(got) == want


@SOME
@given(st.lists(st.integers(1, 50), max_size=40))
def test_packed_bins_hold_their_sizes_without_gaps(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    for b in set(bins.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += sizes[i]
        assert at <= 50
    assert not sizes or len(set(bins.tolist())) <= max(1, 2 * sum(sizes) // 50 + 1)


@SOME
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), max_size=50))
def test_isotonic_fits_rise(rows):
    total, ones = np.zeros(10), np.zeros(10)
    for b, y in rows:
        total[b] += 1
        ones[b] += y
    fit = quality.isotonic(total, ones)
    assert (np.diff(fit) >= -1e-12).all() and ((fit >= 0) & (fit <= 1)).all()


@SOME
@given(st.sets(st.text("ab./", max_size=6), max_size=30), st.sets(st.text("ab./", max_size=6), max_size=60), st.integers(1, 10**9))
def test_cascades_are_exact(listed, others, universe):
    cascade = url_filter.Cascade(listed, universe)
    cascade.close(listed, (k for k in others if cascade.passes_first(k)))
    assert all((k in cascade) == (k in listed) for k in listed | others)


@SOME
@given(PIECES)
def test_parsing_keeps_every_line_once(text):
    own, passages = quotation.parse(text)
    if not passages:
        assert own == text
    quoted = sum(len(lines) for _, lines in passages)
    assert quoted == sum(bool(quotation.QUOTED.match(x)) for x in text.split("\n"))
    assert all(level > 0 for level, _ in passages)


def test_checksums_differ_with_any_letter():
    body = "a" * 30
    assert len({zlib.crc32((body[:i] + "b" + body[i + 1 :]).encode()) for i in range(30)}) == 30
