"""SentencePiece encoding and decoding against the library, on texts of all kinds."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from util import docs, prose

from lakemill.llm import piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "   ", "word", " two  words ", "▁ marks▁▁", "tab\tline\n\n é́ ß", "漢字かな한글 🙂🏽", "<s> </s> <unk> <0x0A>", "\x00\x01", "ſtraße" * 50, "x" * 20_000, "   " * 4000, prose(1, 3000)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_encoding.Model(PATH)


@pytest.fixture(scope="module")
def encoder(model):
    return piece_encoding.Encoder(model)


@pytest.fixture(scope="module")
def decoder(model):
    return piece_encoding.Decoder(model)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.text("ab▁ ", max_size=60), st.text("the in▁gon", max_size=80), st.text("aeéou \n\t漢\U0001f642", max_size=60)))
def test_ids_and_texts_are_those_of_the_library(library, decoder, encoder, text):
    ids = list(encoder.encode(text))
    assert ids == library.encode(text) and decoder.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(259, 275), st.integers(0, 31_999)), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(library, decoder, ids):
    assert decoder.decode(ids) == library.decode(ids)


def test_places_fail_once_in_long_runs(library, encoder):
    for text in ("ab" * 30_000, "é" * 20_000, "▁" * 20_000, "aab" * 20_000):
        assert list(encoder.encode(text)) == library.encode(text)


def test_compatible_pairs_are_those_that_merge_back(library, encoder):
    for left, right in (("▁th", "e"), ("▁t", "he"), ("in", "g"), ("▁▁", "▁t"), ("▁▁▁", "t"), ("▁" * 16, "▁▁"), ("▁▁", "▁" * 16)):
        # the piece in front keeps the library's own space apart
        pieces = library.encode_as_pieces("x\n" + (left + right).replace("▁", " "))
        assert encoder.compatible(left, right) == (pieces[-2:] == [left, right])


def test_stretches_change_nothing(library, model, monkeypatch):
    monkeypatch.setattr(piece_encoding, "STRETCH", 7)
    monkeypatch.setattr(piece_encoding, "REMEMBERED", 5)
    own = piece_encoding.Encoder(model)
    for text in TEXTS:
        assert list(own.encode(text)) == library.encode(text or "")


def test_models_that_normalise_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(bytes([0x1A, 0x02, 0x12, 0x00]))
    with pytest.raises(ValueError):
        piece_encoding.Model(str(tmp_path / "m"))


def test_round_trip_over_a_table(spark, library):
    df = docs(spark, TEXTS + TEXTS[5:8], doc_id=[None, *range(len(TEXTS) + 2)]).repartition(3)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_encoding.round_trip(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert piece_encoding.round_trip(df.limit(0), PATH).collect() == []
    both = piece_encoding.decode(piece_encoding.encode(df, PATH), PATH).where("doc_id = 4").first()
    assert both.text == " two  words " and both.ids == library.encode(" two  words ")
    none = piece_encoding.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), PATH)
    assert [r.text for r in none.orderBy("doc_id").collect()] == [None, ""]


def test_the_registered_query_over_all_documents(spark, data, library):
    from lakemill.llm import queries

    texts = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.QUERIES["op11_sentencepiece"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
