import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from saffron.llm import pieces
from saffron.llm.queries import piece_model
from tests.conftest import MEDIUM
from tests.llm.rows import docs

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model())


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


@pytest.mark.parametrize(
    "text",
    ["", " ", "  two  blanks ", "a\nb\r\nc", "\n\n", "▁mark ▁▁", "x▁y", "\U0001f600 emoji", "\x00\x01nul", "日本語の文", "é combining", "a" * 3000, "é" * 999, "<s></s><unk><0x0A>", "tab\tx", "　wide nbsp", "�"],
)
def test_ids_and_texts_equal_the_library(text):
    model = pieces.load(piece_model())
    ids = LIBRARY.encode(text)
    assert list(model.encode(text)) == ids
    assert model.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  ▁\nabcdeéßñ.,!0123456789"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_equals_the_library(text):
    model = pieces.load(piece_model())
    ids = LIBRARY.encode(text)
    assert list(model.encode(text)) == ids
    assert model.decode(ids) == LIBRARY.decode(ids)


def test_digests_of_documents(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    have = {r["doc_id"]: r for r in pieces.digests(df, piece_model()).collect()}
    for r in df.collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert (have[r["doc_id"]]["n_tokens"], have[r["doc_id"]]["ids_sha256"], have[r["doc_id"]]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_odd_rows_and_round_trip(spark):
    df = docs(spark, clash=True)
    encoded = pieces.with_ids(df, piece_model())
    assert sorted(encoded.columns) == sorted(df.columns)
    for r in encoded.collect():
        assert r["ids"] == LIBRARY.encode(r["text"] or "")
    back = pieces.decode(pieces.encode(df.where("doc_id < 13"), piece_model()), piece_model())
    have = {r["doc_id"]: r["text"] for r in back.collect()}
    assert have == {r["doc_id"]: LIBRARY.decode(LIBRARY.encode(r["text"] or "")) for r in df.where("doc_id < 13").collect()}
    assert pieces.digests(docs(spark, []), piece_model()).count() == 0
