"""Encoding against another library over the same vocabulary."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseframe.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = bpe.read_ranks(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(ranks), other


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinst '\n0é")), max_size=120))
def test_same_ids(both, text):
    mine, other = both
    assert mine.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "=-" * 5000, "é" * 3000, "\n" * 999, "<|endoftext|>", " lots   of   space ", "👨‍👩‍👧" * 50, "it's they'll I'd"])
def test_long_pieces(both, text):
    mine, other = both
    assert mine.encode(text) == other.encode_ordinary(text)


def test_round_trip_and_edges(spark, both):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "  \n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.token_ids(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got.keys() == {1, 2, 3, 4}
    assert both[1].decode(got[1]) == "Hello world" and both[1].decode(got[4]) == "  \n"
    assert {r[0]: r[1] for r in bpe.token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0
