import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello world", "a" * 1000, "  \n\n x", "don't we'll", "<|endoftext|>", "Größe 😀 日本語 ​", "x\r\ny\t", "1234567890" * 50, "é" * 300, "ab" * 400 + "c", "퟿\x00"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_reference(ranks, reference, text):
    assert list(bpe.Encoder(ranks).encode(text)) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_equals_reference_on_any_text(ranks, reference, text):
    assert list(bpe.Encoder(ranks).encode(text)) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_long_equals_short(ranks, piece):
    assert bpe.merge_long(piece, ranks) == bpe.merge_short(piece, ranks)


def test_table(spark, ranks, reference):
    rows = [(1, "one two", "x"), (2, None, None), (3, "", "x"), (4, "é" * 70_000, "x"), (4, "one two", None), (None, "three", "x")]
    df = spark.createDataFrame(rows, "doc long, body string, ids string")
    got = sorted(((r["doc"], list(r["ids"])) for r in bpe.encode(df, "doc", "body").collect()), key=str)
    assert got == sorted(((d, reference.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    n = sorted((str(r["doc"]), r["n_tokens"]) for r in bpe.count_tokens(df, "doc", "body").collect())
    assert n == sorted((str(d), len(reference.encode_ordinary(t or ""))) for d, t, _ in rows)
    assert bpe.encode(df.where("false"), "doc", "body").count() == 0


def test_other_library_agrees(ranks):
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(os.path.dirname(bpe.DEFAULT_RANKS), "byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in TEXTS:
        assert list(bpe.Encoder(ranks).encode(text)) == t.encode(text, add_special_tokens=False).ids
