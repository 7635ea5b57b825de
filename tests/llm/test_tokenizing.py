import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgrove.llm import tokenizing as tk

PATH = f"{tk.TOKENIZERS}/{tk.VOCABULARY}"
#: The public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    return list(tk.vocabulary(PATH).encode(texts))


def test_equals_the_public_library(reference):
    rnd = random.Random(2)
    parts = [*" '\n\t\r.,!0é漢ß\u00a0\u3000😀́", "'s", "'re", "'ll", "''", "!'s", "  ", "word", "Word's", "12", "İ", "ⅷ", "²"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    assert encode(texts) == [reference.encode_ordinary(x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_round_trip(texts):
    pairs = tk.vocabulary(PATH)
    assert [pairs.decode(x) for x in encode(texts)] == texts


def test_long_words_and_texts(reference):
    texts = ["a" * 20_000, " " * 5000 + "x", "ab1" * 30_000, "word " * 30_000]
    assert encode(texts) == [reference.encode_ordinary(x) for x in texts]


def test_slices_cover_all_texts():
    texts = ["a" * 5, None, "b" * 20, "", "c"]
    assert list(tk._slices(texts, 6)) == [(0, 3), (3, 5)]
    assert list(tk._slices([], 6)) == []


def test_columns(spark):
    rows = spark.createDataFrame([(1, "Hello world's <|endoftext|>", 5), (2, "", 5), (3, None, 5), (3, None, 5)], "doc_id long, text string, ids int")
    found = {r.doc_id: r.ids for r in tk.encode_column(rows, "doc_id", "text").collect()}
    assert found[2] == found[3] == [] and 50256 not in found[1]
    counts = [(r.doc_id, r.n_tokens) for r in tk.encode_column(rows, "doc_id", "text", count_only=True).collect()]
    assert sorted(counts) == [(1, len(found[1])), (2, 0), (3, 0), (3, 0)]
    back = {r.doc_id: r.text for r in tk.decode_column(tk.encode_column(rows, "doc_id", "text"), "doc_id").collect()}
    assert back == {1: "Hello world's <|endoftext|>", 2: "", 3: ""}
    assert tk.encode_column(rows.limit(0), "doc_id", "text").count() == 0
