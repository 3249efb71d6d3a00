import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from specframe.llm import bpe

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    data = bpe.small_file(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Encoder(data, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(coders, text):
    own, library = coders
    ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "   ", "\n", "\t", "\r\n", "a", "th", "ing", "é", "日本", "12", "!?", "'s", "\xa0", "🙂", "\x1c", "<|endoftext|>"])))
def test_like_the_library(coders, parts):
    same(coders, "".join(parts))


def test_long_stretches(coders):
    for text in ("a" * 30_001, "abcde" * 9_999, "é" * 5_000, " " * 5_001 + "x"):
        same(coders, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abehnrstu .,'1é\n\t", max_size=60), min_size=1, max_size=8))
def test_many_texts_at_once(coders, texts):
    own, library = coders
    assert [np.frombuffer(c, "<u4").tolist() for c in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    assert not any(own.low)


def test_a_full_cache_is_emptied(coders, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    for text in ("one two three", "four five, six seven", "two. three four", "one"):
        same(coders, text)


def test_all_words_of_a_table(coders):
    own, library = coders
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    assert [np.frombuffer(c, "<u4").tolist() for c in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_query_shape(spark, coders, odd_docs, no_docs):
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    rows = bpe.digests(bpe.decode(bpe.encode(odd_docs, vocabulary), vocabulary)).collect()
    assert rows == bpe.digests(bpe.encode(odd_docs, vocabulary, decoded=True)).collect()
    want = []
    for doc_id, text, _, _ in ODD_TEXTS:
        ids = coders[1].encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, vocabulary), vocabulary)).collect() == []
