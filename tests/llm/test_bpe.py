"""Byte-level BPE against the library whose ranks it uses, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from redgreen.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(codec, library):
    r = random.Random(3)
    alphabet = "ab \n\t'sé日1!\r x\x1c　"
    texts = ["", " ", "  ", "\n \n", "foo \nbar", "foo\n \n bar", " lead", "trail ", "t \n", "don't I'll  we're", "<|endoftext|> hi", "a\x1cb \x1c c", "ab" * 700 + "z"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_long_pieces_merge_in_the_same_order(codec, library):
    r = random.Random(4)
    for text in ["x" * 3000, "é" * 700, "".join(r.choice("abcdeftio") for _ in range(2000))]:
        assert len(text.encode()) > bpe.MATRIX_BYTES
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_what_is_remembered_changes_nothing(codec, monkeypatch):
    texts = [f"word{i} other{i}, {i}" for i in range(200)]
    small = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    small.words.half = small.known.half = 5
    one_by_one = [small.encode([t])[0].tolist() for t in texts + texts]
    assert one_by_one == [x.tolist() for x in codec.encode(texts)] * 2


def test_documents(spark, odd_documents, no_documents, library):
    rows = bpe.round_trip(odd_documents, PATH, public_tokenizers.PATTERN).collect()
    texts = odd_documents.toDF(*[str(i) for i in range(10)]).select("0", "1").collect()

    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted((row(*t) for t in texts), key=key)
    assert bpe.round_trip(no_documents, PATH, public_tokenizers.PATTERN).isEmpty()


def test_encode_and_decode_as_columns(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    ids = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    back = bpe.decode_documents(ids, PATH, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in back.collect()] == [b"a b", b""]
