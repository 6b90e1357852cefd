"""Token counts against the library over whole texts, with chunks so small that overlaps must be widened."""

import random

import pytest

import public_tokenizers
from quirelight.llm import counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(tokenizer, rows):
    return sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in rows), key=str)


def odd_texts():
    rng = random.Random(3)
    parts = ["a" * 90, " <|endoftext|>", "<|endoftext|>  ", "  ", "\n\n \n", "it's", "'ll", "'", "漢字", "é", "foo", "12345", "  <|endof", "...!!", " ", "\x1c \x1d", "  x", "The quick ", "　", "😀"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    return rows + [(1000, None), (None, "x" * 3000), (1001, " " * 2000), (1002, "a b " * 2000), (1003, ""), (1002, "a b " * 2000), (1004, "<|endoftext|>" * 200)]


@pytest.mark.parametrize(("chunk", "overlap"), [(counts.CHUNK, counts.OVERLAP), (64, 24), (200, 16)])
def test_counts(spark, tokenizer, chunk, overlap):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id long, text string, digest string, k int")
    assert sorted(map(tuple, counts.count_tokens(df, PATH, chunk, overlap).collect()), key=str) == want(tokenizer, rows)


def test_other_vocabularies_are_applied_to_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [("a", "Hello there, " * 50), ("b", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, counts.count_tokens(df, path, 64, 16).collect()), key=str) == want(Tokenizer.from_file(path), rows)


def test_empty_table(spark):
    assert counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, sf, tokenizer):
    df = counts.op13_token_counts(spark, sf)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(((*r, r[2] > 512) for r in want(tokenizer, rows)), key=str)
