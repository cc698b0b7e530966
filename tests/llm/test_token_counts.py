import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm.token_counts import read_cache, token_counts

TEXTS = AWKWARD + [("/s", "a <|endoftext|> b"), ("/u", "Ünïcode 日本語 😀"), ("/v", "Hello  World!"), ("/w", "Hello  World!")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tmp_path, name):
    file = public_tokenizers.path(name)
    if name.endswith("json"):
        whole = Tokenizer.from_file(file)
        want = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    else:
        pieces = sentencepiece.SentencePieceProcessor(model_file=file)
        want = lambda t: len(pieces.encode(t))
    got = token_counts(pages(spark, TEXTS), file, str(tmp_path / "cache"), limit=100).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=repr) == sorted(((p, len((t or "").encode()), want(t or ""), want(t or "") > 100) for p, t in TEXTS), key=repr)
    assert key


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    file, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    token_counts(pages(spark, [("/a", "one two"), ("/b", "one two")]), file, cache).collect()
    first = read_cache(pages(spark, []), cache).collect()
    assert len(first) == 1
    # A planted count shows that the stored one is used.
    planted = spark.createDataFrame([(first[0]["content"], first[0]["tokenizer"], 99)], read_cache(pages(spark, []), cache).schema)
    planted.write.mode("append").parquet(cache)
    got = token_counts(pages(spark, [("/a", "one two"), ("/c", "three")]), file, cache)
    assert {r["path"]: r["n_tokens"] for r in got.collect()}["/a"] == 99
    assert read_cache(pages(spark, []), cache).count() == 3
    other = token_counts(pages(spark, [("/a", "one two")]), public_tokenizers.path("word_bpe_49k.json"), cache)
    assert other.collect()[0]["n_tokens"] == 2


def test_empty_table(spark, tmp_path):
    assert token_counts(pages(spark, []), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")).collect() == []
