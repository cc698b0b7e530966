from functools import cache
from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm.pieces import UNIGRAM, Walker, decode_pages, encode_pages, read_model

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = AWKWARD[:-1] + [("/long", "word " * 5000 + "x" * 3000), ("/w", "  two  spaces \t\n"), ("/u", "héllo 日本語 😀 ﬁ"), ("/m", "a▁b"), ("/z", "\x00\x01 é")]


@cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@cache
def model():
    with open(FILE, "rb") as file:
        return file.read()


def test_ids_equal_the_library_and_texts_come_back(spark):
    encoded = encode_pages(pages(spark, TEXTS), model())
    got = encoded.collect()
    want = [(p, library().encode(t or "")) for p, t in TEXTS]
    assert sorted(((r["path"], list(r["ids"])) for r in got), key=repr) == sorted(want, key=repr)
    back = decode_pages(encoded, model()).collect()
    assert sorted(((r["path"], r["text"]) for r in back), key=repr) == sorted(((p, (t or "").replace("▁", " ")) for p, t in TEXTS), key=repr)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="aenrstiouh THE,.é日0", min_size=1, max_size=40), min_size=1, max_size=5))
def test_walk_over_sorted_words_equals_the_library(texts):
    walker = walkers()
    for text in sorted({t.replace(" ", "▁") for t in texts}):
        word = "▁" + text.replace("▁", "x")
        assert walker.encode_ids(word) == library().encode(word.replace("▁", " ")[1:])


@cache
def walkers():
    return Walker(read_model(model()))


def test_unigram_words_have_the_best_sum_of_scores():
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.1, "bab": -3.3, "aba": -3.2, "▁ab": -4.0}
    toy = {"kind": UNIGRAM, "ids": {p: i for i, p in enumerate(pieces)}, "scores": list(pieces.values()), "longest": 3, "byte_fallback": False, "unknown": 99, "bytes": {}}
    walker = Walker(toy)

    def best(word):
        scores = []
        for n in range(len(word)):
            for cuts in combinations(range(1, len(word)), n):
                parts = [word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)), strict=True)]
                if all(p in pieces for p in parts):
                    scores.append(sum(pieces[p] for p in parts))
        return max(scores)

    for word in sorted(["▁abab", "▁ababa", "▁bab", "▁babab", "▁a", "▁", "▁abba"]):
        got = walker.encode(word)
        assert "".join(got) == word and sum(pieces[p] for p in got) == pytest.approx(best(word))
    assert walker.encode_ids("▁xya") == [0, 99, 2]


def test_ids_that_encode_no_text(spark):
    cut = library().encode("日😀")[:-1]
    rows = spark.createDataFrame([("/a", [library().piece_to_id("<0xF0>")]), ("/b", None), ("/c", cut), ("/d", [])], "path string, ids array<int>")
    got = {r["path"]: r["text"] for r in decode_pages(rows, model()).collect()}
    assert got["/a"] == "�" and got["/b"] == got["/d"] == ""


def test_empty_table(spark):
    assert encode_pages(pages(spark, []), model()).collect() == []
