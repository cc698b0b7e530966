import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlens.llm.words import CHUNK, alphanumeric, hash_word, powers, slices, spaced, words_of


def ascii_lower(raw: bytes) -> bytes:
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB 1\t\n.é\x00\x7f－Z", max_size=30)), max_size=6))
def test_words_match_a_regular_expression(texts):
    tables = powers(CHUNK + 1)
    for inside, pattern in ((spaced(), rb"[^\x20\x09-\x0D]+"), (alphanumeric(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, first = words_of(pa.array(texts, pa.string()), inside, tables)
        want = [re.findall(pattern, ascii_lower((t or "").encode())) for t in texts]
        assert np.diff(first).tolist() == [len(w) for w in want]
        assert got.tolist() == [hash_word(w) for ws in want for w in ws]


def test_a_word_longer_than_a_chunk_and_a_sliced_column():
    big = "x" * (CHUNK + 7)
    column = pa.array(["skip", "A " + big, None, big + " a"]).slice(1)
    got, first = words_of(column, spaced())
    assert first.tolist() == [0, 2, 2, 4] and got[0] == got[3] and got[1] == got[2] != got[0]


def test_slices_keep_every_row_in_order():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 30, 1, 1)]), pa.array(range(5))], ["text", "n"])
    parts = list(slices(batch, size=8))
    assert [x for p in parts for x in p.column("n").to_pylist()] == [0, 1, 2, 3, 4] and len(parts) == 3
