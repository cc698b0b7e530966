import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm import infill, words
from twinlens.llm.captures import snapshot_texts
from twinlens.llm.infill import fill_in_middle, gather, restore_texts, scatter
from twinlens.sources.snapshots import SNAPSHOT_DDL

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["<", "<P", "P>x", "<P>marked", "a<S>", "<<M>>", "é", "日本語 text", "a" * 5000, "a\nb\r\n\tc", "𝔘𝔫i", "<<<>>>", "x" * 300 + "é" * 300, "́á", "end>", "<S"]


def test_outputs_equal_a_plain_version_and_come_back(spark):
    rows = AWKWARD + [(f"/p{i}", t) for i, t in enumerate(ODD * 12)]
    made = fill_in_middle(pages(spark, rows), keys=["path"])
    got = sorted((tuple(r)[1:] for r in made.collect()), key=repr)
    assert got == sorted((brute(f"1:{p}" if p is not None else "1", t) for p, t in rows), key=repr)
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    back = restore_texts(made).select("path", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((p, t or "") for p, t in rows), key=repr)
    proved = fill_in_middle(pages(spark, rows), keys=["path"], prove=True).select("path", "restored").collect()
    assert sorted(map(tuple, proved), key=repr) == sorted(((p, t or "") for p, t in rows), key=repr)


def test_keys_of_several_columns_and_texts_of_stored_captures(spark):
    rows = [("source", "/a", [{"text": "One two"}, {"text": None}, {"text": "three"}]), ("target", "/a", [{"text": "One two"}]), ("target", "/b", None)]
    snapshots = spark.createDataFrame([{"side": s, "path": p, "content": c} for s, p, c in rows], SNAPSHOT_DDL)
    got = {(r["side"], r["path"]): tuple(r)[2:] for r in fill_in_middle(snapshot_texts(snapshots)).collect()}
    assert got == {(s, p): brute(f"1:{s}:{p}", t) for s, p, t in [("source", "/a", "One two\nthree"), ("target", "/a", "One two"), ("target", "/b", "")]}


def test_clashing_names_and_an_empty_table(spark):
    clash = spark.createDataFrame([("/a", "some text here", 1, "x", 5)], "path string, text string, h1 int, digest string, n int")
    assert fill_in_middle(clash, keys=["path"]).columns == ["path", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle(clash, keys=["path"]).count() == 1
    assert restore_texts(fill_in_middle(pages(spark, []), keys=["path"])).collect() == []


def test_outputs_without_their_marks_have_no_text(spark):
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<S>b<P>a<M>c", "acb"), ("psm", "<S>b<P>a<M>c", None), ("psm", "a<P><S><M>", None), ("spm", "no marks", None),
            ("psm", "<P><S><M><M>", None), ("plain", "<P>x", "<P>x"), (None, "as is", "as is"), ("psm", None, None), ("psm", "<P><S><M>", "")]
    back = restore_texts(spark.createDataFrame([(i, f, o, "old") for i, (f, o, _) in enumerate(rows)], "i int, form string, output string, text string"))
    assert {r["i"]: r["text"] for r in back.coalesce(1).collect()} == {i: t for i, (_, _, t) in enumerate(rows)}


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.text("ab<>PSM é日", max_size=40), st.integers(0, 2), st.integers(0, 40), st.integers(0, 40)), max_size=8), st.sampled_from([3, 7, 1 << 20]))
def test_scatter_and_gather_across_chunks(rows, chunk):
    raw = [t.encode() for t, *_ in rows]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    form, cuts, wanted = [], [], []
    for (text, kind, one, two), begin, r in zip(rows, at, raw):
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
            kind = 0
        a, b = sorted((min(one, len(r)), min(two, len(r))))
        if kind == 0:
            a = b = len(r)
        form.append(kind)
        cuts.append((begin + a, begin + b))
        wanted.append([r, b"<P>" + r[:a] + b"<S>" + r[b:] + b"<M>" + r[a:b], b"<S>" + r[b:] + b"<P>" + r[:a] + b"<M>" + r[a:b]][kind])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(infill, "CHUNK", chunk)
        cuts = np.array(cuts, np.int64).reshape(-1, 2)
        out, out_at = scatter(data, at, cuts[:, 0], cuts[:, 1], np.array(form, np.int64))
        assert [out[s:e].tobytes() for s, e in zip(out_at, out_at[1:])] == wanted
        back, back_at, good = gather(out, out_at, np.array(form, np.int64))
        assert good.all() and back.tobytes() == data.tobytes() and back_at.tolist() == at.tolist()
        starts = infill.token_starts(data, at)
        where = np.flatnonzero(starts)
        assert infill.counts_before(starts, at).tolist() == [int((where < p).sum()) for p in at]
        assert infill.places_of(starts, np.arange(len(where))).tolist() == where.tolist()
    assert words.CHUNK == 1 << 20
