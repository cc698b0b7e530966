import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, pages, prose
from twinlens.llm.near_copies import components, near_copies, page_shingles, prob_min_hash, probability_jaccard
from twinlens.llm.words import CHUNK, powers


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both, total = set(a) | set(b), 0.0
    for d in set(a) & set(b):
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both)
    return total


def groups_of(rows):
    found = {t or "": shingles(t) for _, t in rows}
    texts = list(found)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(found[a], found[b]) >= 0.8:
                root[top(a)] = top(b)
    return {t: top(t) for t in texts}


def changed(text, seed, edits):
    made, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[made.randrange(len(w))] = f"new{made.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force_with_chains_and_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] != "/long"]
    base = prose(1, 200)
    rows += [(f"/n{i:02}", changed(base, i, 1 + i % 4)) for i in range(40)]
    chain = prose(2, 200)
    for i in range(8):
        rows.append((f"/chain{i}", chain))
        chain = changed(chain, i, 3)
    rows += [(f"/one{i}", prose(50 + i, 120)) for i in range(20)] + [("/rep", "a b c d e f g " * 30), ("/rep2", "a b c d e f g " * 31), ("/rep3", "a b c d e f g")]
    passage = prose(3, 80)
    rows += [(f"/pass{i}", passage + " " + prose(80 + i, 70)) for i in range(20)]
    want = groups_of(rows)
    got = near_copies(pages(spark, rows), chunk_ids=4).collect()
    assert len(got) == len(rows)
    texts, members, least = {}, {}, {}
    for p, t in rows:
        texts.setdefault(p, []).append(t or "")
        members.setdefault(want[t or ""], []).append(p)
    for root, paths in members.items():
        least[root] = None if None in paths else min(paths)
    for r in got:
        assert r["group_path"] in {least[want[t]] for t in texts[r["path"]]}
        assert r["kept"] == (r["path"] == r["group_path"])


def test_a_signature_estimates_probability_jaccard():
    made = np.random.default_rng(3)
    values = made.integers(1, 2**63, 60).astype(np.uint64)
    values.sort()
    wa, wb = made.integers(1, 6, 50), made.integers(1, 6, 50)
    a, b = values[:50], values[10:]
    signs = prob_min_hash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 50, 100, 100]), 20_000)
    exact = similarity(Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), Counter(dict(zip(b.tolist(), wb.tolist(), strict=True))))
    assert probability_jaccard(a, wa, b, wb) == pytest.approx(exact, abs=1e-12)
    assert (signs[0] == signs[1]).mean() == pytest.approx(exact, abs=0.02)
    assert not signs[2].any()


def test_shingles_count_repeats():
    s, n, begin = page_shingles(pa.array(["a b c d e a b c d e", "a b", None, "A, b"]), powers(CHUNK + 1))
    assert begin.tolist() == [0, 5, 6, 6, 7] and sorted(n.tolist()) == [1] * 6 + [2] and s[5] == s[6]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r["id"]: r["group"] for r in components(links).collect()}
    assert set(got.values()) == {"000", "x"} and got["060"] == "000" and got["y"] == "x"


def test_empty_table_and_a_very_long_text(spark):
    assert near_copies(pages(spark, [])).collect() == []
    long = prose(9, 50_000, 9000)
    got = near_copies(pages(spark, [("/l1", long), ("/l2", changed(long, 1, 20)), ("/s", "short text")])).collect()
    assert {r["path"]: r["group_path"] for r in got} == {"/l1": "/l1", "/l2": "/l1", "/s": "/s"}
