import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm.exact_copies import exact_copies, golomb_decode, golomb_encode


@settings(deadline=None, max_examples=80)
@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=200), st.integers(0, 2**60))
def test_golomb_codes_come_back(values, low):
    sorted_values = np.array(sorted(values), np.uint64) + np.uint64(low)
    code, k = golomb_encode(sorted_values, low, 2**41)
    assert golomb_decode(code, len(sorted_values), k, low).tolist() == sorted_values.tolist()


def brute(rows):
    groups = {}
    for path, text in rows:
        groups.setdefault(text or "", []).append(path)
    out = []
    for path, text in rows:
        same = groups[text or ""]
        known = [p for p in same if p is not None]
        keep = max(known) if known else None
        out.append((path, keep, len(same), path == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force_with_awkward_rows(spark):
    rows = AWKWARD + [(f"/p{i}", f"text {i % 7}") for i in range(60)] + [(f"/q{i}", "hot") for i in range(90)] + [("/case", "HOT"), ("/end", "hot ")]
    got = exact_copies(pages(spark, rows), part_rows=16, owner_rows=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert exact_copies(pages(spark, [])).collect() == []
