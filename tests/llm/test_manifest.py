import hashlib
import random

import pytest
from pyspark.sql import functions as F

from twinlens.llm.manifest import OpenTree, fold_root, page_leaf, proof_digest, seal_pages
from twinlens.sources.snapshots import SNAPSHOT_DDL

DDL = "side string, path long, text string, tree int, carried string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of a list of digests, and for each of them its levels: siblings left and right."""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, groups = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j, group in enumerate(members[i : i + 3]):
                for m in group:
                    proofs[m].append((run[:j], run[j + 1 :]))
            above.append(digest(*run))
            groups.append(sum(members[i : i + 3], []))
        nodes, members = above, groups
    return nodes[0], proofs


def brute(rows):
    """The plain tree over (side, path, text) rows."""
    sides = {}
    for side, path, text in rows:
        sides.setdefault(side, []).append((path is not None, path or 0, leaf_of(path, side, text), path, text))
    order = sorted(sides, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: climb([r[2] for r in sorted(sides[s], key=lambda r: r[:3])]) for s in order}
    root, upper = climb([subs[s][0] for s in order])
    out = []
    for s, up in zip(order, upper):
        for r, proof in zip(sorted(sides[s], key=lambda r: r[:3]), subs[s][1]):
            out.append((s, r[3], r[2], subs[s][0], root, [("".join(a), "".join(b)) for a, b in proof + up]))
    return out


def sealed(spark, rows, levels):
    made = seal_pages(spark.createDataFrame([(s, p, t, 7, "x") for s, p, t in rows], DDL), ["path", "side", "text"], ["text", "carried"], levels)
    return made.withColumns({"proof": proof_digest("witness"), "same": fold_root("witness", F.col("leaf")), "other": fold_root("witness", page_leaf("path", "side", F.concat("text", F.lit("!"))))})


def check(spark, rows, levels):
    got = sealed(spark, rows, levels).collect()
    plain = brute(rows)
    seen = [(r["side"], r["path"], r["leaf"], r["subroot"], r["root"], [(w["left"].hex(), w["right"].hex()) for w in r["witness"]]) for r in got]
    assert sorted(seen, key=repr) == sorted(plain, key=repr)
    proofs = {digest(*(a + b for a, b in w)) for *_, w in plain}
    assert {r["proof"] for r in got} == proofs
    for r in got:
        assert r["same"] == r["root"] and r["carried"] == "x"
        assert r["text"] is None or r["other"] != r["root"]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_witnesses_equal_a_plain_tree(spark, levels):
    made = random.Random(levels)
    rows = [("source", made.randrange(10**6), f"t{i}") for i in range(85)] + [("target", i, None if i % 5 else "") for i in range(28)]
    rows += [(f"s{n}", i, "x\ny") for n in range(1, 12) for i in range(n)] + [(None, 1, "no side"), (None, None, "no path"), ("é", 1, "日本語"), ("long", 1, "word " * 50_000)]
    check(spark, rows, levels)


def test_repeated_rows_one_row_and_no_row(spark):
    check(spark, [("a", 1, "same")] * 5 + [("a", 1, "other")] * 2 + [(None, None, None)] * 4, 1)
    check(spark, [("a", 1, "alone")], 6)
    assert sealed(spark, [], 2).collect() == []


def test_an_open_tree_extends_what_is_open():
    tree = OpenTree()
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    for node in nodes:
        tree.append(node)
    # The last two are open, each a part of the other's witness; the three before are closed.
    assert [len(run) for run in tree.open] == [2, 1]
    assert tree.right[4] == nodes[4] and tree.left[5] == nodes[3] and tree.left[2] == nodes[0] + nodes[1]
    assert tree.close(None).hex() == climb([n.hex() for n in nodes])[0]


def test_stored_captures_are_sealed_by_their_fields(spark):
    rows = [{"side": s, "path": p, "status": 200, "finalUrl": f"http://x{p}", "contentHash": "c"} for s in ("source", "target") for p in ("/a", "/b")]
    made = seal_pages(spark.createDataFrame(rows, SNAPSHOT_DDL)).collect()
    assert {r["leaf"] for r in made} == {leaf_of(p, s, None, f"http://x{p}", 200, None, "c") for s in ("source", "target") for p in ("/a", "/b")}
    assert len({r["root"] for r in made}) == 1 and len({r["subroot"] for r in made}) == 2
