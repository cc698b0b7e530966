import random

from tests.llm.helpers import AWKWARD, pages, prose
from twinlens.llm.toxicity import score_toxicity

BAD = ["dolt", "grobian", "nincompoop"]


def page(seed, bad):
    made = random.Random(seed)
    w = prose(seed, 60, 300).split()
    for _ in range(3 if bad else 0):
        w.insert(made.randrange(len(w)), made.choice([*BAD, "snirk" + made.choice(["ig", "elt", "and"])]))
    return " ".join(w)


def table(spark, n=500):
    rows = [(f"/p{i:04}", page(i, i % 5 == 0)) for i in range(n)]
    labels = spark.createDataFrame([(p, int(i % 5 == 0), "x") for i, (p, _) in enumerate(rows) if i % 3] + [("/p0001", None, "x"), (None, 1, "x")], "path string, toxic int, text string")
    return rows, labels


def test_held_out_pages_are_told_apart(spark):
    rows, labels = table(spark)
    got = {r["path"]: r for r in score_toxicity(pages(spark, rows), labels, rounds=5).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(int(p[2:]) % 5 == 0, got[p]["predicted"]) for p, _ in rows if int(p[2:]) % 3 == 0]
    assert sum(bool(a) == bool(b) for a, b in held) >= 0.95 * len(held)


def test_awkward_rows_and_too_few_labels(spark):
    rows, labels = table(spark, 120)
    got = score_toxicity(pages(spark, rows + AWKWARD), labels, rounds=2).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["path"] in ("/a", "/b")}
    assert len(empty) == 1
    none = spark.createDataFrame([], "path string, toxic int")
    assert {r["score"] for r in score_toxicity(pages(spark, AWKWARD), none).collect()} == {0.0}
    one = spark.createDataFrame([("/d", 1)], "path string, toxic int")
    assert {(r["score"], r["predicted"]) for r in score_toxicity(pages(spark, AWKWARD), one).collect()} == {(1.0, 1)}
    assert score_toxicity(pages(spark, []), labels).collect() == []
