import random
import re

from tests.llm.helpers import AWKWARD, pages, prose
from twinlens.llm.decontaminate import build_index, decontaminate, find_passages
from twinlens.llm.shared import keep

ITEMS = "item_id long, text string, source string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(text, items, window=13):
    own, hit, ids = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[i : i + n]:
                    hit |= set(range(at, at + n))
                    ids.add(item)
    named = sorted(str(i) for i in ids if i is not None)
    return len(own), len(hit), named, bool(hit) and 20 * len(hit) >= len(own)


def cases():
    made = random.Random(5)
    items = [(i, prose(i, made.choice([3, 12, 13, 14, 40]), 30)) for i in range(12)]
    items += [(12, None), (13, ""), (14, items[4][1]), (4, items[4][1]), (15, "same same same same same same same same same same same same same same same")]
    rows = AWKWARD + [(f"/r{i}", prose(100 + i, 80, 30)) for i in range(15)]
    for i in range(12):
        w = items[i][1].split()
        rows.append((f"/copy{i}", prose(200 + i, 20) + " " + " ".join(w[: max(13, len(w) - 3)]).upper() + ". " + prose(300 + i, 30)))
    rows += [("/twice", items[4][1] + " - " + items[4][1]), ("/thin", prose(1, 1000) + " " + items[4][1]), ("/same", "Same, " * 40), ("/edge", items[4][1])]
    return items, rows


def test_equals_brute_force(spark):
    items, rows = cases()
    got = decontaminate(pages(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    assert sorted(((r["path"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got.collect()), key=repr) == sorted(((p, *brute(t, items)) for p, t in rows), key=repr)


def test_blocks_of_items_give_the_same(spark):
    items, rows = cases()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    index = build_index(pages(spark, rows))
    key = ("shard", "begin", "item_id", "kind", "low", "high")
    one, many = (sorted(map(tuple, keep(find_passages(index, table, at_once=n)).select(*key).collect()), key=repr) for n in (1000, 3))
    assert one == many and one


def test_proximity_takes_words_in_any_order(spark):
    rows = [("/near", "zeta x alpha y beta"), ("/far", "alpha " + "x " * 30 + "beta zeta"), ("/exact", "alpha beta zeta")]
    items = spark.createDataFrame([(1, "alpha beta zeta", "x")], ITEMS)
    index = build_index(pages(spark, rows))
    found = find_passages(index, items, slack=3)
    names = index.filter("begin is not null").select("shard", "begin", "path")
    got = {(r["path"], r["kind"]) for r in found.join(names, ["shard", "begin"]).collect()}
    assert got == {("/near", "near"), ("/exact", "near"), ("/exact", "exact")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate(pages(spark, []), none).collect() == []
    got = decontaminate(pages(spark, [("/a", "one")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(1, 0, 0, False)]
