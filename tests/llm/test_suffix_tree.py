import math
import time
from collections import Counter
from pathlib import Path

import pytest

from tests.llm.helpers import AWKWARD, prose
from twinlens.llm.suffix_tree import learn_tree, score_pages

START, END = "<start>", "<end>"


def tokens(text):
    return [w.decode() for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()] + [END]


class Tree:
    """The same tree by plain dictionaries."""

    def __init__(self, training, depth=3, context_share=1e-4, next_share=2e-6, gain=1.0, discount=0.5):
        seqs = [[START, *tokens(t)] for t in training]
        self.count = Counter(w for s in seqs for w in s[1:])
        self.total, self.distinct = sum(self.count.values()), len(self.count)
        self.states = {}
        if not self.total:
            return
        least, low = max(2, context_share * self.total), max(2, next_share * self.total)
        level = {(w,): n for w, n in self.count.items() if n >= least and w != END}
        if self.count[END] >= least:
            level[(START,)] = self.count[END]
        for d in range(1, depth + 1):
            pairs = Counter()
            for s in seqs:
                for i in range(d, len(s)):
                    context = tuple(s[i - d : i])
                    if context in level:
                        pairs[context, s[i]] += 1
            pairs = {k: n for k, n in pairs.items() if n >= low and self.count[k[1]] >= low}
            found = {}
            for context, times in level.items():
                own = {w: n for (c, w), n in pairs.items() if c == context}
                if not own:
                    continue
                left = 1 - sum(n - discount for n in own.values()) / times
                p = {w: (n - discount) / times + left * self.chance(context[1:], w) for w, n in own.items()}
                q = {w: self.chance(context[1:], w) for w in own}
                gained = sum(n * math.log(p[w] / q[w]) for w, n in own.items())
                others = times - sum(own.values())
                if others:
                    gained += others * math.log(max(1 - sum(p.values()), 1e-12) / max(1 - sum(q.values()), 1e-12))
                if gained > gain * 0.5 * math.log(self.total) * len(own):
                    found[context] = (left, {w: (n - discount) / times for w, n in own.items()})
            self.states |= found
            level = {(*c, w): n for (c, w), n in pairs.items() if n >= least and w != END}

    def root(self, w):
        return (self.count[w] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def chance(self, context, w):
        p = self.root(w)
        for d in range(1, len(context) + 1):
            state = self.states.get(tuple(context[-d:]))
            if state:
                p = state[0] * p + state[1].get(w, 0.0)
        return p

    def score(self, text, depth=3):
        s = [START, *tokens(text)]
        return sum(math.log10(self.chance(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s)))


SETTINGS = {"context_share": 0.002, "next_share": 0.001, "gain": 0.3}


def corpus():
    rows = [(f"/p{i}", prose(i, 60, 12) + " free returns on all orders " + prose(99 + i, 20, 9), i % 4 != 0) for i in range(60)]
    rows += [(f"/q{i}", "the price of the order is the price of the return " * 3, i % 3 != 0) for i in range(12)]
    return rows + [(p, t, False) for p, t in AWKWARD] + [("/null", "the price", None), ("/train-null", None, True)]


def table(spark, rows):
    return spark.createDataFrame([(p, t, x, "main") for p, t, x in rows], "path string, text string, training boolean, n_tokens string")


def test_scores_equal_a_plain_tree(spark):
    rows = corpus()
    tree = Tree([t for _, t, x in rows if x], **SETTINGS)
    assert any(len(c) == 2 for c in tree.states) and any(len(c) == 1 for c in tree.states)
    got = score_pages(table(spark, rows), block_bytes=4000, **SETTINGS).collect()
    key = lambda r: repr((r[0], r[1]))
    want = []
    for p, t, x in rows:
        own = tokens(t)
        base = sum(math.log10(tree.root(w)) for w in own)
        want.append((p, bool(x), len(own), sum(tree.count[w] > 0 for w in own), tree.total, base, tree.score(t)))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=lambda r: repr((r[0], r[1], r[2]))), sorted(want, key=lambda r: repr((r[0], r[1], r[2]))), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert key


def test_the_chances_of_all_next_words_sum_to_one():
    rows = corpus()
    tree = Tree([t for _, t, x in rows if x], **SETTINGS)
    for context in [(), ("the",), ("price", "of"), ("of", "the"), (START,), ("unknown",)]:
        seen = sum(tree.chance(context, w) for w in tree.count)
        assert seen + tree.chance(context, "never seen") == pytest.approx(1.0)


def test_held_out_pages_score_above_the_root(spark):
    got = score_pages(table(spark, corpus()), **SETTINGS).filter("path like '/q%' and not training").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_no_training_and_no_rows(spark):
    got = score_pages(table(spark, [("/a", "x y", False)])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)]
    assert score_pages(table(spark, [])).collect() == []
    words = spark.createDataFrame([], "token long, n long")
    assert learn_tree(spark.createDataFrame([], "text string"), words) == []


def test_rare_contexts_keep_their_states_in_a_large_text(spark):
    # In 60,000 tokens a share of 1e-4 asks for 6 occurrences; this phrase has three.
    rare = " ".join(f"zq{i}" for i in range(8))
    rows = [(f"/p{i}", prose(i, 600, 3000), True) for i in range(100)] + [(f"/r{i}", prose(900 + i, 20, 3000) + " " + rare, True) for i in range(3)]
    rows.append(("/held-out", rare, False))
    tree = Tree([t for _, t, x in rows if x], context_share=0, next_share=0)
    assert {("zq1",), ("zq1", "zq2"), ("zq1", "zq2", "zq3")} & set(tree.states)
    got = {r["path"]: r for r in score_pages(table(spark, rows), block_bytes=100_000).collect()}
    for p, t, _ in rows:
        assert got[p]["score"] == pytest.approx(tree.score(t), rel=1e-9)
    assert got["/held-out"]["score"] > got["/held-out"]["base_score"] + 8


def test_buckets_and_hot_words_change_nothing(spark):
    rows = corpus()
    tree = Tree([t for _, t, x in rows if x], context_share=0, next_share=0, gain=0.3)
    assert sum(n > 40 for w, n in tree.count.items() if w != END) > 3 and {len(c) for c in tree.states} == {1, 2, 3}
    for cuts in ({"bucket_tokens": 300, "hot_tokens": 40}, {"bucket_tokens": 300, "hot_tokens": 0}, {}):
        got = score_pages(table(spark, rows), block_bytes=4000, gain=0.3, **cuts).collect()
        want = sorted((repr(p), len(tokens(t)), tree.score(t)) for p, t, _ in rows)
        for g, w in zip(sorted((repr(r["path"]), r["n_tokens"], r["score"]) for r in got), want, strict=True):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9)


def test_learning_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirs() for f in Path(str(d)).rglob("shuffle_*")}
    before = files()
    pages = score_pages(table(spark, corpus()), hot_tokens=40)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert pages.count() == len(corpus())
