"""Column functions on example values."""

import re

import pytest
from pyspark.sql import functions as F

from twinlens.config import PathMap, Rewrite, UrlRules
from twinlens.functions import cssvals, images, prices, text, urls, values


def one(spark, data, ddl, *cols):
    rows = spark.createDataFrame(data, ddl).select(*cols).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in rows]


def test_normalize_text(spark):
    given = [
        "  Hello\u00a0 world \n\t here  ", "\u201cDon\u2019t\u201d \u2014 really", "Hy\u00adphen\u200bation",
        "\uff28\uff45\uff4c\uff4c\uff4f", "Buy Now!", "   \n ",
    ]
    got = one(spark, [(v,) for v in given], "v string", text.normalize_text(F.col("v")))
    assert got == ["Hello world here", "\"Don't\" - really", "Hyphenation", "Hello", "Buy Now!", ""]
    stamped = text.normalize_text(F.lit("Updated 02/09/2026 by admin"), [r"\d{2}/\d{2}/\d{4}"])
    assert one(spark, [(1,)], "i int", stamped, text.normalize_text(F.lit("a1 b2"), [r"\d+"])) == [("Updated by admin", "a b")]


def test_similarity_and_truncate(spark):
    pairs = [("Buy now", "Buy now"), ("Buy now", "Contact support"), ("Buy now", "Buy it now"), ("", "x"), ("", "")]
    got = one(spark, pairs, "a string, b string", text.trigram_similarity(F.col("a"), F.col("b")))
    assert got[0] == 1 and got[1] < 0.2 and got[2] > 0.6 and got[3] == 0 and got[4] == 1
    cut = one(spark, [("short", 1), ("the quick brown fox jumps", 2)], "v string, i int", text.truncate(F.col("v"), 16))
    assert cut == ["short", "the quick brown..."]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTPS://Example.com:443/About/Index.html", "/about"),
        ("https://e.com//a///b/", "/a/b"),
        ("https://e.com/p?b=2&utm_source=x&a=1&gclid=3", "/p?a=1&b=2"),
        ("https://e.com/p#pricing", "/p"),
        ("https://e.com/#/products/hats", "/#/products/hats"),
        ("https://e.com/F\u00fcr", "/f%c3%bcr"),
        ("https://e.com/a/./b/../c?x=a%20b", "/a/c?x=a+b"),
        ("https://e.com", "/"),
        ("mailto:a@b.c", None),
    ],
)
def test_canonical_key(spark, url, key):
    df = urls.canonicalize(spark.createDataFrame([(url,)], "u string"), "u")
    assert df.first()["c_key"] == key


def test_url_rules(spark):
    df = spark.createDataFrame([("https://e.com/a?x=1&keep=2",)], "u string")
    rules = UrlRules(trailing_slash="add", query_allowlist=("keep",))
    assert urls.canonicalize(df, "u", rules).first()["c_key"] == "/a/?keep=2"


def test_path_mapping(spark):
    mapping = PathMap({"/products.aspx": "/products"}, (Rewrite(r"^/old/(.*)", "/new/$1"), Rewrite("a", "b")))
    got = one(
        spark, [("/products.aspx",), ("/old/x",), ("/banana",), ("/z",)], "p string", urls.map_path(F.col("p"), mapping)
    )
    assert got == ["/products", "/new/x", "/bbnana", "/z"]


def test_resolve_and_classify(spark):
    page = "https://e.com/dir/page?q=1#x"
    cases = {
        "next": "https://e.com/dir/next", "/abs": "https://e.com/abs", "//h/x": "https://h/x", "#top": None,
        "#/route": "https://e.com/dir/page?q=1#/route", "mailto:a@b": None, "": None, "?z": "https://e.com/dir/page?z",
    }
    got = one(spark, [(h, page) for h in cases], "h string, p string", urls.resolve_href(F.col("h"), F.col("p")))
    assert got == list(cases.values())


def test_prices(spark):
    cases = {
        "$1,299.00": (1299.0, "USD"), "USD 1\u00a0299,00": (1299.0, "USD"), "1.299,00 EUR": (1299.0, "EUR"), "1,299": (1299.0, None),
        "12,99": (12.99, None), "1.234.567": (1234567.0, None), "-5.50": (-5.5, None), "\u00a349.99": (49.99, "GBP"),
        "Price on application": None,
    }
    got = one(spark, [(r,) for r in cases], "r string", prices.parse_price(F.col("r")))
    assert [None if g is None else (g.amount, g.currency) for g in got] == list(cases.values())


def test_asset_keys(spark):
    cases = {
        "https://cdn/x/hero.a1b2c3d4.webp": "hero", "/_next/image?url=%2Fimg%2Fhero.a1b2c3d4.webp&w=828": "hero",
        "https://r/upload/w_300,c_fill/hero.jpg": "hero", "/-/media/root/Hero.ashx?h=400": "hero", "": "",
        "data:image/png;base64,AAAA": "data:data:image/png;base64,AAAA",
    }
    df = images.with_asset_key(spark.createDataFrame([(s,) for s in cases], "s string"), "s")
    assert {r.s: r.asset_key for r in df.collect()} == cases


CSS = [
    ("color", "#fff", "rgb(255, 255, 255)", "equal"),
    ("color", "white", "hsl(0, 0%, 100%)", "equal"),
    ("color", "rgb(0,0,0)", "rgb(1,1,1)", "equal"),
    ("color", "rgb(26,29,33)", "rgb(40,44,50)", "color"),
    ("font-size", "16px", "16.0000px", "equal"),
    ("font-size", "32px", "28px", "length"),
    ("font-family", '"Helvetica Neue", Arial', "Helvetica Neue, Arial", "equal"),
    ("font-family", "Arial, serif", "Arial, sans-serif", "font-fallback"),
    ("box-shadow", "0 1px 2px #000", "0 1px 2px rgb(0, 0, 0)", "equal"),
    ("box-shadow", "0 1px 2px #000", "0 1px 2px #f00", "color"),
    ("box-shadow", "0 1px 2px #000", "0 3px 2px #000", "value"),
    ("margin-top", "auto", "4px", "value"),
]


def test_css_comparison(spark):
    df = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(CSS)], "i int, property string, source_value string, target_value string"
    )
    got = [r.kind for r in cssvals.compare_css(df).orderBy("i").collect()]
    assert got == [c[3] for c in CSS]


def claimed_values(sentence: str) -> dict[str, list[str]]:
    """Sequential claiming over the same fixed patterns."""
    low, claimed, out = sentence.lower(), set(), {}
    for name, pattern in values.PATTERNS.items():
        pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), pattern)
        hits = []
        for m in re.finditer(pattern, low, re.ASCII):
            span = set(range(*m.span()))
            if not span & claimed:
                claimed |= span
                hits.append(re.sub(r"\s+", " ", m.group()).strip())
        out[name] = sorted(hits)
    return out


SENTENCES = [
    "Fees are non-refundable. Pay $49.99 within 30 days or 10% more.",
    "Call 555 123 4567 before 12/05/2024 555 123 4567, not later.",
    "On 5 March 2024 and March 7, 2024 you can't pay 7 dollars or 1,200.50 eur; mail me@x.org",
    "\u00f1no no \u00fcno 3 business days",
    "2024-01-05 14 hours 3 weeks 12 months 99",
]


def test_value_extraction_matches_sequential_claiming(spark):
    df = spark.createDataFrame([(s,) for s in SENTENCES], "s string").select("s", values.critical_values(F.col("s")).alias("v"))
    for r in df.collect():
        assert {k: v for k, v in r.v.asDict().items() if k != "modal"} == claimed_values(r.s)


@pytest.mark.parametrize(
    ("a", "b", "classes"),
    [
        ("Fees are non-refundable.", "Fees are refundable.", ["negation"]),
        ("Pay $45 in 14 days", "Pay $49 in 30 days", ["amount", "duration"]),
        ("Documents must be certified", "Documents should be certified", ["modal"]),
        ("You must renew before the expiry date.", "Renew before it expires.", []),
        ("It costs $5 and $5", "It costs $5", ["amount"]),
        ("Same words 7", "Words same 7", []),
    ],
)
def test_value_changes(spark, a, b, classes):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(values.value_changes(F.col("a"), F.col("b")).alias("c"))
    assert [c["class"] for c in df.first().c] == classes


def test_values_of_a_long_text_take_time_in_proportion():
    """A text of a MB with a value at every word; copies and order are kept."""
    text = "pay $5 on 2024-01-05 or 7 days not 99 " * 27_000
    found = values.claim_values(text)
    assert len(text) > 1_000_000
    assert {k: len(v) for k, v in found.items()} == {k: 0 if k == "contact" else 27_000 for k in values.PATTERNS}
    assert len(values.minus(found["number"], found["number"][1:])) == 1


def test_differences_count_copies(spark):
    rows = [(["a", "a", "b"], ["a"]), (["a"], ["a", "a"]), ([], ["x"]), (None, ["x"]), (["x", "y", "y", "z"], ["y", "q"])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>").select("i", values.multiset_minus(F.col("a"), F.col("b")).alias("m"))
    assert {r.i: r.m for r in got.collect()} == {0: ["a", "b"], 1: [], 2: [], 3: None, 4: ["x", "y", "z"]}


def test_plain_and_folded_texts_normalise_alike(spark):
    from twinlens.functions.text import normalize_text

    cases = {"a  b": "a b", " a\tb ": "a b", "a b": "a b", "it’s — x": "it's - x", "so­ft": "soft", "﻿z": "z", "Grüße, a-b": "Grüße, a-b", "　\U0001f600": "\U0001f600"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string").withColumn("got", normalize_text(F.col("raw"), ("a b",)))
    assert {r["raw"]: r["got"] for r in rows.collect()} == {k: "" if v == "a b" else v for k, v in cases.items()}


def test_node_texts_are_normalised_once(spark, monkeypatch):
    from twinlens.operators import content

    seen = []
    kept = content.cut_lineage
    monkeypatch.setattr(content, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    raw = spark.createDataFrame([("source", "/p", 0, "main", "paragraph", " x ", None), ("source", "/p", 1, "main", "paragraph", " ", None)], "side string, path string, pos long, region string, kind string, text string, src string")
    assert [r["text"] for r in content.assemble_nodes(raw).collect()] == ["x"]
    assert seen[0].count("ArrowEvalPython") == 1
