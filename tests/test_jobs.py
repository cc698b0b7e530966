"""Whole jobs on small fixtures: scans, intake, stream, comparison, run diff."""

import random

import pytest
from pyspark.sql import functions as F

from twinlens.operators import findings, intake, rundiff, scan
from twinlens.plans import compare
from twinlens.sources import snapshots as store


def test_running_aggregates_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    data = [(g, p, rng.randrange(50)) for g in "ab" for p in range(37)]
    df = spark.createDataFrame(data, "g string, p bigint, v bigint")
    for how, fold in (("max", max), ("min", min), ("sum", sum)):
        for reverse in (False, True):
            got = scan.running(df, ["g"], "p", F.col("v"), "o", how, reverse, inclusive=False, chunk=5).collect()
            for r in got:
                seen = [v for g, p, v in data if g == r.g and (p > r.p if reverse else p < r.p)]
                assert (r.o or 0) == (fold(seen) if seen else 0), (how, reverse, r)


def sequential_verdicts(offers, max_depth):
    best, queued, out = {}, set(), {}
    for seq, href, depth in sorted(offers):
        if href in best and best[href] <= depth:
            out[seq] = "duplicate"
            continue
        best[href] = depth
        if depth > max_depth:
            out[seq] = "depth-exceeded"
        else:
            out[seq] = "promoted" if href in queued else "accepted"
            queued.add(href)
    return out


@pytest.fixture(scope="module")
def offers():
    rng = random.Random(3)
    return [(i, f"h{rng.randrange(5)}", rng.randrange(5)) for i in range(80)]


def test_offer_decisions_match_sequential_ones(spark, offers):
    df = spark.createDataFrame(offers, "seq bigint, c_href string, depth int").withColumns(
        {"side": F.lit("source"), "reject": F.lit(None).cast("string")}
    )
    got = {r.seq: r.decision for r in intake.decide_offers(df, 2).collect()}
    assert got == sequential_verdicts(offers, 2)


def test_stream_decides_like_batch(spark, offers, tmp_path):
    from twinlens.streaming.intake import decide_stream

    df = spark.createDataFrame(offers, "seq bigint, c_href string, depth int").withColumn("side", F.lit("source"))
    for part in range(3):  # files are read by age, one a batch
        df.where(f"seq div 27 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = decide_stream(stream, 2, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert {r.seq: r.decision for r in rows} == sequential_verdicts(offers, 2)


def test_captures_in_batches_own_what_the_whole_table_owns(spark, tmp_path, monkeypatch):
    from twinlens.streaming import intake as streaming

    monkeypatch.setattr(streaming, "COMPACT_EVERY", 2)
    rng = random.Random(8)
    rows = [(i, f"h{rng.randrange(9)}", rng.choice([None, f"h{rng.randrange(9)}"]), rng.choice([None, "x", "x", "y", "z"])) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, href string, final_href string, content_hash string").withColumn("side", F.lit("source"))
    place = f"{tmp_path}/in"
    got = {}
    for part in range(4):
        df.where(f"seq div 15 = {part}").write.parquet(f"{place}/{part}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(place)
        got = streaming.capture_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    outcomes = {r.seq: r.outcome for r in intake.redirect_aliases(df).collect()}
    aliases = {r.seq: r.alias_of for r in intake.content_aliases(df.where("content_hash IS NOT NULL")).collect()}
    assert len(got) == 60
    assert {r.seq: r.outcome for r in got if r.outcome} == outcomes
    assert {r.seq: r.alias_of for r in got if r.alias_of} == aliases


def test_reject_reasons_in_order(spark):
    from twinlens.config import IntakeRules

    rules = IntakeRules(base_url="https://e.com/shop", exclude=("/x",), ignore_paths=("/i",), include=("^/shop",))
    urls = {
        "https://other.com/shop": "off-origin", "https://e.com/else": "off-origin", "https://e.com/shop/a/a/a": "trap",
        "https://e.com/shop/x": "excluded", "https://e.com/shop/i": "ignored-path", "https://e.com/shop/ok": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.reject for r in intake.classify_offers(df, rules).collect()} == urls


def node(i, text, kind="paragraph", region="main", **attrs):
    import hashlib

    family = "text" if kind in ("paragraph", "listItem", "tableCell") else kind
    key = hashlib.sha1(f"{family}:{text}".encode()).hexdigest()
    return {"key": key, "ordinal": 0, "region": region, "kind": kind, "text": text, "attrs": attrs, "selectorHint": f"p{i}"}


def style(n, visible=True, **props):
    return {"nodeKey": n["key"], "ordinal": 0, "region": n["region"], "props": props, "visible": visible,
            "box": {"x": 0.0, "y": 0.0, "width": 200.0, "height": 40.0}}


def snapshot(side, path, nodes, status=200, links=(), prices=(), styles=(), title="T"):
    host = "https://legacy.example" if side == "source" else "https://new.example"
    return {
        "schemaVersion": 1, "side": side, "requestedUrl": host + path, "finalUrl": host + path, "path": path, "depth": 0,
        "status": status, "redirectChain": [], "aliases": [], "title": title, "content": nodes, "images": [],
        "links": [{"href": p, "resolved": host + p, "path": p, "text": p, "kind": "internal", "region": "nav", "visible": True}
                  for p in links],
        "prices": [{"amount": a, "currency": "USD", "raw": r, "source": "text", "region": "main", "context": c} for a, r, c in prices],
        "viewports": [{"viewport": v, "width": w, "height": 800, "deviceScaleFactor": 1.0, "styles": list(styles),
                       "documentHeight": 900.0, "hasHorizontalOverflow": False} for v, w in (("desktop", 1440), ("tablet", 768))],
        "errors": [],
    }


@pytest.fixture(scope="module")
def planted(spark):
    heading = node(0, "Hand tools", "heading", level=1)
    fee = [node(1, "You must pay $45 within 14 days."), node(1, "You must pay $49 within 30 days.")]
    kept, lost, new = node(2, "Our history is long."), node(3, "We train apprentices every year."), node(4, "Values matter here now")
    red, blue = style(heading, **{"color": "rgb(200, 0, 0)", "font-size": "32px"}), style(heading, **{"color": "rgb(0, 0, 200)", "font-size": "28px"})
    rows = [
        snapshot("source", "/", [heading, fee[0], kept, lost], links=["/about", "/gone", "/"],
                 prices=[(1299.0, "$1,299.00", "Steel toolbox"), (49.99, "$49.99", "Hammer")], styles=[red]),
        snapshot("target", "/", [heading, fee[1], {**kept, "kind": "listItem"}, new], links=["/about"],
                 prices=[(1399.0, "$1,399.00", "Steel toolbox"), (49.99, "USD 49,99", "Hammer")], styles=[blue], title="T2"),
        snapshot("source", "/about", [kept]), snapshot("source", "/contact", [kept], links=["/contact"]),
        snapshot("target", "/about", [kept]), snapshot("target", "/blog", [kept]),
    ]
    df = spark.createDataFrame(rows, store.SNAPSHOT_DDL)
    probes = spark.createDataFrame(
        [], "url string, method string, status int, redirect_count int, final_url string, reason string"
    )
    return df, probes


def test_planted_differences_are_found_and_nothing_else(spark, planted):
    result = compare.compare_snapshots(*planted)
    rows = result.findings.collect()
    got = {(r.category, r.path) for r in rows}
    assert got == {
        ("content.value-drift", "/"), ("content.missing", "/"), ("content.added", "/"), ("meta.drift", "/"),
        ("price.value-drift", "/"), ("price.format-drift", "/"), ("css.property-drift", "/"),
        ("page.missing-on-target", "/contact"), ("page.extra-on-target", "/blog"), ("link.path-mismatch", "/"),
        ("link.path-mismatch", "/contact"),
    }
    drift = next(r for r in rows if r.category == "content.value-drift")
    assert drift.facet == "amount+duration" and [c["class"] for c in drift.value_changes] == ["amount", "duration"]
    assert {r.facet for r in rows if r.category == "css.property-drift"} == {"color", "font-size"}
    parts = {r.dimension: 0 for r in result.counts.collect()}
    for r in result.counts.collect():
        parts[r.dimension] += r["count"]
    assert set(parts.values()) == {len(rows)}
    assert len({r.id for r in rows}) == len(rows)
    stats = result.stats.first()
    assert stats.coverage.missing_on_target == 1 and stats.content.matched_nodes == 4


def test_self_comparison_is_empty(spark, planted):
    df, probes = planted
    assert compare.compare_with_itself(compare.from_snapshots(df, probes)).count() == 0


def report(spark, rows):
    df = spark.createDataFrame(rows, "path string, severity string, expected string, actual string")
    return findings.build(
        df, "content.drift", severity=F.col("severity"), path=F.col("path"), subject=F.lit("node#0"), label=F.col("path"),
        expected_json=F.col("expected"), actual_json=F.col("actual"),
    )


def test_run_diff_buckets(spark):
    before = report(spark, [("/", "error", '"a"', '"b"'), ("/w", "warning", None, None), ("/k", "info", '{"x":1,"y":2}', None), ("/gone", "error", None, None)])
    after = report(spark, [("/", "error", '"a"', '"c"'), ("/w", "error", None, None), ("/k", "info", '{"y":2,"x":1}', None), ("/new", "error", None, None)])
    diff = rundiff.diff_runs(before, after)
    got = {rundiff_path(r): (r.bucket, r.escalated) for r in diff.collect()}
    assert got == {"/": ("changed", False), "/w": ("changed", True), "/k": ("unchanged", False), "/gone": ("fixed", False), "/new": ("added", False)}
    assert rundiff.regression_gate(diff, "error").first().exit_code == 1
    same = rundiff.diff_runs(after, after)
    assert {r.bucket for r in same.collect()} == {"unchanged"}


def rundiff_path(r):
    return (r.current or r.previous).path


def test_baseline_resolution(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert store.resolve_runs(runs) == ("b", "c")
    assert store.resolve_runs(runs, "c", "a") == ("a", "c")
    for bad in (("a", None), ("c", "c"), ("x", None), (None, "zz")):
        with pytest.raises(store.StoreError):
            store.resolve_runs(runs, *bad)


def test_sitemap_index_and_robots(spark):
    from twinlens.sources import sitedocs

    docs = spark.createDataFrame(
        [
            ("h", "u/i", "sitemap", "<sitemapindex><sitemap><loc>u/a</loc></sitemap><sitemap><loc>u/b</loc></sitemap></sitemapindex>"),
            ("h", "u/a", "sitemap", "<x:urlset><x:url><x:loc>https://h/1</x:loc></x:url><x:url><x:loc>bad</x:loc></x:url></x:urlset>"),
            ("h", "u/b", "sitemap", "<urlset><url><loc> https://h/2?a=1&amp;b=2 </loc></url><url><loc>https://h/1</loc></url>"),
            ("h", "r", "robots", "User-agent: *\nDisallow: /a\nSitemap: u/i\nUser-agent: Bot\nDisallow: /b # no\nAllow: /b/c\nCrawl-delay: 2"),
        ],
        "host string, doc_url string, kind string, body string",
    )
    visited = sitedocs.expand_sitemaps(docs, sitedocs.robots_sitemaps(docs))
    assert {r.doc_url for r in visited.collect()} == {"u/i", "u/a", "u/b"}
    assert {r.url for r in sitedocs.sitemap_seeds(docs, visited).collect()} == {"https://h/1", "https://h/2?a=1&b=2"}
    rules = sitedocs.robots_rules(docs, "bot")
    pages = spark.createDataFrame([("h", "/a"), ("h", "/b/x"), ("h", "/b/c/d"), ("z", "/b")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in intake.robots_allowed(pages, rules).collect()} == {
        ("h", "/a"): True, ("h", "/b/x"): False, ("h", "/b/c/d"): True, ("z", "/b"): True,
    }
    assert sitedocs.crawl_delay(rules).first().crawl_delay_ms == 2000


def test_html_rules(spark):
    from twinlens.sources import html

    page = (
        "<html lang='en'><body><div class='sc-header'><p>Top</p></div><table><tr><td><a href='/x'>Home</a></td><td>Cell</td></tr></table>"
        "<div>Loose <span>inner</span></div><ul><li>One<li>Two</ul><div class='ad'><p>Ad</p></div><p>A<p>B<script>var p='</p>'</script></body></html>"
    )
    df = html.elements(spark.createDataFrame([("source", "/", page)], "side string, path string, html string"))
    rows = html.raw_nodes(html.kept(html.annotate(df, (".ad",))), html.page_texts(df)).orderBy("pos").collect()
    got = [(r.kind, r.text.strip(), r.region) for r in rows]
    assert got == [
        ("paragraph", "Top", "header"), ("tableCell", "Cell", "other"), ("listItem", "One", "other"), ("listItem", "Two", "other"),
        ("paragraph", "A", "other"), ("paragraph", "B", "other"), ("paragraph", "Loose", "other"), ("link", "Home", "other"),
    ]


def test_deep_pages_take_room_in_proportion_and_find_what_is_around(spark):
    from twinlens.sources import html

    deep = "<nav>" + "<div class='c'>x" * 2000 + "<p>deepest</p>" + "</div>" * 2000 + "</nav><p>after</p>"
    pages = spark.createDataFrame([("source", "/", f"<html><body>{deep}</body></html>")], "side string, path string, html string")
    raw = html.elements(pages)
    rows = raw.toPandas()
    assert len(rows) == 2005 and rows["page_text"].notna().sum() == 1
    assert rows["trail"].map(len).max() == 2 and len(rows["page_text"][0]) < 4100
    found = html.raw_nodes(html.kept(html.annotate(raw)), html.page_texts(raw)).orderBy("pos").collect()
    assert [(r.text, r.region) for r in found[:2]] == [("deepest", "nav"), ("after", "other")]
    assert [(r.text, r.region) for r in found[2:]] == [("x", "nav")]


def test_enclosing_marks_equal_a_walk_up_the_tree(spark):
    import random

    from twinlens.sources import html

    made = random.Random(4)

    def tree(depth):
        tag = made.choice(["div", "section", "ul", "b"])
        inner = "".join(tree(depth - 1) for _ in range(made.randrange(4))) if depth else "t"
        return f"<{tag}>{inner}</{tag}>"

    pages = [("source", f"/{i}", "<html>" + tree(5) + tree(4) + "</html>") for i in range(8)]
    raw = html.elements(spark.createDataFrame(pages, "side string, path string, html string"))
    marked = html.enclosing(raw, {"s": F.col("tag") == "section", "u": F.col("tag") == "ul"}, {"s": F.col("pos")})
    rows = {(r.path, r.pos): r for r in marked.collect()}
    for (path, pos), row in rows.items():
        chain, at = [], row
        while at:
            chain.append(at)
            at = rows.get((path, at.parent))
        assert row.in_s == sum(r.tag == "section" for r in chain) and row.in_u == sum(r.tag == "ul" for r in chain)
        assert row.near_s == next((r.pos for r in chain if r.tag == "section"), None)
        assert all(r.pos <= pos < r.exit for r in chain)


def test_rows_of_table_cells(spark):
    from twinlens.sources import html

    page = "<table><tfoot><tr><td>f</td></tr></tfoot><tr><td>a<td>b<table><tr><td>in</td></tr></table><tbody><tr><th>c</table><tr><td>loose</td></tr>"
    raw = html.elements(spark.createDataFrame([("source", "/", page)], "side string, path string, html string"))
    cells = raw.where("tag IN ('td', 'th')").orderBy("pos").collect()
    assert [("".join(c.runs), c.table_row) for c in cells] == [("f", 2), ("a", 0), ("b", 0), ("in", 0), ("c", 1), ("loose", -1)]
