"""What used to be cut at a limit, and is not any more."""

import json
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import sequential_verdicts


def test_structured_prices_at_any_depth_take_texts_and_numbers_only(spark):
    from twinlens.sources.html import elements, json_ld_prices

    deep = {"@type": "Offer", "price": 7.5}
    for i in range(30):
        deep = {"@graph": [deep]} if i % 2 else {"offers": deep}
    block = [deep, {"price": {"value": 5}}, {"price": True, "lowPrice": "3"}, {"price": 1, "name": {"x": 1}, "@type": "T"}]
    html = f'<html><script type="application/ld+json">{json.dumps(block)}</script></html>'
    pages = spark.createDataFrame([("source", "/p", html)], "side string, path string, html string")
    rows = sorted(json_ld_prices(elements(pages)).collect(), key=lambda r: r["pos"])
    assert [(r["raw"], r["context"]) for r in rows] == [("7.5", "Offer"), ("3", ""), ("1", "T")]
    nested = "[" * 60_000 + "]" * 60_000
    pages = spark.createDataFrame([("source", "/p", f'<script type="application/ld+json">{nested}</script>')], "side string, path string, html string")
    assert json_ld_prices(elements(pages)).collect() == []
    assert len({r["pos"] for r in rows}) == 3


def test_text_prices_of_one_element_have_places_of_their_own(spark):
    from twinlens.sources.html import annotate, elements, kept, page_texts, text_prices

    pages = spark.createDataFrame([("source", "/p", "<html><p>$10.00 or $20.00</p></html>")], "side string, path string, html string")
    rows = text_prices(kept(annotate(elements(pages))), page_texts(elements(pages))).collect()
    assert len(rows) == len({r["pos"] for r in rows}) == 2


def test_long_data_addresses_are_told_apart(spark):
    from twinlens.functions.images import with_asset_key

    same = "data:image/png;base64," + "A" * 80
    rows = spark.createDataFrame([(same + "x",), (same + "y",), (same + "x",)], "src string")
    keys = [r["asset_key"] for r in with_asset_key(rows, "src").collect()]
    assert keys[0] == keys[2] != keys[1]


def test_prices_in_long_contexts_are_told_apart(spark):
    from twinlens.operators.assets import price_subject

    rows = spark.createDataFrame([(("c" * 80 + x, "1"),) for x in "ab"], "source struct<context:string,raw:string>")
    assert rows.select(price_subject("source").alias("s")).distinct().count() == 2


def test_sitemaps_are_followed_to_the_end(spark):
    from twinlens.sources import sitedocs

    index = "<sitemapindex><sitemap><loc>https://h/s{}.xml</loc></sitemap></sitemapindex>"
    page = "<urlset><url><loc>https://h/{}</loc></url></urlset>"
    chain = [("h", f"https://h/s{i}.xml", "sitemap", index.format(i + 1)) for i in range(25)]
    docs = spark.createDataFrame([*chain, ("h", "https://h/s25.xml", "sitemap", page.format("end"))], "host string, doc_url string, kind string, body string")
    roots = spark.createDataFrame([("h", "https://h/s0.xml", 0)], "host string, doc_url string, seq long")
    visited = sitedocs.expand_sitemaps(docs, roots)
    assert visited.count() == 26
    assert [r["url"] for r in sitedocs.sitemap_seeds(docs, visited).collect()] == ["https://h/end"]
    assert sitedocs.expand_sitemaps(docs, roots, 20).count() == 20


def test_finding_ids_are_whole_digests(spark):
    from twinlens.operators.findings import finding_id

    row = spark.range(1).select(finding_id(F.lit("page.alias"), F.lit("/a")).alias("id")).first()
    assert len(row["id"]) == 40


def test_many_offers_of_one_address_are_decided_in_order_of_arrival(spark, tmp_path):
    from twinlens.streaming.intake import decide_stream

    made = random.Random(4)
    offers = [(i, "https://h/hot", 1 + int(40 * (1 - i / 30_000)) + made.randrange(3)) for i in range(30_000)]
    shuffled = offers[:]
    made.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "seq bigint, c_href string, depth int").withColumn("side", F.lit("source"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    rows = decide_stream(stream, 20, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert {r.seq: r.decision for r in rows} == sequential_verdicts(offers, 20)


def test_a_million_captures_of_one_content_have_one_owner(spark, tmp_path):
    from twinlens.streaming.intake import capture_stream

    n = 1_000_000
    href = F.concat(F.lit("https://h/"), F.col("id").cast("string"))
    df = spark.range(n, numPartitions=4).select(
        F.lit("source").alias("side"), F.col("id").alias("seq"), href.alias("href"), F.lit("https://h/7").alias("final_href"), F.lit("x").alias("content_hash")
    ).orderBy(F.desc("seq"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = capture_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    counted = {tuple(r)[:2]: r["n"] for r in got.groupBy("outcome", "alias_of").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Page 0 lands first, page 7 is the address itself.
    assert counted == {("claims", None): 1, (None, "https://h/0"): 1, ("alias", "https://h/0"): n - 2}


def test_no_intermediate_table_outlives_the_run(spark):
    from twinlens.session import cut_lineage, end_run, is_folder, run_folder

    kept = cut_lineage(spark.range(10))
    place = run_folder(spark)
    assert kept.count() == 10 and is_folder(spark, place)
    end_run(spark)
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        is_folder(spark, place)


def test_addresses_of_sitemaps_are_decoded(spark):
    from twinlens.sources import sitedocs

    entry = "<sm:url><sm:loc>{}</sm:loc><sm:lastmod>2020</sm:lastmod></sm:url>"
    inside = ["\n https://h/a?x=1&amp;y=2 ", "https://h/b?q=&#38;&#x26;", "https://h/&lt;&gt;&quot;&apos;", "<![CDATA[https://h/c?a&b]]>", "https://h/d<!-- c -->e", ""]
    xml = '<?xml version="1.0"?><sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(map(entry.format, inside)) + "</sm:urlset>"
    broken = xml.replace("https://h/d", "https://h/d?a=1&b=2").replace("</sm:urlset>", "<oops>").replace("<!-- c -->", "")
    plain = "<urlset><url><loc>https://h/one</loc></url></urlset>"
    docs = spark.createDataFrame([("h", f"u{i}", "sitemap", d) for i, d in enumerate([xml, broken, plain, "", None, "<urlset/>"])], "host string, doc_url string, kind string, body string")
    got = {}
    for r in sitedocs.sitemap_urls(docs).orderBy("pos").collect():
        got.setdefault(r["doc_url"], []).append(r["loc"])
    same = ["https://h/a?x=1&y=2", "https://h/b?q=&&", "https://h/<>\"'", "https://h/c?a&b"]
    assert got == {"u0": [*same, "https://h/de"], "u1": [*same, "https://h/d?a=1&b=2e"], "u2": ["https://h/one"]}


def test_many_rules_of_one_host_are_looked_up_by_their_heads(spark):
    from twinlens.operators.intake import robots_allowed

    n = 200_000
    rules = spark.range(n).select(F.lit("h").alias("host"), F.lit("disallow").alias("kind"), F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/")).alias("pattern"))
    few = [("h", "allow", "/p7/open"), ("h", "disallow", "/*.pdf$"), ("h", "disallow", "*secret"), ("h", "allow", "/x$"), ("h", "disallow", "/x"), ("z", "disallow", "/"), ("z", "allow", "/")]
    rules = rules.unionByName(spark.createDataFrame(few, "host string, kind string, pattern string"))
    wanted = {("h", "/p7/a"): False, ("h", "/p7/open/b"): True, ("h", "/p200001/"): True, ("h", "/a.pdf"): False, ("h", "/a.pdf?x"): True, ("h", "/my/secret"): False,
              ("h", "/x"): True, ("h", "/xy"): False, ("z", "/any"): True, ("q", "/"): True, ("h", None): True, (None, "/"): True, ("h", ""): True}
    pages = spark.createDataFrame([(h, p, i) for i, (h, p) in enumerate([*wanted, *wanted])], "host string, path string, n int")
    got = robots_allowed(pages, rules).collect()
    assert len(got) == 2 * len(wanted) and {(r["host"], r["path"]): r["allowed"] for r in got} == wanted


def test_repeated_findings_of_one_id_keep_their_number(spark):
    from collections import Counter

    from twinlens.operators import rundiff

    ddl = "id string, severity string, category string, path string, label string, viewport string, expected_json string, actual_json string, magnitude double"
    row = lambda i, severity="error", actual="1", label="l": (i, severity, "mixed", "/p", label, None, "0", actual, 1.0)
    before = [row("a"), row("a"), row("b", actual='{"x":1,"y":2}'), row("b", actual="5"), row("c"), row("d"), *[row("hot")] * 300, row("e", "info"), row("e", "info"), row(None)]
    after = [row("a", label="other"), row("b", actual="7"), row("b", actual='{"y": 2,"x":1}'), row("b", actual="8"), row("c"), *[row("hot")] * 290, row("e", "error"), row("e", "info"), row("n"), row("n")]
    made = lambda rows: spark.createDataFrame(rows, ddl).repartition(3)
    got = Counter((r["id"], r["bucket"], r["escalated"]) for r in rundiff.diff_runs(made(before), made(after)).collect())
    assert got == {
        ("a", "unchanged", False): 1, ("a", "fixed", False): 1, ("b", "unchanged", False): 1, ("b", "changed", False): 1, ("b", "added", False): 1, ("c", "unchanged", False): 1,
        ("d", "fixed", False): 1, ("hot", "unchanged", False): 290, ("hot", "fixed", False): 10, ("e", "unchanged", False): 1, ("e", "changed", True): 1, ("n", "added", False): 2,
        (None, "fixed", False): 1,
    }
    same = rundiff.diff_runs(made(before), made(before)).groupBy("bucket").count().collect()
    assert [tuple(r) for r in same] == [("unchanged", len(before))]


def test_viewports_resolve_to_profiles_and_unknown_ones_end_the_job(spark):
    from twinlens.operators import dimensions

    own = spark.createDataFrame([("wall", "Wall", 3840, 2160, 1.0, False, False), ("desktop", "Mine", 1500, 900, 1.0, False, False)], dimensions.PROFILE_DDL)
    profiles = dimensions.device_profiles(spark, own)
    named = lambda *ids: spark.createDataFrame([(i,) for i in ids], "viewport string")
    got = dimensions.resolve_viewports(named("desktop", "wall", "tablet"), profiles).collect()
    assert {r["viewport"]: r["width"] for r in got} == {"desktop": 1500, "wall": 3840, "tablet": 768} and profiles.count() == 9
    for wrong in ("dekstop", None):
        with pytest.raises(Exception, match="no such viewport"):
            dimensions.resolve_viewports(named("desktop", wrong), profiles).collect()


def test_small_pages_are_parsed_by_all_tasks_and_share_batches(spark, tmp_path, monkeypatch):
    from twinlens.plans import queries_intake
    from twinlens.plans.derive import Tables
    from twinlens.sources import html

    parts = spark.range(200).selectExpr("id AS p_partkey", "'red mug' AS p_name", "900.0D AS p_retailprice", "1 AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = queries_intake._shop_html(Tables(spark, str(tmp_path)))
    assert pages.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    whole = html.elements(pages).drop("attrs").collect()
    monkeypatch.setattr(html, "BATCH_ROWS", 20)
    cut = html.elements(pages).drop("attrs").collect()
    assert len(whole) == 200 * 8 and sorted(map(str, whole)) == sorted(map(str, cut))


def test_each_pair_of_style_values_is_compared_once(spark, monkeypatch):
    from twinlens.operators import styles

    seen = []
    compare = styles.compare_css
    monkeypatch.setattr(styles, "compare_css", lambda df, **limits: seen.append(df.count()) or compare(df, **limits))
    side = "named_struct('props', map('color', if(id % 2 = 0, '#000', '{0}'), 'font-size', '{1}'), 'visible', true, 'box', named_struct('x', 0.0D))"
    styled = spark.range(100).selectExpr(
        "concat('/p', id) AS path", "'desktop' AS viewport", "'main' AS region", "named_struct('key', id) AS source", "named_struct('key', id) AS target",
        "1.0D AS confidence", "'s' AS source_url", "'t' AS target_url", f"{side.format('#fff', '10px')} AS source_style", f"{side.format('#f00', '14px')} AS target_style",
    )
    rows = styles.property_comparisons(styled).groupBy("property", "kind").count().collect()
    assert sorted(map(tuple, rows)) == [("color", "color", 50), ("color", "equal", 50), ("font-size", "length", 100)]
    assert seen == [3]


def test_elements_are_dealt_to_more_tasks_the_more_there_are(spark, tmp_path):
    from twinlens.plans.derive import Tables
    from twinlens.session import dealt

    rows = spark.range(400).selectExpr("id AS page_id", "concat('https://a.example/p', id) AS url", "concat('<html><body><nav><p>', id, '</p></nav></body></html>') AS html")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    t = Tables(spark, str(tmp_path))
    size = int(t.elements._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few, many = (dealt(t.elements, ["side", "path"], size // n).rdd.getNumPartitions() for n in (8, 80))
    assert 8 <= few < 12 and 80 <= many < 100
    regions = t.annotated.groupBy("tag", "region").count().collect()
    assert sorted(map(tuple, regions)) == [("body", "other", 400), ("html", "other", 400), ("nav", "nav", 400), ("p", "nav", 400)]


def _exchanges(run):
    """The shuffles by key in the plans of a run."""
    return [line for df in run for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line or "REPARTITION_BY_COL" in line]


def _raw_nodes(spark, n=40):
    rows = [(side, "/p", p, "main", "paragraph", f" line  {p % 7}" if p % 5 else "", None) for side in ("source", "target") for p in range(n)]
    return spark.createDataFrame(rows, "side string, path string, pos long, region string, kind string, text string, src string")


def test_nodes_are_made_and_stored_once_and_numbered_alike_in_any_chunks(spark, monkeypatch):
    from twinlens.operators import content, scan

    seen = []
    for module in (content, scan):
        monkeypatch.setattr(module, "cut_lineage", lambda df, kept=module.cut_lineage: seen.append(df) or kept(df))
    whole = content.assemble_nodes(_raw_nodes(spark))
    rows = sorted(map(str, whole.collect()))
    assert len(seen) == 1 and len(_exchanges(seen)) == 1
    assert sorted(map(str, content.assemble_nodes(_raw_nodes(spark), chunk=4).select(*whole.columns).collect())) == rows
    place = {(r["side"], r["pos"]): r["ordinal"] for r in whole.collect()}
    assert place["source", 1] == 0 and place["source", 8] == 1 and place["source", 22] == 2 and ("source", 5) not in place


def test_ranks_need_one_shuffle_and_do_not_depend_on_chunks(spark):
    from twinlens.operators import align

    rows = [("g", side, p, str(p % 3)) for side in "st" for p in range(30 if side == "s" else 20)]
    loose = spark.createDataFrame(rows, "path string, side string, pos long, key string").withColumn("gap", F.lit(-1).cast("long"))
    short = align.pair_by_rank(loose, ["path"])
    assert len(_exchanges([short])) == 1
    assert sorted(map(str, short.collect())) == sorted(map(str, align.pair_by_rank(loose, ["path"], chunk=4).collect()))


def test_anchors_of_short_groups_are_looked_at_in_one_pass(spark):
    from twinlens.operators import scan

    df = spark.createDataFrame([("a", p, (p * 7) % 30) for p in range(30)], "g string, p long, v long")
    one = scan.around(df, ["g"], "p", F.col("v"), "b", "a")
    assert len(_exchanges([one])) == 1 and "Join" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, one.select("p", "b", "a").collect())) == sorted(map(str, scan.around(df, ["g"], "p", F.col("v"), "b", "a", chunk=4).select("p", "b", "a").collect()))


def test_one_sided_findings_read_their_pairs_once(spark):
    from twinlens.operators import content

    node = "struct<key:string,ordinal:long,kind:string,text:string,level:int,src:string,selector_hint:string>"
    both = ("k", 1, "paragraph", "z", None, None, None)
    rows = [("/p", "main", ("k", 0, "paragraph", "x", None, None, "s"), None), ("/p", "main", None, ("j", 1, "heading", "y", 2, None, "t")), ("/p", "main", both, both)]
    pairs = spark.createDataFrame(rows, f"path string, region string, source {node}, target {node}").withColumns({c: F.lit("u") for c in ("source_url", "target_url")})
    found = content.one_sided_findings(pairs)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["category"]: (r["subject"], r["label"], r["expected_json"], r["actual_json"], r["selector_hint"]) for r in found.collect()}
    assert got == {"content.missing": ("k#0", 'The target lacks paragraph "x"', '"x"', None, "s"), "content.added": ("j#1", 'The target adds h2 "y"', None, '"y"', "t")}


def test_settled_text_takes_one_look(spark):
    import unicodedata

    from twinlens.functions import text

    changed = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000 and chr(c) != unicodedata.normalize("NFKC", chr(c))]
    rows = spark.createDataFrame([(x,) for x in [*changed, "Grüße, a-b", "\u2019", "plain"]], "x string")
    odd = {r["x"] for r in rows.where(F.col("x").rlike(text._ODD)).collect()}
    assert odd == {*changed, "\u2019"}


def test_page_files_are_written_by_all_tasks(spark, tmp_path):
    import gzip

    from twinlens.session import cut_lineage
    from twinlens.sources import snapshots as store

    pages = spark.range(300).select(F.when(F.col("id") % 3 == 0, "source").otherwise("target").alias("side"), F.concat(F.lit("/Ü/"), "id").alias("path"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("title"))
    place = f"file://{tmp_path}/run"
    assert store.write_snapshot_json(cut_lineage(pages.coalesce(1)), place) == 300
    files = sorted((tmp_path / "run").rglob("*.json.gz"))
    assert len(files) == 300 and {f.parent.name for f in files} == {"source", "target"}
    assert set(json.loads(gzip.open(files[0], "rt").read())) == {"side", "path", "status"}
    back = store.scan_snapshot_json(spark, place)
    assert sorted(map(tuple, back.select("side", "path", "status", "title").collect())) == sorted(map(tuple, pages.collect()))
    rows = store.dealt(cut_lineage(pages.coalesce(1)), ["side", "path"])
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_addresses_are_unwrapped_only_where_there_is_a_nested_one(spark):
    from twinlens.functions.images import with_asset_key

    def proxy(inner):
        return "https://h/_next/image?w=1&url=" + quote(inner, safe="")

    want = {"https://h/a.jpg": "a", "https://h/a.jpg?w=1": "a", proxy("/img/b.png"): "b", proxy(proxy("https://x/c.webp")): "c", proxy(proxy(proxy("/d.svg"))): "d", "https://h/e.jpg?u=1#f.png": "e"}
    rows = with_asset_key(spark.createDataFrame([(u,) for u in want], "src string"), "src")
    assert {r["src"]: r["asset_key"] for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN isnotnull(_ak_nested") + plan.count("if (isnotnull(_ak_nested") >= 2 and "CASE WHEN Contains(_ak_url" in plan


def test_narrow_tables_are_dealt_to_more_tasks_the_larger_they_are(spark, tmp_path):
    from twinlens.session import spread_thin

    spark.range(200_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert spread_thin(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_thin(table, 10_000).rdd.getNumPartitions() > 20
