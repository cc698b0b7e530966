"""What stays within little disk: tables stored by page, shuffles that are spared, and the same pairs as without either."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinlens.operators import content, stats
from twinlens.session import _file_system, is_folder, let_go, little_disk, stored_by

RAW = "side string, path string, pos long, region string, kind string, text string, src string, level int"


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def _raw(spark):
    """Pages of both sides: plain lines, lines that fold, repeated and empty ones, an image, a null page and a null text."""
    line = lambda p, n: ["ﬁne print", f"line {p}", "same", "", f"the  {p + n} of them", None][n % 6]
    rows = [
        (side, f"/p{p}" if p else None, n, "nav" if n % 4 == 3 else "main", "image" if n == 7 else "paragraph", line(p, n) if side == "source" or n % 5 else f"line {p} moved", f"{p}.png", None)
        for side in ("source", "target") for p in range(9) for n in range(12) if side == "source" or (n + p) % 7
    ]
    blank = {c: F.lit(None).cast("string") for c in ("href", "link_path", "alt", "selector_hint")}
    return spark.createDataFrame(rows, RAW).withColumns(blank)


def _sides(nodes):
    return nodes.where("side = 'source'"), nodes.where("side = 'target'")


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_rows_stored_by_a_key_are_joined_summed_and_numbered_without_a_shuffle(spark):
    rows = spark.createDataFrame([(f"/{n // 2 % 7}" if n // 2 % 7 else None, n % 2, n, "x" * n) for n in range(60)], "path string, side int, pos long, text string")
    stored = stored_by(rows, "path", 5, ["pos"])
    assert _rows(stored) == _rows(rows) and not [t for t in spark.catalog.listTables() if t.name.startswith("twinlens_")]
    one, two = (stored.where(F.col("side") == s).select("path", "pos", "text") for s in (0, 1))
    both = one.unionByName(two)
    assert not _exchanges(both.groupBy("path", "pos").count())
    assert not _exchanges(both.withColumn("n", F.row_number().over(Window.partitionBy("path", "text").orderBy("pos"))))
    seen = []
    again = stored_by(one.join(two.withColumn("pos", F.col("pos") - 1).withColumnRenamed("text", "other"), ["path", "pos"]), "path", 5)
    wanted = rows.where("side = 0").alias("a").join(rows.where("side = 1").alias("b"), F.expr("a.path = b.path and a.pos = b.pos - 1"))
    assert again.count() == wanted.count() > 0
    places = {f.rsplit("/", 1)[0] for f in again.inputFiles()}
    let_go(again)
    assert places and stored.count() == 60
    assert not any(system.exists(path) for system, path in (_file_system(spark, p) for p in places))
    assert all(is_folder(spark, f.rsplit("/", 1)[0]) for f in stored.inputFiles())


def test_little_disk_packs_tables_and_restores_the_settings(spark):
    from twinlens.session import cut_lineage

    names = ("spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(n, None) for n in names]
    with little_disk(spark):
        packed = cut_lineage(spark.range(1000).repartition(3, "id"))
    assert all(".zstd." in f for f in packed.inputFiles()) and packed.count() == 1000
    assert [spark.conf.get(n, None) for n in names] == before


def test_nodes_and_pairs_stored_by_page_are_the_same_and_their_texts_are_not_shuffled(spark, monkeypatch):
    plain = content.assemble_nodes(_raw(spark))
    dealt = content.assemble_nodes(_raw(spark), parts=3)
    assert _rows(dealt) == _rows(plain)
    assert _rows(content.assemble_nodes(_raw(spark), chunk=4, parts=3)) == _rows(content.assemble_nodes(_raw(spark), chunk=4))
    seen = []
    store = content.by_page
    monkeypatch.setattr(content, "by_page", lambda df, parts: seen.append(df) or store(df, parts))
    pairs = content.content_pairs(*_sides(dealt), parts=3)
    wanted = content.content_pairs(*_sides(plain))
    assert _rows(pairs) == _rows(wanted.select(*pairs.columns)) and wanted.where("confidence > 0 and confidence < 1").count() > 0
    # The stored steps shuffle nothing but, in the last, the places of pairs (and lists of gaps).
    assert len(seen) >= 4 and not [x for df in seen[:2] for x in _exchanges(df)]
    assert "identical" in seen[-1].columns


def test_content_queries_shuffle_a_document_once(spark, tmp_path, monkeypatch):
    from twinlens.plans.catalogue import QUERIES
    from twinlens.plans.derive import Tables

    lines = [(n if n % 9 else 3, "\n".join(f"line {n} {k} the end" if k % 3 else "same ﬁ" for k in range(n % 30))) for n in range(60)]
    spark.createDataFrame(lines, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, seen = Tables(spark, str(tmp_path)), []
    store = content.by_page
    monkeypatch.setattr(content, "by_page", lambda df, parts: seen.append(df) or store(df, parts))
    found = {name: QUERIES[name].run(t) for name in ("content_align", "content_findings", "content_reordered")}
    # Of the nodes themselves only those that Python folds are dealt again; the documents' shuffle is the same for all readers.
    made = _exchanges(seen[0])
    assert all("doc_id" in x or "path" in x for x in made) and not [x for x in made if "side" in x]
    assert not _exchanges(found["content_align"]) and not _exchanges(found["content_findings"])
    old = content.content_pairs(*_sides(content.assemble_nodes(_raw_of(t))))
    key = lambda side: F.col(f"{side}.key").alias(f"{side}_key")
    assert _rows(found["content_align"]) == _rows(old.select("path", "region", key("source"), key("target"), "confidence", "identical"))
    reordered = stats.reordered_nodes(old, ["path", "region"]).agg(F.sum("reordered_nodes")).collect()
    assert found["content_reordered"].collect()[0][0] == reordered[0][0]


def _raw_of(t):
    blank = {c: F.lit(None).cast("string") for c in ("href", "link_path", "src", "alt", "selector_hint")}
    return t.derived("raw_nodes").withColumns(blank | {"level": F.when(F.col("kind") == "heading", F.lit(1)).cast("int")})


def test_values_that_are_the_same_text_bear_no_nodes(spark):
    from twinlens.operators import styles

    side = "named_struct('props', map('color', if(id % 2 = 0, '#000', '{0}'), 'font-size', '{1}'), 'visible', true, 'box', named_struct('x', 0.0D))"
    styled = spark.range(20).selectExpr(
        "concat('/p', id) AS path", "'desktop' AS viewport", "'main' AS region", "named_struct('key', id) AS source", "named_struct('key', id) AS target",
        "1.0D AS confidence", "'s' AS source_url", "'t' AS target_url", f"{side.format('#fff', '10px')} AS source_style", f"{side.format('#f00', '10px')} AS target_style",
    )
    whole, bare = styles.property_comparisons(styled), styles.property_comparisons(styled, bare=True)
    narrow = ["path", "viewport", "property", "kind", "equal"]
    assert _rows(bare.select(*narrow)) == _rows(whole.select(*narrow)) and whole.where("NOT equal").count() == 10
    assert _rows(bare.where("NOT equal")) == _rows(whole.where("NOT equal"))
    assert bare.where("source_value = target_value and (source is not null or source_url is not null or source_box is not null)").isEmpty()
