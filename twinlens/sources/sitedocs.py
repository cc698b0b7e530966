"""Sitemaps and robots files as tables of site documents `(host, doc_url, kind, body)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.urls import clean_url
from twinlens.operators.scan import first_rows
from twinlens.session import cut_lineage

_LOC = r"(?s)<(?:[A-Za-z0-9_]+:)?loc[^>]*>\s*(.*?)\s*</(?:[A-Za-z0-9_]+:)?loc>"
_BLOCK = r"(?s)<(?:[A-Za-z0-9_]+:)?{tag}(?:\s[^>]*)?>.*?</(?:[A-Za-z0-9_]+:)?{tag}>"


_LISTED = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
_PARSED = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"}


def _loose_text(block: Column) -> Column:
    """The `loc` of one entry of a document that is no XML: alone it may be XML, else its markup is taken off."""
    found = F.regexp_extract(block, _LOC, 1)
    alone = F.from_xml(F.concat(F.lit("<url><loc>"), found, F.lit("</loc></url>")), "loc string", _PARSED)["loc"]
    text = F.regexp_replace(found, r"^<!\[CDATA\[(.*)\]\]>$", "$1")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.coalesce(alone, text)


def _locations(documents: DataFrame, tag: str) -> DataFrame:
    """`loc` of each entry, any namespace prefix, in document order.

    Documents are read as XML, so references, CDATA and comments mean what they should. One that is no XML yields what
    it holds, entry by entry, rather than failing the job. One document is one row.
    """
    parsed = F.from_xml(F.col("body"), f"{_LISTED}, broken string", _PARSED)
    bare = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(bare, F.lit(_BLOCK.format(tag=tag)), F.lit(0))
    rows = documents.where(F.col("kind") == "sitemap").select("host", "doc_url", parsed.alias("_xml"), blocks.alias("_blocks"))
    whole = F.col("_xml").isNotNull() & F.col("_xml.broken").isNull()
    listed = F.when(whole, F.transform(F.col(f"_xml.{tag}"), lambda entry: entry["loc"])).otherwise(F.transform("_blocks", _loose_text))
    rows = rows.select("host", "doc_url", F.posexplode(listed).alias("pos", "loc")).withColumn("loc", F.trim(F.regexp_replace("loc", r"^\s+|\s+$", "")))
    return rows.where(F.col("loc") != "")


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """Absolute page URLs listed by each sitemap; entries that are no URL are skipped."""
    rows = _locations(documents, "url")
    return rows.where(clean_url(F.col("loc")).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+"))


def sitemap_children(documents: DataFrame) -> DataFrame:
    """Documents listed by each sitemap index."""
    return _locations(documents, "sitemap").withColumnRenamed("loc", "child_url")


def expand_sitemaps(documents: DataFrame, roots: DataFrame, max_documents: int | None = None) -> DataFrame:
    """Documents visited per host, breadth first, until no document names a new one.

    `roots(host, doc_url, seq)` holds declared locations first, then the default one. `place` is the
    visiting order inside a level: the place of the document that names it, then the line. With
    `max_documents`, only the first ones of each host. Bodies are read once; a round reads names only.
    """
    children = cut_lineage(sitemap_children(documents).select("host", "doc_url", "child_url", _digits("pos").alias("line")))
    known = documents.where(F.col("kind") == "sitemap").select("host", "doc_url")
    first = first_rows(roots.select("host", "doc_url", "seq"), ["host", "doc_url"], [F.col("seq")])
    frontier = visited = cut_lineage(first.select("host", "doc_url", _digits("seq").alias("place"), F.lit(0).alias("level")))
    level = 0
    while not frontier.isEmpty():
        level += 1
        named = frontier.join(children, ["host", "doc_url"]).groupBy("host", F.col("child_url").alias("doc_url"))
        step = named.agg(F.min(F.concat_ws(".", "place", "line")).alias("place"))
        step = step.join(visited.select("host", "doc_url"), ["host", "doc_url"], "left_anti")
        frontier = cut_lineage(step.withColumn("level", F.lit(level)))
        visited = visited.unionByName(frontier)
    return _first_of_host(visited, max_documents, "level", "place", "doc_url").join(known, ["host", "doc_url"], "left_semi")


def _digits(name: str) -> Column:
    """A number as text that sorts like it."""
    return F.lpad(F.col(name).cast("string"), 12, "0")


def _first_of_host(df: DataFrame, rows: int | None, *order: str) -> DataFrame:
    if rows is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("_n") <= rows).drop("_n")


def sitemap_seeds(documents: DataFrame, visited: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Distinct page URLs of the visited sitemaps; with `max_urls`, the first of each host in visiting order."""
    listed = sitemap_urls(documents).join(visited, ["host", "doc_url"])
    distinct = first_rows(
        listed.select("host", F.col("loc").alias("url"), "level", "place", "pos"), ["host", "url"],
        [F.col("level"), F.col("place"), F.col("pos")],
    )
    return _first_of_host(distinct, max_urls, "level", "place", "pos", "url").select("host", "url")


def robots_lines(documents: DataFrame) -> DataFrame:
    """Directive lines of each robots file: field, value and line number."""
    lines = documents.where(F.col("kind") == "robots").select(
        "host", "doc_url", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw")
    )
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    rows = lines.withColumn("text", text).where(F.col("text").contains(":"))
    return rows.select(
        "host", "doc_url", "line",
        F.lower(F.trim(F.substring_index("text", ":", 1))).alias("field"),
        F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("value"),
    )


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    """`Sitemap:` lines belong to the whole file, whatever group they stand in."""
    lines = robots_lines(documents)
    return lines.where((F.col("field") == "sitemap") & (F.col("value") != "")).select(
        "host", F.col("value").alias("doc_url"), F.col("line").cast("bigint").alias("seq")
    )


def robots_rules(documents: DataFrame, user_agent: str = "*") -> DataFrame:
    """Rules of the group that applies: one naming the agent beats the wildcard group.

    A rule belongs to the last user-agent line above it. A robots file is one row of the
    documents table, which bounds the window over its lines.
    """
    wanted = user_agent.lower()
    above = Window.partitionBy("host", "doc_url").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(above)
    rows = robots_lines(documents).withColumn("agent", agent)
    exact_here = F.max(F.when(F.col("agent") == wanted, 1).otherwise(0)).over(Window.partitionBy("host", "doc_url"))
    rows = rows.withColumn("_exact", exact_here)
    in_scope = F.when(F.col("_exact") == 1, F.col("agent") == wanted).otherwise(F.col("agent") == "*")
    rules = rows.where(in_scope & F.col("field").isin("allow", "disallow", "crawl-delay") & (F.col("value") != ""))
    return rules.select("host", "line", F.col("field").alias("kind"), F.col("value").alias("pattern"))


def crawl_delay(rules: DataFrame) -> DataFrame:
    """Delay in milliseconds per host: the last positive one given."""
    seconds = F.regexp_extract("pattern", r"^[+-]?\d*\.?\d+", 0).try_cast("double")
    rows = rules.where(F.col("kind") == "crawl-delay").withColumn("s", seconds).where(F.col("s") > 0)
    return rows.groupBy("host").agg((F.max_by("s", "line") * 1000).cast("bigint").alias("crawl_delay_ms"))
