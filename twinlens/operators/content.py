"""Content comparison: node assembly, pairing per region, and the content findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.text import is_odd, kind_family, node_key, normalize_text, trigram_similarity, truncate
from twinlens.functions.values import describe_change, value_changes
from twinlens.operators.align import align, attach, cross_equal, dice_matrix
from twinlens.operators.findings import REGIONS, build, json_text, union_all
from twinlens.operators.scan import CHUNK, Store, carried_occurrence, chunk_occurrence
from twinlens.session import cut_lineage, let_go, own_name, stored_by

KINDS = ("heading", "paragraph", "listItem", "link", "image", "control", "tableCell", "price")
NODE_COLUMNS = (
    "key", "ordinal", "region", "kind", "text", "level", "href", "link_path", "src", "alt", "selector_hint",
)
HASH_CHUNK = 1000


def by_page(df: DataFrame, parts: int) -> DataFrame:
    """Store nodes, or what is made of them, by page; lines of both sides lie beside each other."""
    return stored_by(df, "path", parts, [c for c in ("region", "spos", "pos", "side") if c in df.columns])


def _normalized(raw: DataFrame, ignore_patterns: Sequence[str], parts: int | None) -> DataFrame:
    if parts is None:
        return raw.withColumn("text", normalize_text(F.col("text"), ignore_patterns))
    # Rows that Python folds have to be dealt by page again; all others stay in the tasks that have their page already.
    raw = own_name(raw, "path")
    odd = F.coalesce(is_odd(F.col("text")), F.lit(False))
    plain = raw.where(~odd).withColumn("text", normalize_text(F.col("text"), ignore_patterns, settled=True))
    folded = raw.where(odd).withColumn("text", normalize_text(F.col("text"), ignore_patterns))
    return plain.repartition(parts, "path").unionByName(folded.repartition(parts, "path"))


def assemble_nodes(raw: DataFrame, ignore_patterns: Sequence[str] = (), chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Raw elements (`side, path, pos, kind, region, text, src`) to content nodes, keyed, numbered and stored.

    With `parts` they are dealt and stored by page in so many parts; raw elements that are dealt so are not shuffled.
    """
    store = None if parts is None else partial(by_page, parts=parts)
    df = _normalized(raw, ignore_patterns, parts).withColumns(
        {
            "kind": F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.lit("paragraph")),
            "region": F.when(F.col("region").isin(*REGIONS), F.col("region")).otherwise(F.lit("other")),
        }
    )
    identity = F.when(F.col("kind") == "image", F.coalesce(F.col("src"), F.lit(""))).otherwise(F.col("text"))
    df = df.withColumn("key", node_key(kind_family(F.col("kind")), identity))
    # The filter comes last: in front it would be pushed below and normalise every text a second time. What it drops has
    # keys of its own, so no ordinal moves.
    by = ["side", "path", "region", "key"]
    stored = (store or cut_lineage)(chunk_occurrence(df, by, "pos", "ordinal", chunk))
    return carried_occurrence(stored, by, "pos", "ordinal", chunk, store).where((F.col("text") != "") | (F.col("kind") == "image"))


def content_hash(nodes: DataFrame) -> DataFrame:
    """Hash per page of its ordered `region:family:text` parts, in two levels.

    Digests of fixed runs of positions are hashed again, so no row ever holds a page's text.
    """
    part = F.concat_ws(":", "region", kind_family(F.col("kind")), "text")
    leaf = nodes.select(
        "side", "path", F.floor(F.col("pos") / HASH_CHUNK).cast("bigint").alias("run"), "pos", F.sha1(part).alias("d")
    )
    ordered = lambda order: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "d"))), lambda x: x["d"]), "\n"
    )
    runs = leaf.groupBy("side", "path", "run").agg(F.sha1(ordered("pos")).alias("d"))
    return runs.groupBy("side", "path").agg(F.sha1(ordered("run")).alias("content_hash"))


def node_attrs(kind: Column) -> Column:
    """Per-kind attributes of a raw element, with the defaults of its kind."""
    c = F.col
    return F.struct(
        F.when(kind == "heading", F.coalesce(c("level"), F.lit(1))).alias("level"),
        F.when(kind == "link", F.coalesce(c("href"), F.lit(""))).alias("href"),
        F.when(kind == "image", F.coalesce(c("src"), F.lit(""))).alias("src"),
        F.when(kind == "image", F.coalesce(c("alt"), F.lit(""))).alias("alt"),
        F.when(kind == "image", F.coalesce(c("natural_width"), F.lit(0))).alias("natural_width"),
        F.when(kind == "image", F.coalesce(c("natural_height"), F.lit(0))).alias("natural_height"),
        F.when(kind == "listItem", F.coalesce(c("depth"), F.lit(0))).alias("depth"),
        F.when(kind == "tableCell", F.coalesce(c("row"), F.lit(-1))).alias("row"),
        F.when(kind == "tableCell", F.coalesce(c("col"), F.lit(-1))).alias("col"),
    )


def link_target(path: Column, href: Column) -> Column:
    return F.coalesce(path, href)


def node_similarity(a: str = "source", b: str = "target") -> Column:
    """Similarity of two node structs, 0..1, by kind."""
    c = lambda side, name: F.col(f"{side}.{name}")
    text = trigram_similarity(c(a, "text"), c(b, "text"))
    blank = lambda col: F.coalesce(col, F.lit(""))
    same_src = blank(c(a, "src")) == blank(c(b, "src"))
    same_path = link_target(c(a, "link_path"), c(a, "href")).eqNullSafe(link_target(c(b, "link_path"), c(b, "href")))
    kind = c(a, "kind")
    return (
        F.when(kind_family(kind) != kind_family(c(b, "kind")), F.lit(0.0))
        .when(
            kind == "image",
            F.when(same_src, F.lit(1.0)).otherwise(trigram_similarity(blank(c(a, "alt")), blank(c(b, "alt")))),
        )
        .when(kind == "link", text * 0.75 + F.when(same_path, F.lit(0.25)).otherwise(F.lit(0.0)))
        .when((kind == "heading") & ~c(a, "level").eqNullSafe(c(b, "level")), text * 0.9)
        .when(kind != c(b, "kind"), text * 0.98)
        .otherwise(text)
    )


_FAMILY = {"paragraph": "text", "listItem": "text", "tableCell": "text"}


def _node_scores(s: dict[str, list], t: dict[str, list]) -> np.ndarray:
    """`node_similarity` for every pair of a gap."""
    kinds = np.array(s["kind"], dtype=object)[:, None]
    text = dice_matrix(s["text"], t["text"])
    score = np.where(cross_equal(s["kind"], t["kind"]), text, text * 0.98)
    if "heading" in s["kind"]:
        score = np.where((kinds == "heading") & ~cross_equal(s["level"], t["level"]), text * 0.9, score)
    if "link" in s["kind"]:
        place = lambda f: [h if p is None else p for p, h in zip(f["link_path"], f["href"], strict=True)]
        score = np.where(kinds == "link", text * 0.75 + np.where(cross_equal(place(s), place(t)), 0.25, 0.0), score)
    if "image" in s["kind"]:
        blank = lambda v: ["" if x is None else x for x in v]
        alike = dice_matrix(blank(s["alt"]), blank(t["alt"]))
        score = np.where(kinds == "image", np.where(cross_equal(s["src"], t["src"]), 1.0, alike), score)
    family = lambda f: [_FAMILY.get(k, k) for k in f["kind"]]
    return np.where(cross_equal(family(s), family(t)), score, 0.0)


def content_pairs(
    source: DataFrame, target: DataFrame, threshold: float = 0.6, max_product: int | None = None, chunk: int = CHUNK,
    parts: int | None = None, more: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """Pair both sides' nodes page by page and region by region.

    Both inputs carry the source page's `path`. Returns `path, region, source, target,
    confidence, identical`. With nodes that are stored by page in so many `parts`, the pairs are stored so too, and of
    the nodes' texts only those between anchors are shuffled. `more` adds columns by page before pairs are stored.
    """
    keyed = lambda df: df.withColumn("_key", F.concat_ws(":", kind_family(F.col("kind")), "key"))
    by = ["path", "region"]
    payload = ["text", "kind", "level", "href", "link_path", "src", "alt"]
    s, t = keyed(source), keyed(target)
    kept: list[DataFrame] = []

    def store(df: DataFrame) -> DataFrame:
        kept.append(by_page(df, parts))
        return kept[-1]

    pairs = align(
        s, t, by, "_key", _node_scores, payload, threshold, max_product, chunk=chunk, store=None if parts is None else store
    )
    if parts is None:
        return more(attach(pairs, s, t, by, NODE_COLUMNS).withColumn("identical", identical()))
    full = attach(pairs.repartition(parts, "path"), s, t, by, NODE_COLUMNS)
    full = by_page(more(full.withColumn("identical", identical())), parts)
    for table in kept:
        let_go(table)
    return full


def identical(a: str = "source", b: str = "target") -> Column:
    """Same words, same family, and the same destination, level or alt text where those apply."""
    c = lambda side, name: F.col(f"{side}.{name}")
    blank = lambda col: F.coalesce(col, F.lit(""))
    kind = c(a, "kind")
    rest = (
        F.when(
            kind == "link",
            blank(link_target(c(a, "link_path"), c(a, "href"))) == blank(link_target(c(b, "link_path"), c(b, "href"))),
        )
        .when(kind == "heading", c(a, "level").eqNullSafe(c(b, "level")))
        .when(kind == "image", c(a, "alt").eqNullSafe(c(b, "alt")))
        .otherwise(F.lit(True))
    )
    same = (c(a, "text") == c(b, "text")) & (kind_family(kind) == kind_family(c(b, "kind"))) & rest
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), same)


def _describe(node: str) -> Column:
    c = lambda name: F.col(f"{node}.{name}")
    quoted = F.concat(F.lit('"'), truncate(c("text"), 60), F.lit('"'))
    return (
        F.when(c("kind") == "image", F.concat(F.lit("image "), F.coalesce(c("src"), F.lit(""))))
        .when(c("kind") == "heading", F.concat(F.lit("h"), c("level").cast("string"), F.lit(" "), quoted))
        .otherwise(F.concat(c("kind"), F.lit(" "), quoted))
    )


def subject(node: str) -> Column:
    return F.concat(F.col(f"{node}.key"), F.lit("#"), F.col(f"{node}.ordinal").cast("string"))


def with_change_text(df: DataFrame) -> DataFrame:
    """Add `change_label`, `change_expected`, `change_actual` to pairs that differ."""
    a = lambda name: F.col(f"source.{name}")
    b = lambda name: F.col(f"target.{name}")
    same_text = a("text") == b("text")
    link = (a("kind") == "link") & same_text
    level = (a("kind") == "heading") & same_text & ~a("level").eqNullSafe(b("level"))
    image = a("kind") == "image"
    short = lambda col: truncate(col, 60)
    pick = lambda f: (
        F.when(link, link_target(f("link_path"), f("href")))
        .when(level, F.concat(F.lit("h"), f("level").cast("string")))
        .when(image, f("alt"))
        .otherwise(f("text"))
    )
    label = (
        F.when(link, F.concat(F.lit('Link "'), short(a("text")), F.lit('" has another destination')))
        .when(level, F.concat(F.lit('Heading "'), short(a("text")), F.lit('" sits at another level')))
        .when(image, F.lit("Alternative text of an image differs"))
        .otherwise(F.concat(F.lit('Wording moved: "'), short(a("text")), F.lit('" -> "'), short(b("text")), F.lit('"')))
    )
    return df.withColumns({"change_label": label, "change_expected": pick(a), "change_actual": pick(b)})


def _boxes(pairs: DataFrame) -> tuple[Column, Column]:
    have = set(pairs.columns)
    return tuple(F.col(c) if c in have else F.lit(None) for c in ("source_box", "target_box"))


def one_sided_findings(pairs: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Both kinds in one pass: the pairs are often a join of whole nodes, which a union of two filters would make twice."""
    sbox, tbox = _boxes(pairs)
    missing = F.col("target").isNull()
    pick = lambda a, b: F.when(missing, a).otherwise(b)
    return build(
        pairs.where(missing != F.col("source").isNull()),
        pick(F.lit("content.missing"), F.lit("content.added")), overrides, path=F.col("path"), source_url=F.col("source_url"),
        target_url=F.col("target_url"), region=F.col("region"), node_kind=pick(F.col("source.kind"), F.col("target.kind")),
        subject=pick(subject("source"), subject("target")),
        label=pick(F.concat(F.lit("The target lacks "), _describe("source")), F.concat(F.lit("The target adds "), _describe("target"))),
        expected_json=F.when(missing, json_text(F.col("source.text"))), actual_json=F.when(~missing, json_text(F.col("target.text"))),
        selector_hint=pick(F.col("source.selector_hint"), F.col("target.selector_hint")),
        source_box=F.when(missing, sbox), target_box=F.when(~missing, tbox),
    )


def with_drift(pairs: DataFrame) -> DataFrame:
    """Matched pairs that differ, with their value changes and change texts.

    Only these rows pay for value extraction.
    """
    changed = pairs.where(F.col("identical") == F.lit(False))
    moved = value_changes(F.col("source.text"), F.col("target.text"))
    return with_change_text(changed.withColumn("value_changes", moved))


def drift_findings(
    drift: DataFrame, overrides: Mapping[str, str] | None = None, min_confidence: float = 0.5
) -> DataFrame:
    """`content.drift`, or `content.value-drift` where a comparable fact moved."""
    sbox, tbox = _boxes(drift)
    moved = F.size("value_changes") > 0
    category = F.when(moved, F.lit("content.value-drift")).otherwise(F.lit("content.drift"))
    listed = F.array_join(F.transform("value_changes", describe_change), "; ")
    return build(
        drift, category, overrides, path=F.col("path"), source_url=F.col("source_url"), target_url=F.col("target_url"),
        region=F.col("region"), node_kind=F.col("source.kind"), subject=subject("source"),
        facet=F.when(moved, F.array_join(F.transform("value_changes", lambda c: c["class"]), "+")),
        confidence=F.col("confidence"),
        label=F.when(moved, F.concat("change_label", F.lit(" ("), listed, F.lit(")"))).otherwise(F.col("change_label")),
        expected_json=json_text(F.col("change_expected")), actual_json=json_text(F.col("change_actual")),
        low_confidence=F.col("confidence") < min_confidence, selector_hint=F.col("source.selector_hint"),
        target_selector_hint=F.col("target.selector_hint"), source_box=sbox, target_box=tbox,
        value_changes=F.col("value_changes"),
    )


def content_findings(pairs: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Pairs carry `source_url` and `target_url` of their page pair."""
    return union_all([one_sided_findings(pairs, overrides), drift_findings(with_drift(pairs), overrides)])


# Compared page metadata fields and the snapshot columns they come from.
META_FIELDS = {
    "title": "title", "description": "description", "og:title": "og_title", "og:description": "og_description",
    "lang": "lang",
}


def meta_drift(pages: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Page pairs with both sides' metadata as structs `source_meta` and `target_meta`."""
    clean = lambda side, col: F.trim(F.coalesce(F.col(f"{side}.{col}"), F.lit("")))
    fields = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                clean("source_meta", col).alias("a"),
                clean("target_meta", col).alias("b"),
            )
            for name, col in META_FIELDS.items()
        ]
    )
    differing = F.filter(fields, lambda f: f["a"] != f["b"])
    rows = pages.select("path", "source_url", "target_url", F.inline(differing))
    return build(
        rows, "meta.drift", overrides, path=F.col("path"), source_url=F.col("source_url"),
        target_url=F.col("target_url"), subject=F.lit("meta"), facet=F.col("field"),
        label=F.when(F.col("b") == "", F.concat("field", F.lit(" left empty by the target"))).otherwise(
            F.concat("field", F.lit(" differs"))
        ),
        expected_json=json_text(F.col("a")), actual_json=json_text(F.col("b")),
    )
