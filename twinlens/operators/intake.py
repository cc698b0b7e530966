"""Page intake over a table of offered URLs: admission, duplicates, caps and crawl statistics."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.config import IntakeRules, TrapLimits, UrlRules
from twinlens.functions.urls import canonicalize, clean_url, parse_url, query_params
from twinlens.functions.urls import origin as origin_of
from twinlens.operators.scan import CHUNK, first_rows, running
from twinlens.session import cut_lineage


def _literal_origin(url: str) -> str:
    parts = urlsplit(url.lower())
    default = {"http": 80, "https": 443}.get(parts.scheme)
    port = f":{parts.port}" if parts.port and parts.port != default else ""
    return f"{parts.scheme}://{parts.hostname}{port}"


def with_url_parts(df: DataFrame, url: str = "url", prefix: str = "u") -> DataFrame:
    df = parse_url(df, url, prefix)
    return df.withColumn(
        f"{prefix}_origin", origin_of(F.col(f"{prefix}_scheme"), F.col(f"{prefix}_host"), F.col(f"{prefix}_port"))
    )


def origin_allowed(rules: IntakeRules, prefix: str = "u") -> Column:
    """http(s), an admitted origin, and below the base path when the base URL names one."""
    web = F.col(f"{prefix}_scheme").isNotNull()
    if not rules.same_origin_only:
        return web
    origins = sorted({_literal_origin(u) for u in (rules.base_url, *rules.additional_origins)})
    ok = web & F.col(f"{prefix}_origin").isin(*origins)
    base_path = urlsplit(rules.base_url).path.rstrip("/").lower()
    if base_path:
        path = F.lower(F.col(f"{prefix}_rawpath"))
        ok = ok & ((path == base_path) | path.startswith(f"{base_path}/"))
    return F.coalesce(ok, F.lit(False))


def trap_reason(url: Column, limits: TrapLimits = TrapLimits(), prefix: str = "u") -> Column:
    """Why a URL looks like part of an endless space, or NULL."""
    segments = F.filter(F.split(F.col(f"{prefix}_rawpath"), "/"), lambda s: s != "")
    repeated = F.array_max(
        F.transform(F.array_distinct(segments), lambda d: F.size(F.filter(segments, lambda s: s == d)))
    )
    params = F.size(query_params(F.coalesce(F.col(f"{prefix}_query"), F.lit(""))))
    return (
        F.when(F.length(clean_url(url)) > limits.url_length, F.lit("url-length"))
        .when(F.size(segments) > limits.segments, F.lit("path-segments"))
        .when(params > limits.params, F.lit("query-params"))
        .when(repeated >= limits.repeats, F.lit("repeated-segment"))
    )


def _any_match(path: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | path.rlike(pattern)
    return out


def classify_offers(offers: DataFrame, rules: IntakeRules, urls: UrlRules = UrlRules()) -> DataFrame:
    """Add the canonical URL and `reject`: the first row-level reason that applies, or NULL.

    Order of reasons: off-origin, trap, excluded, ignored path, not included.
    """
    df = canonicalize(with_url_parts(offers), "url", urls)
    path = F.col("c_path")
    reject = (
        F.when(~origin_allowed(rules), F.lit("off-origin"))
        .when(trap_reason(F.col("url"), rules.traps).isNotNull(), F.lit("trap"))
        .when(_any_match(path, rules.exclude), F.lit("excluded"))
        .when(_any_match(path, rules.ignore_paths), F.lit("ignored-path"))
    )
    if rules.include:
        reject = reject.when(~_any_match(path, rules.include), F.lit("not-included"))
    return df.withColumn("reject", reject)


def depth_levels(admitted: DataFrame) -> DataFrame:
    """Per side, URL and depth: first arrival, number of offers, and whether it improved the depth.

    A page everybody links to has millions of offers but only a handful of depths, so the
    aggregation does the work and the window sees one row per depth.
    """
    levels = admitted.groupBy("side", "c_href", "depth").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("offers")
    )
    closer = Window.partitionBy("side", "c_href").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.min("first_seq").over(closer)
    improves = beaten.isNull() | (F.col("first_seq") < beaten)
    return levels.withColumn("improves", improves)


def decide_offers(classified: DataFrame, max_depth: int, captured: DataFrame | None = None) -> DataFrame:
    """Add `decision` to every offer: accepted, promoted, or a reject reason.

    An offer counts when it arrives first at a depth below every depth seen before it.
    `captured(side, c_href, captured_seq)`, when given, says when a page was fetched: later
    offers of it are already-captured rather than duplicate.
    """
    admitted = classified.where(F.col("reject").isNull())
    best = depth_levels(admitted).where("improves")
    arrival = Window.partitionBy("side", "c_href").orderBy(F.col("depth").desc())
    arrival = arrival.rowsBetween(Window.unboundedPreceding, -1)
    queued_before = F.max(F.when(F.col("depth") <= max_depth, 1)).over(arrival)
    best = best.withColumn(
        "_decision",
        F.when(F.col("depth") > max_depth, F.lit("depth-exceeded"))
        .when(queued_before == 1, F.lit("promoted"))
        .otherwise(F.lit("accepted")),
    ).select("side", "c_href", F.col("first_seq").alias("seq"), "depth", "_decision")
    decided = classified.join(best, ["side", "c_href", "seq", "depth"], "left")
    decided = decided.withColumn(
        "decision", F.coalesce(F.col("reject"), F.col("_decision"), F.lit("duplicate"))
    ).drop("_decision")
    if captured is None:
        return decided
    late = (F.col("captured_seq") < F.col("seq")) & F.col("decision").isin("accepted", "promoted", "duplicate")
    return (
        decided.join(captured.select("side", "c_href", "captured_seq"), ["side", "c_href"], "left")
        .withColumn("decision", F.when(late, F.lit("already-captured")).otherwise(F.col("decision")))
        .drop("captured_seq")
    )


def best_depth_before(offers: DataFrame, key: Sequence[str] = ("side", "c_href"), chunk: int = CHUNK) -> DataFrame:
    """Best depth seen before each offer, by arrival; hot URLs are scanned in chunks."""
    return running(offers, key, "seq", F.col("depth"), "best_before", "min", inclusive=False, chunk=chunk)


def accepted_pages(decided: DataFrame) -> DataFrame:
    """One queue entry per URL: place by first acceptance, depth as promoted since."""
    taken = decided.where(F.col("decision").isin("accepted", "promoted"))
    return taken.groupBy("side", "c_href").agg(
        F.min("seq").alias("seq"), F.min("depth").alias("depth"), F.min_by("c_key", "seq").alias("c_key")
    )


def capped_pages(accepted: DataFrame, max_pages: int | None = None) -> DataFrame:
    """On request the first pages by arrival on each side: two top-k sorts, no global window."""
    if max_pages is None:
        return accepted
    part = lambda side: accepted.where(F.col("side") == side).orderBy("seq").limit(max_pages)
    return part("source").unionByName(part("target"))


def reject_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("side", F.col("decision").alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def redirect_aliases(captures: DataFrame) -> DataFrame:
    """Requested pages whose final URL another page owns.

    A page that asks for the URL itself, or else the first that lands on it, owns it.
    """
    asked = captures.select("side", F.col("href").alias("final_href"), F.col("seq").alias("asked_seq"))
    asked = asked.groupBy("side", "final_href").agg(F.min("asked_seq").alias("asked_seq"))
    landed = captures.where(F.col("href") != F.col("final_href"))
    first = landed.groupBy("side", "final_href").agg(
        F.min("seq").alias("first_seq"), F.min_by("href", "seq").alias("first_href")
    )
    joined = landed.join(first, ["side", "final_href"]).join(asked, ["side", "final_href"], "left")
    taken = (F.col("asked_seq") < F.col("seq")) | (F.col("first_seq") < F.col("seq"))
    return joined.select(
        "side", "href", "final_href", "seq",
        F.when(F.coalesce(taken, F.lit(False)), F.lit("alias")).otherwise(F.lit("claims")).alias("outcome"),
    )


def content_aliases(captures: DataFrame, enabled: bool = True) -> DataFrame:
    """Pages whose content an earlier page already showed: alias and the page it repeats."""
    first = captures.groupBy("side", "content_hash").agg(F.min_by("href", "seq").alias("alias_of"))
    joined = captures.join(first, ["side", "content_hash"]).where(F.col("href") != F.col("alias_of"))
    out = joined.select("side", "seq", F.col("href").alias("alias"), "alias_of")
    return out if enabled else out.limit(0)


def alias_lists(aliases: DataFrame) -> DataFrame:
    """Aliases of each page as rows with their number per page.

    Copies of one page may be most of a site, so the list is never folded into one cell.
    """
    sizes = aliases.groupBy("side", "alias_of").agg(F.count(F.lit(1)).alias("aliases"))
    return aliases.join(sizes, ["side", "alias_of"])


def best_attempt(attempts: DataFrame) -> DataFrame:
    """First clean attempt of a page; else fewest errors, most content, earliest."""
    clean = F.size("errors") == 0
    order = [
        F.when(clean, 0).otherwise(1),
        F.when(clean, F.lit(0)).otherwise(F.size("errors")),
        F.when(clean, F.lit(0)).otherwise(-F.col("content_size")),
        F.col("attempt"),
    ]
    return first_rows(attempts, ["side", "path"], order)


def crawl_stats(captures: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per side: captured, failed, slow and retried pages, deepest level, duplicates refused."""
    slow = F.exists("errors", lambda e: e.startswith("readiness"))
    got = captures.groupBy("side").agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if((F.col("status") < 200) | (F.col("status") >= 300)).alias("failed"),
        F.count_if(slow).alias("slow"),
        F.count_if(F.col("attempt") > 1).alias("retried"),
        F.max("depth").alias("max_depth"),
    )
    refused = decided.groupBy("side").agg(F.count_if(F.col("decision") == "duplicate").alias("duplicates"))
    return got.join(refused, "side", "left")


def first_rule(path: Column, patterns: Sequence[str]) -> Column:
    """Index of the first pattern that matches, or NULL."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        out = F.when(path.rlike(patterns[i]), F.lit(i)).otherwise(out)
    return out


def rule_heads(rules: DataFrame) -> DataFrame:
    """Allow and disallow rules with `head`, the literal start of the pattern, and `regex` where a wildcard follows it."""
    wild = F.col("pattern").contains("*") | F.col("pattern").endswith("$")
    head = F.substring_index(F.regexp_replace("pattern", r"\$$", ""), "*", 1)
    regex = F.when(wild, pattern_regex(F.col("pattern")))
    return rules.where(F.col("kind").isin("allow", "disallow")).select("host", "kind", head.alias("head"), regex.alias("regex"), F.length("pattern").alias("length")).distinct()


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest matching rule decides, Allow wins ties; no rule allows.

    `rules(host, kind, pattern)` may hold any number of rules of a host. A rule can match only a path that starts with
    its head, so each start of a path, up to the longest head there is, is looked up by an equality join; wildcards are
    tried on what that finds.
    """
    heads = cut_lineage(rule_heads(rules))
    longest = heads.agg(F.max(F.length("head")).alias("n")).first()["n"]
    if longest is None:
        return pages.withColumn("allowed", F.lit(True))
    asked = pages.select("host", "path").where(F.col("host").isNotNull() & F.col("path").isNotNull()).distinct()
    ends = F.sequence(F.lit(0), F.least(F.length("path"), F.lit(longest)))
    starts = asked.select("host", "path", F.explode(ends).alias("n")).withColumn("head", F.left("path", F.col("n"))).drop("n")
    hits = starts.join(heads, ["host", "head"]).where(F.col("regex").isNull() | F.regexp(F.col("path"), F.col("regex")))
    best = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("length"))), F.lit(-1))
    verdict = hits.groupBy("host", "path").agg((best("allow") >= best("disallow")).alias("allowed"))
    return pages.join(verdict, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).select(*pages.columns, "allowed")


def pattern_regex(pattern: Column) -> Column:
    """Rule pattern as a regular expression: `*` matches anything, a final `$` anchors."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    wild = F.regexp_replace(escaped, r"\*", ".*")
    return F.concat(F.lit("^"), wild, F.when(anchored, F.lit("$")).otherwise(F.lit("")))
