"""Environment-independent identity of an image URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.urls import parse_url, query_params, resolve_href

# Proxy parameters that carry the real asset, and what is stripped from a name.
NESTED_PARAMS = ("url", "src", "image", "path")
_LOOKS_LIKE_FILE = r"(?i)\.[a-z]{2,5}(?:$|[?#])"
_TRANSFORM = r"(?i)^[a-z]{1,3}_[^/]+$"
_EXTENSION = r"(?i)\.(?:avif|bmp|gif|ico|jpe?g|png|svg|tiff?|webp|ashx)$"
_CONTENT_HASH = r"(?i)[.\-_][0-9a-f]{8,40}$"
_PLACEHOLDER = "https://placeholder.invalid"
_UNWRAP_LEVELS = 3


def _first_nested(query: Column) -> Column:
    """First proxy parameter whose value names a file, in the fixed parameter order."""
    params = query_params(query)
    found = F.transform(
        F.array(*[F.lit(p) for p in NESTED_PARAMS]),
        lambda name: F.get(F.filter(params, lambda p: p["name"] == name), F.lit(0))["value"],
    )
    return F.get(F.filter(found, lambda v: v.isNotNull() & v.rlike(_LOOKS_LIKE_FILE)), F.lit(0))


def with_asset_key(df: DataFrame, src: str, page_url: str | None = None, out: str = "asset_key") -> DataFrame:
    """Add the asset key: the file stem without host, proxy, transforms, hash and extension."""
    page = F.coalesce(F.col(page_url), F.lit(_PLACEHOLDER)) if page_url else F.lit(_PLACEHOLDER)
    trimmed = F.trim(F.col(src))
    df = df.withColumns({"_ak_src": trimmed, "_ak_url": resolve_href(trimmed, page)})
    for level in range(_UNWRAP_LEVELS):
        # Most addresses are no proxies: those without a query, or without a nested address one level up, are left alone.
        wrapped = F.col("_ak_nested").isNotNull() if level else F.col("_ak_url").contains("?")
        df = df.withColumn("_ak_nested", F.when(wrapped, _first_nested(F.regexp_extract(F.col("_ak_url"), r"\?[^#]*", 0))))
        df = df.withColumn(
            "_ak_url",
            F.coalesce(
                F.when(F.col("_ak_nested").isNotNull(), resolve_href(F.col("_ak_nested"), page)), F.col("_ak_url")
            ),
        )
    df = parse_url(df, "_ak_url", "_aku")
    segments = F.filter(F.split(F.col("_aku_rawpath"), "/"), lambda s: s != "")
    meaningful = F.filter(segments, lambda s: ~s.rlike(_TRANSFORM))
    last = lambda a: F.get(a, F.size(a) - 1)
    df = df.withColumn("_ak_base", F.coalesce(last(meaningful), last(segments), F.lit("")))
    plus_safe = F.regexp_replace(F.col("_ak_base"), r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(plus_safe), F.col("_ak_base"))
    stem = F.regexp_replace(F.regexp_replace(decoded, _EXTENSION, ""), _CONTENT_HASH, "")
    df = df.withColumn("_ak_stem", F.lower(stem))
    s = F.col("_ak_src")
    key = (
        F.when(s == "", F.lit(""))
        .when(s.startswith("data:"), F.concat(F.lit("data:"), F.substring(s, 1, 64), F.when(F.length(s) > 64, F.concat(F.lit("#"), F.sha1(s))).otherwise("")))
        .when(F.col("_aku_scheme").isNull(), F.lower(s))
        .when(F.col("_ak_base") == "", F.lower(F.col("_aku_rawpath")))
        .when(F.col("_ak_stem") == "", F.lower(F.col("_ak_base")))
        .otherwise(F.col("_ak_stem"))
    )
    keep = [c for c in df.columns if not c.startswith(("_ak_", "_aku_")) and c != out]
    return df.select(*keep, key.alias(out))
