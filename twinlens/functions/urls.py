"""URL columns: canonical form, href resolution and classification, path mapping.

The functions take a DataFrame and add columns step by step, so that a parsed part
is computed once and reused instead of being inlined into every later expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.config import PathMap, UrlRules

# Query parameters that never change what a page shows.
TRACKING_PARAMS = (
    "gclid gbraid wbraid dclid fbclid msclkid yclid twclid ttclid igshid mc_cid mc_eid _ga _gl "
    "_hsenc _hsmi vero_id oly_enc_id oly_anon_id mkt_tok trk trkCampaign"
).split()

_ABSOLUTE = (
    r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?)?"
    r"([^?#]*)(\?[^#]*)?(#.*)?$"
)
_HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def clean_url(url: Column) -> Column:
    return F.trim(F.regexp_replace(url, r"[\t\n\r]", ""))


def _encode_path(path: Column) -> Column:
    """Percent-encode what a URL path may not hold; existing escapes stay as they are."""
    runs = F.regexp_extract_all(
        path, F.lit(r'[\x00-\x20"<>`{}\x7f-\x{10ffff}]+|[^\x00-\x20"<>`{}\x7f-\x{10ffff}]+'), F.lit(0)
    )
    encoded = F.array_join(
        F.transform(
            runs,
            lambda r: F.when(
                r.rlike(r'[\x00-\x20"<>`{}\x7f-\x{10ffff}]'),
                F.regexp_replace(F.url_encode(r), r"\+", "%20"),
            ).otherwise(r),
        ),
        "",
    )
    return F.when(path.rlike(r'[\x00-\x20"<>`{}\x7f-\x{10ffff}]'), encoded).otherwise(path)


def _remove_dots(path: Column) -> Column:
    """Resolve . and .. segments; only paths that hold one pay for it."""
    ends_open = path.rlike(r"/\.\.?$")
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    joined = F.when(ends_open & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), joined).otherwise(path)


def parse_url(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add scheme, host, port, path, query and fragment; all NULL unless http(s)."""
    u = F.col(f"{prefix}_clean")
    df = df.withColumn(f"{prefix}_clean", clean_url(F.col(url)))
    ok = u.rlike(r"^[hH][tT][tT][pP][sS]?://[^/?#]+")
    part = lambda i: F.when(ok, F.regexp_extract(u, _ABSOLUTE, i))
    scheme = F.lower(part(1))
    port = part(3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    raw = F.regexp_replace(part(4), r"\\", "/")
    df = df.withColumns(
        {
            f"{prefix}_scheme": scheme,
            f"{prefix}_host": F.lower(part(2)),
            f"{prefix}_port": F.when(default, F.lit("")).otherwise(port),
            f"{prefix}_rawpath": _encode_path(F.when(raw == "", F.lit("/")).otherwise(raw)),
            f"{prefix}_query": part(5),
            f"{prefix}_fragment": part(6),
        }
    )
    return df.withColumn(f"{prefix}_rawpath", _remove_dots(F.col(f"{prefix}_rawpath"))).drop(f"{prefix}_clean")


def origin(scheme: Column, host: Column, port: Column) -> Column:
    return F.concat(
        scheme, F.lit("://"), host, F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port))
    )


def normalize_path(path: Column, rules: UrlRules) -> Column:
    out = F.regexp_replace(path, "/{2,}", "/")
    if rules.lowercase_path:
        out = F.lower(out)
    if rules.index_files:
        names = "|".join(f"\\Q{n.lower()}\\E" for n in rules.index_files)
        out = F.regexp_replace(out, f"(?i)/(?:{names})$", "/")
    if rules.trailing_slash == "strip":
        out = F.regexp_replace(out, "/+$", "")
    elif rules.trailing_slash == "add":
        out = F.regexp_replace(out, "([^/])$", "$1/")
    return F.regexp_replace(out, "^$", "/")


def _form_decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.regexp_replace(value, r"\+", " "))


def query_params(query: Column) -> Column:
    """Decoded (name, value) pairs of a query string, in order."""
    pieces = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("name"),
            _form_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias(
                "value"
            ),
        ),
    )


def normalize_query(query: Column, rules: UrlRules) -> Column:
    """Drop tracking and ignored parameters, sort, re-encode form style."""
    drop = [p.lower() for p in rules.drop_params]
    allow = [p.lower() for p in rules.query_allowlist]

    def keep(p: Column) -> Column:
        name = p["name"]
        lower = F.lower(name)
        ok = ~name.isin(*TRACKING_PARAMS) & ~lower.startswith("utm_")
        if drop:
            ok = ok & ~lower.isin(*drop)
        if allow:
            ok = ok & lower.isin(*allow)
        return ok

    kept = F.array_sort(F.filter(query_params(query), keep))
    joined = F.array_join(
        F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )
    out = F.regexp_replace(F.concat(F.lit("?"), joined), r"^\?$", "")
    return F.when(F.coalesce(query, F.lit("")).isin("", "?"), F.lit("")).otherwise(out)


def keep_fragment(fragment: Column, mode: str) -> Column:
    """Whether a fragment is a route (part of the page's identity) or just an anchor."""
    present = ~F.coalesce(fragment, F.lit("")).isin("", "#")
    if mode == "never":
        return F.lit(False)
    if mode == "always":
        return present
    return present & fragment.rlike("^#?[/!]")


def canonicalize(df: DataFrame, url: str, rules: UrlRules = UrlRules(), prefix: str = "c") -> DataFrame:
    """Add `<prefix>_href`, `_key`, `_origin`, `_path`, `_search`, `_hash`; NULL when not http(s)."""
    tmp = f"_{prefix}"
    df = parse_url(df, url, tmp)
    fragment = F.col(f"{tmp}_fragment")
    df = df.withColumns(
        {
            f"{prefix}_origin": origin(F.col(f"{tmp}_scheme"), F.col(f"{tmp}_host"), F.col(f"{tmp}_port")),
            f"{prefix}_path": normalize_path(F.col(f"{tmp}_rawpath"), rules),
            f"{prefix}_search": F.when(
                F.col(f"{tmp}_scheme").isNotNull(), normalize_query(F.col(f"{tmp}_query"), rules)
            ),
            f"{prefix}_hash": F.when(
                F.col(f"{tmp}_scheme").isNotNull(),
                F.when(keep_fragment(fragment, rules.hash_routing), fragment).otherwise(F.lit("")),
            ),
        }
    )
    key = F.concat(F.col(f"{prefix}_path"), F.col(f"{prefix}_search"), F.col(f"{prefix}_hash"))
    return df.withColumns(
        {f"{prefix}_key": key, f"{prefix}_href": F.concat(F.col(f"{prefix}_origin"), key)}
    ).drop(*[f"{tmp}_{p}" for p in ("scheme", "host", "port", "rawpath", "query", "fragment")])


def serialize_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add the absolute URL as a browser writes it: path escaped, host lower-cased, default port gone."""
    df = parse_url(df, url, "_s")
    whole = F.concat(
        origin(F.col("_s_scheme"), F.col("_s_host"), F.col("_s_port")),
        F.col("_s_rawpath"),
        F.regexp_replace(F.col("_s_query"), " ", "%20"),
        F.regexp_replace(F.col("_s_fragment"), " ", "%20"),
    )
    return df.withColumn(out, whole).drop(*[f"_s_{p}" for p in ("scheme", "host", "port", "rawpath", "query", "fragment")])


def resolve_href(href: Column, page_url: Column, mode: str = "auto") -> Column:
    """Absolute http(s) URL an href points at, or NULL."""
    h = clean_url(href)
    page_scheme = F.lower(F.regexp_extract(page_url, r"^([a-zA-Z]+)://", 1))
    page_origin = F.regexp_extract(page_url, r"^[a-zA-Z]+://[^/?#]+", 0)
    sans_fragment = F.regexp_replace(page_url, "#.*$", "")
    sans_query = F.regexp_replace(page_url, "[?#].*$", "")
    directory = F.when(
        sans_query == page_origin, F.concat(page_origin, F.lit("/"))
    ).otherwise(F.regexp_replace(sans_query, "[^/]*$", ""))
    return (
        F.when(h == "", F.lit(None))
        .when(h.startswith("#"), F.when(keep_fragment(h, mode), F.concat(sans_fragment, h)))
        .when(h.rlike(r"(?i)^https?://[^/?#]"), h)
        .when(h.rlike(_HAS_SCHEME), F.lit(None))
        .when(h.startswith("//"), F.concat(page_scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(page_origin, h))
        .when(h.startswith("?"), F.concat(sans_query, h))
        .otherwise(F.concat(directory, h))
    )


def classify_href(href: Column, page_url: Column, allowed: Column, mode: str = "auto") -> Column:
    """Link kind; `allowed` says whether the resolved URL is on an admitted origin."""
    h = clean_url(href)
    resolved = resolve_href(href, page_url, mode)
    return (
        F.when(h == "", F.lit("unsupported"))
        .when(h.startswith("#"), F.when(keep_fragment(h, mode), F.lit("internal")).otherwise(F.lit("anchor")))
        .when(h.rlike("(?i)^mailto:"), F.lit("mailto"))
        .when(h.rlike("(?i)^tel:"), F.lit("tel"))
        .when(h.rlike("(?i)^(javascript|data|blob|about):"), F.lit("unsupported"))
        .when(resolved.isNull(), F.lit("unsupported"))
        .when(allowed, F.lit("internal"))
        .otherwise(F.lit("external"))
    )


def url_origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, default ports left out."""
    base = F.lower(F.regexp_extract(clean_url(url), r"^[a-zA-Z]+://(?:[^/?#@]*@)?[^/?#]*", 0))
    base = F.regexp_replace(base, r"//[^/@]*@", "//")
    return F.regexp_replace(F.regexp_replace(base, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")


def map_path(path: Column, mapping: PathMap) -> Column:
    """Target path of a source path: exact override, then first matching rewrite, then itself."""
    out: Column | None = None
    for rule in mapping.rewrites:
        if rule.every_match:
            replaced = F.regexp_replace(path, rule.pattern, rule.replacement)
        else:
            # First match only: what precedes it is kept lazily, what follows greedily.
            replaced = _replace_first(path, rule.pattern, rule.replacement)
        cond = path.rlike(rule.pattern)
        out = F.when(cond, replaced) if out is None else out.when(cond, replaced)
    result = path if out is None else out.otherwise(path)
    if mapping.overrides:
        pairs = [F.lit(x) for kv in mapping.overrides.items() for x in kv]
        result = F.coalesce(F.element_at(F.create_map(*pairs), path), result)
    return result


def _replace_first(path: Column, pattern: str, replacement: str) -> Column:
    if pattern.startswith("^"):
        return F.regexp_replace(path, pattern, replacement)
    groups = _count_groups(pattern)
    return F.regexp_replace(
        path, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{_shift_groups(replacement, 1)}${groups + 2}"
    )


def _count_groups(pattern: str) -> int:
    return re.compile(pattern).groups


def _shift_groups(replacement: str, by: int) -> str:
    return re.sub(r"\$(\d+)", lambda m: f"${int(m.group(1)) + by}", replacement)


def reverse_path(path: Column, mapping: PathMap) -> Column:
    """Source path of a target path where an override names one, else the path itself."""
    if not mapping.overrides:
        return path
    reverse = {v: k for k, v in mapping.overrides.items()}
    pairs = [F.lit(x) for kv in reverse.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), path), path)


def in_origins(url: Column, origins: Sequence[str]) -> Column:
    return url_origin(url).isin(*[o.rstrip("/").lower() for o in origins])
