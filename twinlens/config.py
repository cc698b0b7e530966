"""Comparison settings. Defaults are fixed values that results depend on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class UrlRules:
    trailing_slash: str = "strip"  # strip | keep | add
    lowercase_path: bool = True
    query_allowlist: Sequence[str] = ()
    drop_params: Sequence[str] = ()
    index_files: Sequence[str] = ("index.html", "index.htm", "default.aspx")
    hash_routing: str = "auto"  # auto | always | never


@dataclass(frozen=True)
class Rewrite:
    pattern: str
    replacement: str
    every_match: bool = False


@dataclass(frozen=True)
class PathMap:
    overrides: Mapping[str, str] = field(default_factory=dict)
    rewrites: Sequence[Rewrite] = ()


@dataclass(frozen=True)
class Thresholds:
    text_similarity: float = 0.6
    min_match_confidence: float = 0.5
    geometry_px: float = 2.0
    geometry_percent: float = 0.01
    css_length_px: float = 1.0
    css_color_tolerance: float = 0.01
    css_color_warn: float = 0.03
    css_length_warn_px: float = 4.0
    css_length_warn_percent: float = 0.15
    css_geometry_warn_factor: float = 2.0
    price_epsilon: float = 0.001
    image_size_percent: float = 0.02
    fail_on_error: int = 0
    fail_on_warning: int | None = None


@dataclass(frozen=True)
class TrapLimits:
    segments: int = 12
    params: int = 8
    repeats: int = 3
    url_length: int = 2048


@dataclass(frozen=True)
class IntakeRules:
    base_url: str = ""
    additional_origins: Sequence[str] = ()
    same_origin_only: bool = True
    max_depth: int = 2
    max_pages: int | None = None
    exclude: Sequence[str] = ()
    ignore_paths: Sequence[str] = ()
    include: Sequence[str] = ()
    dedupe_identical_content: bool = True
    traps: TrapLimits = TrapLimits()


@dataclass(frozen=True)
class CompareConfig:
    urls: UrlRules = UrlRules()
    path_map: PathMap = PathMap()
    thresholds: Thresholds = Thresholds()
    severities: Mapping[str, str] = field(default_factory=dict)
    ignore_finding_ids: Sequence[str] = ()
    downgrade_categories: Sequence[str] = ()
    ignore_css_properties: Sequence[str] = ()
    ignore_text_patterns: Sequence[str] = ()
    start_urls: Sequence[str] = ("/",)
    treat_unlinked_as_orphans: bool = True
    check_external_links: bool = True
    viewports: Sequence[str] = ("desktop", "tablet", "mobile-md", "mobile-sm")
    primary_viewport: str = "desktop"
