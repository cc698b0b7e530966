"""Computed style values: normalisation, comparison and colour distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.base import half_up, let, number_text
from twinlens.functions.csstables import (
    COLOR_NAMES,
    COLOR_PROPERTIES,
    GROUPS,
    LENGTH_PROPERTIES,
)

_TOKEN = r"(?i)#[0-9a-f]{3,8}(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?:rgba?|hsla?)\([^)]*\)"
_NUMBER = r"([+-]?\d*\.?\d+)"
_SEP = r"\s*[,\s]\s*"
_RGB = rf"(?i)^rgba?\(\s*{_NUMBER}(%)?{_SEP}{_NUMBER}(%)?{_SEP}{_NUMBER}(%)?\s*(?:[,/]\s*{_NUMBER}(%)?\s*)?\)$"
_HSL = rf"(?i)^hsla?\(\s*{_NUMBER}(?:deg)?{_SEP}{_NUMBER}%{_SEP}{_NUMBER}%\s*(?:[,/]\s*{_NUMBER}(%)?\s*)?\)$"
_HEX = r"(?i)^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"


def parse_px(value: Column) -> Column:
    return F.regexp_extract(F.trim(value), r"^(-?\d*\.?\d+)px$", 1).try_cast("double")


def _rgba_text(r: Column, g: Column, b: Column, a: Column) -> Column:
    channels = [half_up(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("bigint").cast("string") for c in (r, g, b)]
    alpha = number_text(half_up(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)), 3))
    return F.concat(F.lit("rgba("), F.concat_ws(", ", *channels, alpha), F.lit(")"))


def _hex_color(c: Column) -> Column:
    digits = F.regexp_extract(c, _HEX, 1)
    long = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    pair = lambda d, i: F.conv(F.substring(d, i, 2), 16, 10).cast("double")
    return let(
        long,
        lambda d: _rgba_text(
            pair(d, 1), pair(d, 3), pair(d, 5), F.when(F.length(d) == 8, pair(d, 7) / 255.0).otherwise(F.lit(1.0))
        ),
    )


def _alpha(c: Column, pattern: str, at: int) -> Column:
    raw = F.regexp_extract(c, pattern, at).try_cast("double")
    scaled = F.when(F.regexp_extract(c, pattern, at + 1) == "%", raw / 100.0).otherwise(raw)
    return F.coalesce(scaled, F.lit(1.0))


def _rgb_color(c: Column) -> Column:
    def channel(i: int) -> Column:
        raw = F.regexp_extract(c, _RGB, i).cast("double")
        return F.when(F.regexp_extract(c, _RGB, i + 1) == "%", raw * 255.0 / 100.0).otherwise(raw)

    return _rgba_text(channel(1), channel(3), channel(5), _alpha(c, _RGB, 7))


def _hsl_color(c: Column) -> Column:
    h = F.pmod(F.regexp_extract(c, _HSL, 1).cast("double"), F.lit(360.0))
    s = F.regexp_extract(c, _HSL, 2).cast("double") / 100.0
    lightness = F.regexp_extract(c, _HSL, 3).cast("double") / 100.0
    spread = s * F.least(lightness, 1.0 - lightness)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30.0, F.lit(12.0))
        wave = F.greatest(F.lit(-1.0), F.least(k - 3.0, 9.0 - k, F.lit(1.0)))
        return 255.0 * (lightness - spread * wave)

    return _rgba_text(channel(0), channel(8), channel(4), _alpha(c, _HSL, 4))


def normalize_color(value: Column) -> Column:
    """`rgba(r, g, b, a)` for hex, rgb, hsl and named colours; other text lower-cased."""
    # One literal text: Spark folds it to a constant map once.
    names = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in COLOR_NAMES.items())))

    def body(c: Column) -> Column:
        named = F.element_at(names, F.lower(c))
        return (
            F.when(c == "", c)
            .when(c.rlike(_HEX), _hex_color(c))
            .when(c.rlike(_RGB), _rgb_color(c))
            .when(c.rlike(_HSL), _hsl_color(c))
            .when(F.lower(c) == "transparent", F.lit("rgba(0, 0, 0, 0)"))
            .when(named.isNotNull(), _hex_color(named))
            .otherwise(F.lower(c))
        )

    return let(F.trim(value), body)


def normalize_font(value: Column) -> Column:
    families = F.transform(
        F.split(value, ","), lambda f: F.lower(F.regexp_replace(F.trim(f), "^[\"']|[\"']$", ""))
    )
    return F.array_join(F.filter(families, lambda f: f != ""), ", ")


def primary_font(value: Column) -> Column:
    return F.trim(F.substring_index(normalize_font(value), ",", 1))


def embedded_colors(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0))


def color_skeleton(value: Column) -> Column:
    """The value with each colour replaced by one NUL placeholder."""
    return F.regexp_replace(value, _TOKEN, "\u0000")


def normalize_embedded(value: Column) -> Column:
    """Canonicalise every colour inside a compound value."""
    pieces = F.split(value, _TOKEN, -1)
    colors = F.transform(embedded_colors(value), normalize_color)
    woven = F.zip_with(
        pieces, colors, lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit("")))
    )
    return F.when(value.rlike(_TOKEN), F.array_join(woven, "")).otherwise(value)


def normalize_compound(value: Column) -> Column:
    out = F.regexp_replace(F.trim(value), r"\s+", " ")
    return F.lower(F.regexp_replace(out, r"\s*,\s*", ", "))


def is_color_property(prop: Column) -> Column:
    return prop.isin(*COLOR_PROPERTIES)


def is_length_property(prop: Column) -> Column:
    return prop.isin(*LENGTH_PROPERTIES)


def group_of(prop: Column) -> Column:
    out = F
    for name, members in GROUPS.items():
        out = out.when(prop.isin(*members), F.lit(name))
    return out.otherwise(F.lit("other"))


def normalize_css(prop: Column, value: Column) -> Column:
    """Comparable form of one computed value, by property."""

    def body(v: Column) -> Column:
        px = parse_px(v)
        return (
            F.when(v == "", v)
            .when(prop == "font-family", normalize_font(v))
            .when(is_color_property(prop), normalize_color(v))
            .when(
                is_length_property(prop) & px.isNotNull(),
                F.concat(number_text(half_up(px, 2)), F.lit("px")),
            )
            .otherwise(normalize_compound(normalize_embedded(v)))
        )

    return let(F.trim(value), body)


_RGBA = r"^rgba\((\d+), (\d+), (\d+), [\d.]+\)$"


def _channels(color: Column) -> Column:
    """The linear red, green and blue of a canonical colour; NULL for other texts."""
    linear = lambda c: let(
        c.cast("double") / 255.0, lambda v: F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)
    )
    rgb = F.array(*[F.regexp_extract(color, _RGBA, i) for i in (1, 2, 3)])
    return F.when(color.rlike(_RGBA), F.transform(rgb, linear))


def _lab(color: Column) -> Column:
    """CIE Lab (D50) of a canonical colour as a struct `l, a, b`."""
    white = (0.9642200, 1.0, 0.8252100)
    matrix = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))

    def shares(rgb: Column) -> Column:
        return F.array(*[sum(rgb[i] * F.lit(m / w) for i, m in enumerate(row)) for row, w in zip(matrix, white, strict=True)])

    root = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    lab = lambda f: F.struct(
        (116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b")
    )
    return let(F.transform(let(_channels(color), shares), root), lambda f: F.when(f.isNotNull(), lab(f)))


def _ciede2000(p: Column, q: Column) -> Column:
    """CIEDE2000 of two Lab structs, scaled so that black against white is 1."""
    chroma = lambda a, b: F.sqrt(a * a + b * b)
    share = lambda c: let(F.pow(c, F.lit(7.0)), lambda c7: F.sqrt(c7 / (c7 + 25.0**7)))
    turned = lambda h: F.pmod(h, F.lit(360.0))
    hue = lambda a, b: turned(F.degrees(F.atan2(b, a)))
    cosine = lambda h: F.cos(F.radians(h))

    def polar(grow: Column) -> Column:
        a1, a2 = p["a"] * grow, q["a"] * grow
        return F.struct(
            chroma(a1, p["b"]).alias("c1"), chroma(a2, q["b"]).alias("c2"), hue(a1, p["b"]).alias("h1"), hue(a2, q["b"]).alias("h2")
        )

    def means(x: Column) -> Column:
        grey = x["c1"] * x["c2"] == 0
        dh = F.when(grey, 0.0).otherwise(F.pmod(x["h2"] - x["h1"] + 180, F.lit(360.0)) - 180)
        return let(
            dh,
            lambda d: F.struct(
                d.alias("dh"), F.when(grey, x["h1"] + x["h2"]).otherwise(turned(x["h1"] + d / 2)).alias("h"),
                ((x["c1"] + x["c2"]) / 2).alias("c"), F.sqrt(x["c1"] * x["c2"]).alias("cc"), (x["c2"] - x["c1"]).alias("dc"),
            ),
        )

    def parts(m: Column) -> Column:
        h, light = m["h"], F.pow((p["l"] + q["l"]) / 2 - 50, F.lit(2.0))
        weight = 1 - 0.17 * cosine(h - 30) + 0.24 * cosine(2 * h) + 0.32 * cosine(3 * h + 6) - 0.20 * cosine(4 * h - 63)
        turn = -2 * share(m["c"]) * F.sin(F.radians(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0)))))
        return F.struct(
            ((q["l"] - p["l"]) / (1 + 0.015 * light / F.sqrt(20 + light))).alias("l"), (m["dc"] / (1 + 0.045 * m["c"])).alias("c"),
            (2 * m["cc"] * F.sin(F.radians(m["dh"] / 2)) / (1 + 0.015 * m["c"] * weight)).alias("h"), turn.alias("t"),
        )

    total = lambda d: d["l"] * d["l"] + d["c"] * d["c"] + d["h"] * d["h"] + d["t"] * d["c"] * d["h"]
    grow = 1.5 - 0.5 * share((chroma(p["a"], p["b"]) + chroma(q["a"], q["b"])) / 2)
    squared = let(let(let(let(grow, polar), means), parts), total)
    return F.round(F.least(F.sqrt(F.greatest(squared, F.lit(0.0))) / 100, F.lit(1.0)), 3)


def worst_delta(a: Column, b: Column) -> Column:
    """Largest distance between two equally long lists of canonical colours; NULL if any is none."""
    one = lambda s, t: let(F.struct(_lab(s).alias("p"), _lab(t).alias("q")), lambda x: _ciede2000(x["p"], x["q"]))
    return let(F.zip_with(a, b, one), lambda found: F.when(~F.exists(found, lambda d: d.isNull()), F.array_max(found)))


def color_distance(a: Column, b: Column) -> Column:
    """Perceptual distance of two canonical colours, 0..1; NULL when either is no colour."""
    return worst_delta(F.array(a), F.array(b))


def compare_css(
    df: DataFrame,
    prop: str = "property",
    source: str = "source_value",
    target: str = "target_value",
    length_px: float = 1.0,
    color_tolerance: float = 0.01,
) -> DataFrame:
    """Add normalized_source, normalized_target, equal, kind, delta_px and delta_e.

    Only pairs of colours that differ are measured: for every other row the lists are NULL.
    """
    p = F.col(prop)
    df = df.withColumns(
        {
            "normalized_source": normalize_css(p, F.col(source)),
            "normalized_target": normalize_css(p, F.col(target)),
        }
    )
    a, b = F.col("normalized_source"), F.col("normalized_target")
    differs = (a != b) & (p != "font-family")
    whole = is_color_property(p)
    df = df.withColumns(
        {
            "_colors_a": F.when(differs, F.when(whole, F.array(a)).otherwise(embedded_colors(a))),
            "_colors_b": F.when(differs, F.when(whole, F.array(b)).otherwise(embedded_colors(b))),
        }
    )
    comparable = (
        (F.size("_colors_a") > 0)
        & (F.size("_colors_a") == F.size("_colors_b"))
        & (whole | (color_skeleton(a) == color_skeleton(b)))
    )
    df = df.withColumn("_comparable", F.coalesce(comparable, F.lit(False)))
    delta = worst_delta(
        F.when(F.col("_comparable"), F.col("_colors_a")), F.when(F.col("_comparable"), F.col("_colors_b"))
    )
    # A generated column: filters on it stay above, else each would carry a copy of all that it is made from.
    df = df.select("*", F.explode(F.array(delta)).alias("delta_e"))
    de = F.col("delta_e")
    pa, pb = parse_px(a), parse_px(b)
    delta_px = F.when(
        differs & de.isNull() & is_length_property(p) & pa.isNotNull() & pb.isNotNull(), half_up(pb - pa, 2)
    )
    df = df.withColumns({"delta_e": de, "delta_px": delta_px})
    de, dpx = F.col("delta_e"), F.col("delta_px")
    kind = (
        F.when(a == b, F.lit("equal"))
        .when(
            p == "font-family",
            F.when(primary_font(F.col(source)) == primary_font(F.col(target)), F.lit("font-fallback")).otherwise(
                F.lit("value")
            ),
        )
        .when(de.isNotNull(), F.when(de <= color_tolerance, F.lit("equal")).otherwise(F.lit("color")))
        .when(dpx.isNotNull(), F.when(F.abs(dpx) <= length_px, F.lit("equal")).otherwise(F.lit("length")))
        .otherwise(F.lit("value"))
    )
    return (
        df.withColumn("kind", kind)
        .withColumn("equal", F.col("kind") == "equal")
        .drop("_colors_a", "_colors_b", "_comparable")
    )


def geometry_tolerance(width: Column, px: float, fraction: float) -> Column:
    return F.greatest(F.lit(float(px)), width * F.lit(float(fraction)))
