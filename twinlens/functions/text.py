"""Text columns: normalisation, identity keys, trigram similarity, truncation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.base import let

def code_points(*ranges: int | tuple[int, int]) -> str:
    """Body of a regex character class, written as code points so no source line hides one."""
    return "".join(
        f"\\x{{{r[0]:x}}}-\\x{{{r[1]:x}}}" if isinstance(r, tuple) else f"\\x{{{r:x}}}" for r in ranges
    )


# White space beyond ASCII, invisible characters, and the typographic
# quotes and dashes with their plain forms.
WIDE_SPACES = (0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITESPACE = "[\\s" + code_points(*WIDE_SPACES) + "]"
# What a browser's own pattern engine calls white space also holds the byte order mark.
SCRIPT_SPACE = "[\\s" + code_points(*WIDE_SPACES, 0xFEFF) + "]"
INVISIBLE = "[" + code_points(0xAD, (0x200B, 0x200D), 0x2060, 0xFEFF) + "]"
TYPOGRAPHY = {
    0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'", 0x2032: "'", 0x2033: '"',
    0x2010: "-", 0x2013: "-", 0x2014: "-", 0x2212: "-",
}

# Neither NFKC nor the folding of white space, typography and invisible characters changes one of these: printable
# ASCII, Latin letters and plain punctuation. Ordinary text, which holds nothing else, never leaves the JVM. A single
# range sorts out ASCII; the long class is tried on what is left.
_SETTLED = (
    (0x7F, 0x9F), (0xA1, 0xA7), 0xA9, 0xAB, 0xAC, 0xAE, 0xB0, 0xB1, 0xB6, 0xB7, 0xBB, (0xBF, 0x131), (0x134, 0x13E),
    (0x141, 0x148), (0x14A, 0x17E),
)
_ODD = r"[^\x{20}-\x{7E}](?<![" + code_points(*_SETTLED) + "])"


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    if values.null_count == len(values):
        return values
    return pa.array([v if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], values.type)


def is_odd(col: Column) -> Column:
    """Whether a text has a character beyond the settled ones."""
    return col.rlike(_ODD)


def _odd_nfkc(col: Column) -> Column:
    """Unicode compatibility folding of texts with a character beyond the settled ones, else NULL."""
    return _nfkc(F.when(is_odd(col), col))


def nfkc(col: Column) -> Column:
    """Unicode compatibility folding; only strings that could change cross into Python."""
    return F.coalesce(_odd_nfkc(col), col)


def collapse_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, WHITESPACE + "+", " "))


def normalize_text(
    col: Column, ignore_patterns: Sequence[str] = (), lowercase: bool = False, fold: bool = True, settled: bool = False
) -> Column:
    """Comparable form of displayed text: case and punctuation kept, typography folded. `settled`: no text is odd."""
    # Most text is plain already; one look spares it every pass.
    odd = F.lit(None).cast("string") if settled else _odd_nfkc(col) if fold else F.when(is_odd(col), col)
    squeeze = lambda c: F.regexp_replace(c, " +", " ")

    def folded(out: Column) -> Column:
        out = F.regexp_replace(out, WHITESPACE + "+", " ")
        out = F.translate(out, "".join(map(chr, TYPOGRAPHY)), "".join(TYPOGRAPHY.values()))
        return squeeze(F.regexp_replace(out, INVISIBLE, ""))

    out = F.when(odd.isNotNull(), folded(odd)).when(col.contains("  "), squeeze(col)).otherwise(col)
    for pattern in ignore_patterns:
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(squeeze(out) if ignore_patterns else out)
    return F.lower(out) if lowercase else out


def kind_family(kind: Column) -> Column:
    """Paragraphs, list items and table cells are one family; other kinds stand alone."""
    return F.when(kind.isin("paragraph", "listItem", "tableCell"), F.lit("text")).otherwise(kind)


def node_key(family: Column, text: Column) -> Column:
    return F.sha1(F.concat(family, F.lit(":"), text))


def trigrams(col: Column) -> Column:
    """Distinct trigrams of the lower-cased text, two spaces of padding at both ends.

    One regex pass: substring by index would rescan a long text for every gram.
    """
    padded = F.concat(F.lit("  "), F.lower(col), F.lit("  "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient over trigram sets, 0..1."""

    def dice(g: Column) -> Column:
        shared = F.size(F.array_intersect(g["a"], g["b"]))
        return 2.0 * shared / (F.size(g["a"]) + F.size(g["b"]))

    grams = F.struct(trigrams(a).alias("a"), trigrams(b).alias("b"))
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(let(grams, dice))
    )


def truncate(col: Column, limit: int) -> Column:
    """Cut on a word boundary and mark the cut."""
    head = F.regexp_replace(F.substring(col, 1, limit), r"\s+\S*\z", "")
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.rtrim(head), F.lit("...")))
