"""Known licence texts among captured pages, by the digest of their canonical form. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.shared import page_texts

# Public licence notices, word for word.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)

# Equivalent spellings: what is read, and what it counts as. Words are lower-cased by then.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("non commercial", "noncommercial"), ("per cent", "percent"))

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|©|\(c\)|copr\.|all rights reserved)[^\n]*"
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case; without lines that begin as copyright lines; words parted by one space; one spelling. Null counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_A_WORD, " "), F.lit(" "))
    for seen, meant in SPELLINGS:
        out = F.replace(out, F.lit(f" {seen} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """`license_id, text` of the notices above."""
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def license_digests(licenses: DataFrame) -> DataFrame:
    """`digest, license_id`: of ids with one canonical text the first; empty texts and null ids are left out."""
    texts = licenses.select("license_id", canonical(F.col("text")).alias("canonical")).filter("canonical <> '' and license_id is not null")
    return texts.groupBy(F.sha2("canonical", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(pages: DataFrame, licenses: DataFrame) -> DataFrame:
    """`path, digest, license_id` of every captured page, `license_id` null unless its entire text is a known licence.

    `pages` holds `path` and `text` (a page or one block of a page); `licenses` holds `license_id`
    and `text`. Texts are compared as `canonical` writes them, by SHA-256. The licence side has one row per
    digest, so no page is doubled; the join is left to Spark's size check, and a digest that many pages share is
    split by its skew handling.

    A text that is null, empty or without a word has the digest of the empty text and no licence.
    Repeated or null paths return a row each. Empty tables of either kind give no rows or no licence.
    """
    marked = page_texts(pages).select("path", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return marked.join(license_digests(licenses), "digest", "left").select("path", "digest", "license_id")


def page_blocks(pages: DataFrame) -> DataFrame:
    """`path, text` of every line of every page."""
    return page_texts(pages).select("path", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))


def page_licenses(pages: DataFrame, licenses: DataFrame) -> DataFrame:
    """`path, digest, license_id, block_licenses`: the licence of the entire page, and those of its lines.

    Each line is scanned as a text of its own. `block_licenses` are the distinct licences, sorted and
    joined by commas; empty without any. Pages of one path share them. See `scan_licenses` for nulls.
    """
    whole = scan_licenses(pages, licenses)
    lines = scan_licenses(page_blocks(pages), licenses).filter("license_id is not null")
    found = lines.groupBy(F.col("path").alias("of")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("block_licenses"))
    return whole.join(found, F.col("path").eqNullSafe(F.col("of")), "left").select("path", "digest", "license_id", F.coalesce("block_licenses", F.lit("")).alias("block_licenses"))
