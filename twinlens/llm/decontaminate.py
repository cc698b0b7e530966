"""Benchmark passages inside captured pages, found through a positional inverted index.

The index is distributed by shard: each shard of pages has one posting list per term, the ascending
positions of the term in the shard. Positions of two pages never follow each other, so a phrase
cannot run from one page into the next. A phrase is looked up by intersecting the lists of its
terms, each shifted back by the term's offset, from the rarest term on; most stop after two lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import keep, page_texts, schema
from twinlens.llm.words import CHUNK, alphanumeric, bounds, buffers, hashes, lookup, powers, slices

WINDOW = 13
ITEMS_AT_ONCE = 20_000


def _index(vocabulary) -> object:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tables, inside = TaskContext.get().partitionId() << 24, powers(CHUNK + 1), alphanumeric()
        wanted = None if vocabulary is None else vocabulary.value
        for batch in batches:
            for part in slices(batch, size=8 << 20):
                data, at = buffers(part.column("text"))
                starts, ends, first = bounds(data, at, inside)
                terms = hashes(data, starts, ends, tables)
                counts = np.diff(first)
                # One unused position after each page.
                begin = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
                place = np.arange(len(terms)) + np.repeat(np.arange(len(counts)), counts)
                if wanted is not None:
                    known = lookup(terms, wanted)[1]
                    terms, place = terms[known], place[known]
                order = np.argsort(terms, kind="stable")
                terms, place = terms[order], place[order]
                edge = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
                pages, lists = len(counts), len(edge)
                postings = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([np.zeros(pages, np.int32), edge.astype(np.int32), [np.int32(len(terms))]]).astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                )
                paths = part.column("path")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(pages + lists, shard, np.int64)),
                        pa.concat_arrays([paths, pa.nulls(lists, paths.type)]),
                        pa.array(np.concatenate([begin, np.zeros(lists, np.int64)]).astype(np.int32), mask=np.arange(pages + lists) >= pages),
                        pa.array(np.concatenate([counts, np.zeros(lists, np.int64)])),
                        pa.array(np.concatenate([np.zeros(pages, np.uint64), terms[edge]]).view(np.int64)),
                        postings,
                    ],
                    ["shard", "path", "begin", "n_words", "term", "positions"],
                )
                shard += 1

    return build


def build_index(pages: DataFrame, vocabulary=None) -> DataFrame:
    """Store the positional index of `pages` (`path`, `text`) and return it.

    A row with `begin` stands for a page: where its positions begin and how many words it has. A row
    without stands for a term: its ascending `positions` in the shard. Words are runs of ASCII
    letters, digits and non-ASCII characters, blind to the case of A-Z; terms are their 64-bit
    hashes. `vocabulary`, a broadcast array of sorted hashes, leaves out all other terms. A shard
    holds about 8 MB of text. A null text has no words.
    """
    kind = pages.schema["path"].dataType
    rows = schema(("shard", "long"), ("path", kind), ("begin", "int"), ("n_words", "long"), ("term", "long"), ("positions", T.ArrayType(T.IntegerType())))
    return keep(page_texts(pages).mapInArrow(_index(vocabulary), rows))


def item_terms(texts: list[str | None], tables: tuple) -> list[np.ndarray]:
    """The term hashes of each benchmark text, in order."""
    data, at = buffers(pa.array(texts, pa.large_string()))
    starts, ends, first = bounds(data, at, alphanumeric())
    return np.split(hashes(data, starts, ends, tables), first[1:-1])[: len(texts)]


def phrase_starts(window: np.ndarray, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Positions at which the terms of `window` follow each other."""
    lists = []
    for offset, term in enumerate(window.tolist()):
        found = postings.get(term)
        if found is None:
            return np.zeros(0, np.int64)
        lists.append((len(found), offset, found))
    lists.sort(key=lambda x: x[:2])
    starts = lists[0][2] - lists[0][1]
    for _, offset, found in lists[1:]:
        starts = starts[lookup(starts + offset, found)[1]]
        if not len(starts):
            break
    return starts


def near_spans(window: np.ndarray, postings: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Positions of the rarest term of `window` that has every other term within `width` words, either side."""
    terms = set(window.tolist())
    lists = sorted((postings.get(t, np.zeros(0, np.int64)) for t in terms), key=len)
    centre = lists[0]
    for found in lists[1:]:
        if not len(centre):
            break
        nxt = np.searchsorted(found, centre - width)
        centre = centre[(nxt < len(found)) & (found[np.minimum(nxt, max(0, len(found) - 1))] <= centre + width)] if len(found) else centre[:0]
    return centre


def _match(items, window: int, slack: int | None):
    def match(shard: pd.DataFrame) -> pd.DataFrame:
        is_page = shard["begin"].notna().to_numpy()
        begin = shard["begin"].to_numpy()[is_page].astype(np.int64)
        rows = np.argsort(begin, kind="stable")
        begin = begin[rows]
        lists = shard[~is_page]
        terms = lists["term"].to_numpy(np.int64).view(np.uint64).tolist()
        postings = dict(zip(terms, (np.asarray(x, np.int64) for x in lists["positions"]), strict=True))
        number, out = int(shard["shard"].iat[0]), []
        for item, words in items.value:
            wide = min(window, len(words))
            spans: list[tuple[int, int, str]] = []
            for i in range(len(words) - wide + 1) if wide else ():
                part = words[i : i + wide]
                spans += [(int(x), int(x) + wide, "exact") for x in phrase_starts(part, postings)]
                if slack is not None:
                    spans += [(int(x), int(x) + 1, "near") for x in near_spans(part, postings, wide + slack)]
            for kind in ("exact", "near"):
                last = -1
                for low, high in sorted(s[:2] for s in spans if s[2] == kind):
                    if low <= last:  # windows of one item that overlap are one span
                        out[-1][4] = max(out[-1][4], high)
                    else:
                        out.append([number, item, kind, low, high])
                    last = out[-1][4]
        found = pd.DataFrame(out, columns=["shard", "item_id", "kind", "low", "high"])
        if len(found):
            page = begin[np.searchsorted(begin, found["low"].to_numpy(), "right") - 1]
            found["begin"] = page
            found["low"] -= page
            found["high"] -= page
        else:
            found["begin"] = pd.Series([], dtype=np.int64)
        return found

    return match


def find_passages(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int | None = None, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """Where passages of benchmark items stand in the indexed pages.

    `items` holds `item_id` and `text`. Every `window` consecutive words of an item are a phrase; an
    item of fewer words, but not none, is one phrase. Returns `shard, begin, item_id, kind, low,
    high`: word `low` up to, not including, word `high` of the page that begins at `begin`. Kind
    `exact` joins the occurrences of phrases that overlap or touch. With `slack`, kind `near` gives
    each place of a phrase's rarest word around which all its words stand within the phrase's length
    plus `slack` words, in any order.

    Items are taken `at_once` in a block, so that what is broadcast is bounded; each block is looked
    up in all shards. A null item text has no phrase; a null item_id is kept as null.
    """
    spark = index.sparkSession
    numbered = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = numbered.count()
    blocks = max(1, -(-total // at_once))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    rows = schema(("shard", "long"), ("item_id", "string"), ("kind", "string"), ("low", "int"), ("high", "int"), ("begin", "int"))
    found = None
    for block in range(blocks):
        own = numbered.filter(F.col("block") == block).select("item_id", "text").distinct().toPandas()
        words = item_terms(own["text"].tolist(), powers(CHUNK + 1))
        shipped = spark.sparkContext.broadcast(list(zip(own["item_id"].tolist(), words, strict=True)))
        part = index.groupBy("shard").applyInPandas(_match(shipped, window, slack), rows)
        found = part if found is None else found.unionByName(part)
    return found


def vocabulary_of(items: DataFrame, most: int = 1_000_000):
    """A broadcast of the items' terms, or None if they could be more than `most` (then every term is indexed)."""
    sizes = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if sizes > 2 * most:  # a word and what parts it from the next take two bytes at least
        return None
    words = item_terms([r[0] for r in items.select("text").distinct().collect()], powers(CHUNK + 1))
    return items.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint64), *words])))


def decontaminate(pages: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """How much of every captured page stands in benchmark items.

    `pages` holds `path` and `text`, `items` holds `item_id` and `text`. A word of a page is hit if
    it lies in any occurrence of a phrase (see `find_passages`). Returns per page row `path, n_words,
    n_hit, n_items, items` (the distinct ids, sorted as strings) and `contaminated`: some word is hit
    and `share` times the hit words are all its words at least.

    A null or empty page has no words and is clean; a null item text has no phrase; repeated item
    rows count once; a null item_id hits words but is not counted in `n_items`. Repeated or null
    paths return a row each. Empty tables of either kind give clean pages or none.
    """
    index = build_index(pages, vocabulary_of(items))
    spans = keep(find_passages(index, items, window)).filter("kind = 'exact'")
    # Overlaps of different items count once; only hit words are spelt out.
    words = spans.select("shard", "begin", F.explode(F.sequence("low", F.col("high") - 1)).alias("word"))
    hit = words.groupBy("shard", "begin", "word").agg(F.lit(1).alias("one")).groupBy("shard", "begin").agg(F.count("word").alias("n_hit"))
    ids = spans.groupBy("shard", "begin").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = hit.join(ids, ["shard", "begin"])
    return (
        index.filter("begin is not null").select("shard", "begin", "path", "n_words").join(hits, ["shard", "begin"], "left")
        .select(
            "path", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )
