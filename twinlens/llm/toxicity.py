"""Toxicity scores of captured pages: boosted trees over a dozen dense features, then isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.near_copies import page_shingles
from twinlens.llm.shared import keep, page_texts, schema
from twinlens.llm.words import CHUNK, alphanumeric, bounds, buffers, byte_values, hash_word, hashes, lookup, mix, powers, slices, spaced

SAMPLE_PAGES = 20_000
MOST_TERMS = 3_000
STEMS = (4, 5, 6, 7)
FEATURES = (
    "length", "word_share", "word_hits", "stem_share", "stem_hits", "weight", "hidden_hits", "second_person",
    "nearness", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated",
)

# Words that address the reader.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton",
    "ta", "vous", "votre", "ti", "usted", "ustedes", "vosotros", "tus",
)

# What stands for a letter in a disguised word, and what is put between letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FILLERS = "*.-_'~^,;:?\"()"


def _disguise_tables() -> tuple[np.ndarray, np.ndarray]:
    plain, stays = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    for seen, meant in DISGUISES.items():
        plain[ord(seen)] = ord(meant)
    stays[[ord(c) for c in FILLERS]] = False
    return plain, stays


def stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than `size` bytes, by place in `starts`, and the hash of their first `size` bytes."""
    at = np.flatnonzero(ends - starts > size)
    total = np.zeros(len(at), np.uint64)
    values = byte_values()
    for i in range(size):
        total += values[data[starts[at] + i]] * tables[0][i]
    return at, mix(total + np.full(1, size, np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its terms, once each: word hashes (stem 0) and hashes of word beginnings (their bytes)."""
    tables = powers(CHUNK + 1)
    for batch in batches:
        for part in slices(batch, size=1 << 20):
            data, at = buffers(part.column("text"))
            starts, ends, first = bounds(data, at, alphanumeric())
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            found = [(owner, hashes(data, starts, ends, tables), 0)]
            for size in STEMS:
                place, terms = stem_hashes(data, starts, ends, size, tables)
                found.append((owner[place], terms, size))
            weight, label = part.column("weight").to_numpy(), part.column("toxic").to_numpy()
            for owners, terms, size in found:
                once = np.unique(np.stack([terms.view(np.int64), owners]), axis=1) if len(terms) else np.zeros((2, 0), np.int64)
                values, group = np.unique(once[0], return_inverse=True)
                every = np.bincount(group, weight[once[1]], len(values))
                bad = np.bincount(group, (weight * label)[once[1]], len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), size, np.int32)), pa.array(every), pa.array(bad)], ["term", "stem", "pages", "toxic"])


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least shingle hash of each page; near copies mostly share it."""
    tables = powers(CHUNK + 1)
    for batch in batches:
        for part in slices(batch, size=2 << 20):
            shingles, _, begin = page_shingles(part.column("text"), tables)
            least = [int(shingles[i]) if j > i else 0 for i, j in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(np.array(least, np.uint64).view(np.int64))], ["text", "toxic", "family"])


def _features(shipped):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lexicon, (plain, stays) = powers(CHUNK + 1), shipped.value, _disguise_tables()
        address = np.sort(np.array([hash_word(w) for w in SECOND_PERSON], np.uint64))
        for batch in batches:
            for part in slices(batch, size=1 << 20):
                table = page_features(part.column("text"), lexicon, address, plain, stays, tables)
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(table[:, i]) for i in range(len(FEATURES)))], [*names, *FEATURES])

    return build


def page_features(column: pa.Array, lexicon: dict, address: np.ndarray, plain: np.ndarray, stays: np.ndarray, tables: tuple) -> np.ndarray:
    """One row of FEATURES per text. Every feature is finite for every text, the empty one included."""
    data, at = buffers(column)
    pages, size = len(at) - 1, np.maximum(1, np.diff(at))
    starts, ends, first = bounds(data, at, alphanumeric())
    n, owner = np.diff(first), np.repeat(np.arange(pages), np.diff(first))
    many = np.maximum(1, n)
    per = lambda mask: np.bincount(owner[mask], minlength=pages)
    terms = hashes(data, starts, ends, tables)
    word_place, is_bad = lookup(terms, lexicon["terms"][0])
    strength = np.where(is_bad, lexicon["weights"][0][word_place], 0.0) if len(lexicon["terms"][0]) else np.zeros(len(terms))
    is_stem = np.zeros(len(terms), bool)
    for stem in STEMS:
        place, found = stem_hashes(data, starts, ends, stem, tables)
        where, hit = lookup(found, lexicon["terms"][stem])
        is_stem[place[hit]] = True
        if hit.any():
            strength[place[hit]] = np.maximum(strength[place[hit]], lexicon["weights"][stem][where[hit]])
    bad, you = is_bad | is_stem, lookup(terms, address)[1]
    far = np.full(pages, np.inf)
    bad_at, you_at = np.flatnonzero(bad), np.flatnonzero(you)
    if len(bad_at) and len(you_at):
        nxt = np.searchsorted(you_at, bad_at)
        for side in (np.minimum(nxt, len(you_at) - 1), np.maximum(nxt - 1, 0)):
            same = owner[you_at[side]] == owner[bad_at]
            np.minimum.at(far, owner[bad_at[same]], np.abs(you_at[side] - bad_at)[same])
    above = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    upper = (data >= 0x41) & (data <= 0x5A)
    small = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    big_so_far = np.concatenate([[0], np.cumsum(upper)])
    shouted = (big_so_far[ends] - big_so_far[starts] == ends - starts) & (ends - starts > 2)
    mark = (data > 0x20) & (data < 0x7F) & ~upper & ~small & ~((data >= 0x30) & (data <= 0x39))
    # Words between spaces, with signs read as the letters they stand for.
    kept = stays[data]
    moved = np.concatenate([[0], np.cumsum(kept)])
    bare, bare_at = plain[data[kept]], moved[at]
    s, e, f = bounds(bare, bare_at, spaced())
    hidden = np.bincount(np.repeat(np.arange(pages), np.diff(f)), lookup(hashes(bare, s, e, tables), lexicon["terms"][0])[1], pages)
    # Words between spaces that mix letters with digits or signs inside.
    s, e, f = bounds(data, at, spaced())
    sign = np.concatenate([[0], np.cumsum(mark | ((data >= 0x30) & (data <= 0x39)))])
    letter = np.concatenate([[0], np.cumsum(upper | small)])
    inner = (e - s > 2) & (sign[np.maximum(e - 1, s)] - sign[np.minimum(s + 1, e)] > 0) & (letter[e] - letter[s] > 1)
    mixed = np.bincount(np.repeat(np.arange(pages), np.diff(f)), inner, pages)
    return np.column_stack([
        np.log1p(n), per(is_bad) / many, np.log1p(per(is_bad)), per(is_stem) / many, np.log1p(per(is_stem)),
        np.bincount(owner, strength, pages) / np.sqrt(many), np.log1p(np.maximum(0, hidden - per(is_bad))), per(you) / many, 1.0 / (1.0 + far), above(upper) / size,
        per(shouted) / many, above((data == 0x21) | (data == 0x3F)) / size, above(mark) / size, mixed / np.maximum(1, np.diff(f)),
    ])


def learn_lexicon(sample: DataFrame, most_terms: int = MOST_TERMS) -> dict:
    """Words, and beginnings of words, that mark toxic pages of `sample` (`text, toxic`), with their log odds.

    Near copies share one vote, so that a copied page does not teach its other words. A term needs one percent of the toxic
    votes and at least three, and log odds of 3. No more than `most_terms` are kept, the strongest.
    """
    families = keep(sample.mapInArrow(_family, schema(("text", "string"), ("toxic", "long"), ("family", "long"))))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    weighted = families.join(sizes, "family").select("text", "toxic", (1.0 / F.col("size")).alias("weight"))
    weighted = keep(weighted)
    size = weighted.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.col("weight") * F.col("toxic")), F.lit(0.0)).alias("bad")).first()
    votes = weighted.mapInArrow(_sample_terms, schema(("term", "long"), ("stem", "int"), ("pages", "double"), ("toxic", "double")))
    votes = votes.groupBy("term", "stem").agg(F.sum("pages").alias("pages"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (size["bad"] + 1.0)) - F.log((F.col("pages") - F.col("toxic") + 0.5) / (size["all"] - size["bad"] + 1.0))
    chosen = votes.withColumn("odds", odds).filter((F.col("toxic") >= max(2.5, 0.01 * size["bad"])) & (F.col("odds") >= 3.0))
    rows = chosen.orderBy(F.desc(F.col("odds") * F.col("toxic")), "term", "stem").limit(most_terms).toPandas()
    lexicon: dict = {"terms": {}, "weights": {}}
    for stem in (0, *STEMS):
        own = rows[rows["stem"] == stem]
        terms = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        lexicon["terms"][stem], lexicon["weights"][stem] = terms[order], own["odds"].to_numpy(float)[order]
    return lexicon


def score_toxicity(pages: DataFrame, labels: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = 15, depth: int = 4, threshold: float = 0.7) -> DataFrame:
    """`path, score, predicted` of every captured page; `score`, 0 to 1, is the calibrated chance of a toxic label.

    `pages` holds `path` and `text`; `labels` holds `path` and `toxic` (0 or 1) of pages to learn
    from, and nothing else is learnt from. The greatest label of a path counts; null labels and paths do not.
    At most `sample_pages` labelled paths, taken by hash, are learnt from; three quarters of them
    grow the trees, one quarter calibrates. The lexicon is learnt from the same pages.

    A null text counts as empty and gets the score of an empty text. With no label, or with one kind
    only, every score is the share of toxic labels, 0 without any. Repeated or null paths return a
    row each; an empty table returns none.
    """
    spark = pages.sparkSession
    texts = page_texts(pages)
    chosen = labels.filter("path is not null and toxic is not null").groupBy(F.col("path").alias("labelled")).agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = keep(chosen.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_pages))
    # The sample is bounded by its parameter, so it may be broadcast.
    sample = texts.join(F.broadcast(chosen), F.col("path") == F.col("labelled")).select("text", "toxic")
    sample = keep(sample.groupBy("text", "toxic").agg(F.count(F.lit(1)).alias("times")).select("text", "toxic"))
    shares = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return texts.select("path", F.lit(1.0 if shares.get(1) else 0.0).alias("score"), F.lit(int(bool(shares.get(1)))).alias("predicted"))
    calibrates = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    grown = sample.filter(~calibrates)
    shipped = spark.sparkContext.broadcast(learn_lexicon(grown))
    columns = [(n, "double") for n in FEATURES]
    known = sample.select("toxic", calibrates.alias("calibrates"), "text").mapInArrow(_features(shipped), schema(("toxic", "long"), ("calibrates", "boolean"), *columns))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    known = keep(known)
    vectors = assemble.transform(known).select(F.col("toxic").cast("double").alias("label"), "features", "calibrates")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=7).fit(vectors.filter("not calibrates"))
    chance = lambda df: df.withColumn("chance", vector_to_array("probability")[1])
    held = chance(trees.transform(vectors.filter("calibrates")))
    if held.select("label").distinct().count() < 2:
        held = chance(trees.transform(vectors))
    curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(held.select("chance", "label"))
    out = schema(("path", pages.schema["path"].dataType), *columns)
    scored = chance(trees.transform(assemble.transform(texts.mapInArrow(_features(shipped), out))))
    scored = curve.transform(scored.select("path", "chance"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated")))
    return scored.select("path", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
