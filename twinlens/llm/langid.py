"""The language of captured pages: known words first, shorter and shorter character grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import keep, page_texts, schema
from twinlens.llm.words import slices

SAMPLE_PAGES = 20_000
MOST_WORDS = 100_000
MOST_GRAMS = 100_000
LONGEST_GRAM = 4
CACHE_WORDS = 200_000
UNKNOWN = "und"


def _terms(longest: int):
    """Count the words of each language and, under the same roof, the grams of those words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import regex

        letters = regex.compile(r"\p{L}+")
        for batch in (part for whole in batches for part in slices(whole)):
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letters.findall((text or "").lower()))
            for lang, found in words.items():
                grams: Counter = Counter()
                for word, n in found.items():
                    for gram in word_grams(word, longest):
                        grams[gram] += n
                for kind, counts in (("word", found), ("gram", grams)):
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                        ["kind", "lang", "term", "n"],
                    )

    return count


def word_grams(word: str, longest: int) -> list[str]:
    """All runs of 1 to `longest` characters of a word between its edge marks."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in range(1, longest + 1) for i in range(len(marked) - n + 1)]


def learn_languages(
    pages: DataFrame, sample_pages: int = SAMPLE_PAGES, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS, longest: int = LONGEST_GRAM
) -> dict:
    """Log frequencies per language of words and of character grams.

    Learns from `text` and non-null `lang` of `pages`, from at most `sample_pages` of them, taken by a digest of the text.
    The model holds the `most_words` most frequent words and the `most_grams` most frequent grams of all languages
    together, which bounds what is broadcast. Without a labelled page the model knows no language.
    """
    labelled = pages.filter("lang is not null and text is not null").select("lang", "text")
    order = F.xxhash64("text", "lang")
    # Only digests are ranked; ties at the cut come along whole, so repeated texts can exceed the number a little.
    cut = labelled.select(order.alias("rank")).orderBy("rank").limit(sample_pages).agg(F.max("rank")).first()[0]
    if cut is None:
        return {"languages": [], "words": {}, "grams": {}, "scores": np.zeros((0, 0)), "longest": longest}
    sample = labelled.withColumn("rank", order).filter(F.col("rank") <= cut).dropDuplicates(["rank", "text", "lang"]).select("text", "lang")
    counted = sample.mapInArrow(_terms(longest), schema(("kind", "string"), ("lang", "string"), ("term", "string"), ("n", "long")))
    counted = keep(counted.groupBy("kind", "lang", "term").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    totals = {(r["kind"], r["lang"]): r["n"] for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    model: dict = {"languages": languages, "longest": longest}
    tables, before = [], 0
    for kind, most in (("word", most_words), ("gram", most_grams)):
        own = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"l{i}") for i, lang in enumerate(languages)]
        whole = counted.filter(F.col("kind") == kind).groupBy("term").agg(F.sum("n").alias("all"), *own)
        best = whole.orderBy(F.desc("all"), "term").limit(most).drop("all").toPandas()
        total = np.array([totals.get((kind, lang), 0) for lang in languages])
        tables.append(np.log((best.iloc[:, 1:].to_numpy(float) + 0.1) / (total + 0.1 * (len(best) + 1))))
        model[kind + "s"] = dict(zip(best["term"].tolist(), range(before, before + len(best)), strict=True))
        before += len(best)
    model["scores"] = np.concatenate(tables)
    return model


def word_scores(word: str, model: dict) -> np.ndarray:
    """Log frequency of a word per language: its own if it is known, else the mean of its longest known grams."""
    row = model["words"].get(word)
    if row is not None:
        return model["scores"][row]
    marked, grams = f"<{word}>", model["grams"]
    for n in range(model["longest"], 0, -1):
        rows = [r for r in (grams.get(marked[i : i + n]) for i in range(len(marked) - n + 1)) if r is not None]
        if rows:
            return model["scores"][rows].mean(0)
    return np.zeros(len(model["languages"]))


def _predict(shipped):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import regex

        letters, model = regex.compile(r"\p{L}+"), shipped.value
        place: dict[str, int] = {}
        table = np.zeros((1024, max(1, len(model["languages"]))))
        for batch in (part for whole in batches for part in slices(whole, size=2 << 20)):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = Counter(letters.findall((text or "").lower()))
                if not words or not model["languages"]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(place) > CACHE_WORDS:  # only speed depends on what is remembered
                    place.clear()
                at = []
                for word in words:
                    i = place.get(word)
                    if i is None:
                        i = place[word] = len(place)
                        if i >= len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[i, : len(model["languages"])] = word_scores(word, model)
                    at.append(i)
                total = np.fromiter(words.values(), float, len(words)) @ table[at]
                best = int(total.argmax())
                langs.append(model["languages"][best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return predict


def identify_languages(pages: DataFrame, model: dict) -> DataFrame:
    """`path, lang_pred, score` of every captured page, from the whole text alone.

    `pages` holds `path` and `text`; a `lang` column is not read. Words are runs of letters, lower-cased. `score` is the share of the
    best language in the likelihood of all, 0 to 1. A null text and one without a letter get `und` and 0, as does every
    page if the model knows no language. Equal likelihoods go to the language that sorts first. Repeated or null paths
    return a row each; an empty table returns none.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    out = schema(("path", pages.schema["path"].dataType), ("lang_pred", T.StringType()), ("score", "double"))
    return page_texts(pages).mapInArrow(_predict(shipped), out)
