"""Token counts of captured pages with a stored digest cache.

A count depends on the content and on the tokenizer alone, so it is stored under the digests of
both. Pages whose digests are in the cache only join it; of the rest each distinct text is encoded
once and appended. Where a tokenizer cuts at white space, a task encodes each distinct word once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from twinlens.llm.shared import keep, page_texts, schema
from twinlens.llm.words import slices

CACHE_WORDS = 500_000
# Fixed value: a splitting pattern of public tokenizers whose matches hold no white space.
SPACELESS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
CACHE = schema(("content", "binary"), ("tokenizer", "binary"), ("n_tokens", "long"))


def tokenizer_digest(model: bytes, kind: str) -> bytes:
    """One digest for the tokenizer file and the version of the library that runs it."""
    library = "sentencepiece" if kind == "model" else "tokenizers"
    return hashlib.sha256(hashlib.sha256(model).digest() + f"{library} {version(library)}".encode()).digest()


def counts_by_word(model: bytes) -> bool:
    """Whether a tokenizers file drops white space and cuts at it, so that a text's count is the sum of its words' counts.

    True only for the shape that is known to: no normaliser but NFC, small letters and white space to one space; a
    splitting pattern that keeps only matches, none of which can hold a space; added tokens without spaces.
    """
    parts = json.loads(model)
    normaliser, splitter = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    for step in normaliser.get("normalizers", [normaliser]):
        spaces = step.get("type") == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "
        if not spaces and step.get("type") not in ("NFC", "Lowercase"):
            return False
    first = splitter.get("pretokenizers", [splitter])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or pattern not in SPACELESS:
        return False
    return all(" " not in t["content"] and "\n" not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in parts.get("added_tokens", []))


def _counter(model: bytes, kind: str, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "model":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
            lengths = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(model.decode())
            whole.no_truncation()
            whole.no_padding()
            lengths = lambda texts: [len(x.ids) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
        apart, known = kind == "json" and counts_by_word(model), {}
        for batch in (part for whole in batches for part in slices(whole, size=4 << 20)):
            counts: list[int] = []
            if apart:
                words = [t.replace("\n", " ").split(" ") for t in batch.column("text").to_pylist()]
                if len(known) > CACHE_WORDS:  # only speed depends on what is remembered
                    known = {}
                new = list(set().union(*words).difference(known))
                for begin in range(0, len(new), 10_000):
                    known.update(zip(new[begin : begin + 10_000], lengths(new[begin : begin + 10_000]), strict=True))
                counts = [sum(map(known.__getitem__, w)) for w in words]
            else:
                for begin in range(0, batch.num_rows, at_once):
                    counts += lengths(batch.column("text").slice(begin, at_once).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return count


def read_cache(df: DataFrame, cache: str) -> DataFrame | None:
    """The stored counts, or None before the first append."""
    try:
        return df.sparkSession.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def as_it_is(text: Column) -> Column:
    """The content that is counted: the text itself, a null as an empty one."""
    return F.coalesce(text, F.lit(""))


def token_counts(pages: DataFrame, tokenizer: str, cache: str, limit: int = 2048, normalise: Callable[[Column], Column] = as_it_is, at_once: int = 64) -> DataFrame:
    """Tokens of every captured page: `path, n_bytes, n_tokens, over_limit`.

    `pages` holds `path` and `text`. `tokenizer` is a `.json` file of the tokenizers library or a
    sentencepiece `.model`, read on the driver and shipped to the tasks. `cache` is a folder that
    all executors reach; it may not exist yet. `normalise` must be a change that no tokenizer in
    use can see; the default changes nothing. Begin and end tokens are not added; a special string
    inside a text is treated as the library does by default; nothing is truncated or padded.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated paths return a row each. An
    empty table returns no rows and appends nothing that a later run could miss.
    """
    model, kind = Path(tokenizer).read_bytes(), tokenizer.rpartition(".")[2]
    own = F.lit(bytearray(tokenizer_digest(model, kind)))
    texts = page_texts(pages).withColumn("text", normalise(F.col("text")))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    # Grouping by digest and text drops copies inside each task before the shuffle.
    distinct = texts.select("content", "text").groupBy("content", "text").agg(F.lit(1).alias("one")).select("content", "text")
    stored = read_cache(pages, cache)
    if stored is not None:
        distinct = distinct.join(stored.filter(F.col("tokenizer") == own).select("content"), "content", "left_anti")
    fresh = distinct.mapInArrow(_counter(model, kind, at_once), schema(("content", "binary"), ("n_tokens", "long")))
    fresh.select("content", own.alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = pages.sparkSession.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == own)
    # Two runs that miss the same text at once may both append it.
    counts = keep(counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return (
        texts.select("path", "content", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "content", "left")
        .select("path", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
