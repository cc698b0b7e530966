"""A corpus pipeline over `documents`: language, exact copies, near copies, benchmark passages, pieces.

Each stage takes all that its predecessor kept. The first four drop whole documents and return the
columns of `documents`; the last returns each remaining document's piece ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.decontaminate import decontaminate
from twinlens.llm.exact_copies import exact_copies
from twinlens.llm.langid import UNKNOWN, identify_languages, learn_languages
from twinlens.llm.near_copies import near_copies
from twinlens.llm.pieces import encode_pages
from twinlens.llm.shared import keep


def _digest() -> Column:
    """128 bits of the text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _pages(docs: DataFrame) -> DataFrame:
    """Pages whose path is a document's id and digest: rows of one id, or of none, are told apart by their texts."""
    return docs.select(F.struct("doc_id", _digest().alias("digest")).alias("path"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` without the rows whose id and text are in `dropped` (`path` as in `_pages`); a null id is an id like any other."""
    gone = dropped.select(F.col("path.doc_id").alias("dropped_id"), F.col("path.digest").alias("dropped_digest")).alias("gone")
    kept = docs.withColumn(_free("digest", docs), _digest()).alias("kept")
    same = F.col("kept.doc_id").eqNullSafe(F.col("gone.dropped_id")) & (F.col(f"kept.{_free('digest', docs)}") == F.col("gone.dropped_digest"))
    return kept.join(gone, same, "left_anti").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined: text that is null or has no letter.

    A corpus without a label teaches no language and loses such documents only. An empty table stays empty, and further
    columns, whatever their names, are returned as they are; so in all stages but the last.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = learn_languages(docs.filter(~held_out).select("text", "lang"))
    if not model["languages"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return _without(docs, identify_languages(_pages(docs), model).filter(F.col("lang_pred") == UNKNOWN))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical text keep the one with the greatest id, one row of it."""
    copies = keep(exact_copies(_pages(docs)))
    left = _without(docs, copies.filter(~F.col("kept")))
    repeated = copies.filter("kept").groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    digest = _free("digest", left)
    return left if repeated.isEmpty() else left.withColumn(digest, _digest()).dropDuplicates(["doc_id", digest]).drop(digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the least id; of those the one with the least digest."""
    return _without(docs, near_copies(_pages(docs)).filter(~F.col("kept")))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more stands in benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, decontaminate(_pages(docs), items).filter("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, n_pieces, ids` of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        encoded = encode_pages(docs.select(F.col("doc_id").alias("path"), "text"), file.read())
    return encoded.select(F.col("path").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language", drop_unknown_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("pieces", encode),
]

# Near-copy groups and pieces are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
