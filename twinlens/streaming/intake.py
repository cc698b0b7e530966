"""Streaming page intake: the batch rules, applied to each micro-batch and to what earlier ones have claimed.

A micro-batch is an ordinary table. Its offers and captures are first brought down to one row per key, with map-side
combine; only those meet the stored claims of earlier batches. No task holds the rows of a key, however hot it is. Each
batch writes its claims and its verdicts into folders of its own number, so a batch that is run again replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.operators.intake import decide_offers
from twinlens.session import child_names, cut_lineage, is_folder

SALTS = 32
COMPACT_EVERY = 20
DEPTHS_DDL = "side string, c_href string, depth int"
CLAIMS_DDL = "side string, kind string, key string, seq bigint, href string"
DECISIONS_DDL = "side string, c_href string, seq bigint, depth int, decision string"
CAPTURES_DDL = "side string, seq bigint, href string, final_href string, outcome string, alias_of string"

# Verdicts and new claims of a batch, given the batch and the claims of earlier ones.
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _earlier(spark: SparkSession, place: str, batch: int, ddl: str) -> DataFrame:
    """The claims of all batches before this one: the newest whole table, and the additions since.

    `whole/n` holds what batches before n have added.
    """
    wholes = [n for n in child_names(spark, f"{place}/whole") if n < batch]
    start = max(wholes, default=0)
    parts = [f"{place}/whole/{start}"] if wholes else []
    parts += [f"{place}/added/{n}" for n in child_names(spark, f"{place}/added") if start <= n < batch]
    return spark.read.schema(ddl).parquet(*parts) if parts else spark.createDataFrame([], ddl)


def run_batches(stream: DataFrame, step: Step, state_ddl: str, merge: Callable[[DataFrame], DataFrame], out_ddl: str, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, batch by batch, and return all verdicts so far.

    `out` and `checkpoint` are folders that all executors share. Every COMPACT_EVERY batches the claims so far are
    written as one table, so a batch reads few folders.
    """
    spark, claims = stream.sparkSession, f"{checkpoint}/claims"

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = cut_lineage(batch)
        known = _earlier(session, claims, number, state_ddl)
        if number and number % COMPACT_EVERY == 0:
            # Named for the batches before it: this batch's own additions come on top.
            merge(known).write.mode("overwrite").parquet(f"{claims}/whole/{number}")
        verdicts, added = step(rows, known)
        added.write.mode("overwrite").parquet(f"{claims}/added/{number}")
        verdicts.write.mode("overwrite").parquet(f"{out}/{number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    if not child_names(spark, out):
        return spark.createDataFrame([], out_ddl)
    return spark.read.schema(out_ddl).option("recursiveFileLookup", True).parquet(out)


def _decide(max_depth: int) -> Step:
    def step(offers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = ["side", "c_href"]
        mine = offers.groupBy(*keys).agg(F.min("depth").alias("depth"))
        best = known.join(mine.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("depth").alias("depth"))
        best = cut_lineage(best)
        # What an earlier batch saw stands as one offer before all of this batch's.
        first = F.lit(-(1 << 62)).cast("bigint")
        both = offers.select(*keys, "seq", "depth").unionByName(best.select(*keys, first.alias("seq"), "depth"))
        decided = decide_offers(both.withColumn("reject", F.lit(None).cast("string")), max_depth)
        added = mine.join(best.withColumnRenamed("depth", "before"), keys, "left").where(F.col("before").isNull() | (F.col("depth") < F.col("before"))).drop("before")
        return decided.where(F.col("seq") != first).select(*keys, "seq", "depth", "decision"), added

    return step


def decide_stream(offers: DataFrame, max_depth: int, out: str, checkpoint: str) -> DataFrame:
    """Streaming form of the batch decision over admitted offers `(side, c_href, seq, depth)`.

    Of each URL the least depth seen is kept: it also tells whether the URL has been queued.
    """
    least = lambda known: known.groupBy("side", "c_href").agg(F.min("depth").alias("depth"))
    return run_batches(offers, _decide(max_depth), DEPTHS_DDL, least, DECISIONS_DDL, out, checkpoint)


def _first_claims(known: DataFrame) -> DataFrame:
    return known.groupBy("side", "kind", "key").agg(F.min("seq").alias("seq"), F.min_by("href", "seq").alias("href"))


def _capture(captures: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who owns each content, each address that was asked for, and each address that others landed on."""
    keys = ["side", "kind", "key"]
    salted = captures.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    claim = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    landed = F.when(F.col("href") != F.col("final_href"), F.col("final_href"))
    claims = F.array(claim("content", F.col("content_hash")), claim("asked", F.col("href")), claim("landed", landed), claim("wanted", landed))
    made = salted.select("side", "seq", "href", "salt", F.explode(claims).alias("c")).select("side", "c.*", "seq", "href", "salt").where(F.col("key").isNotNull())
    # A landing asks who asked for its address; such questions claim nothing.
    asks = made.withColumn("real", F.col("kind") != "wanted").withColumn("kind", F.when(F.col("kind") == "wanted", F.lit("asked")).otherwise(F.col("kind")))
    seq, href = F.when(F.col("real"), F.col("seq")), F.when(F.col("real"), F.col("href"))
    mine = cut_lineage(asks.groupBy(*keys).agg(F.min(seq).alias("seq"), F.min_by(href, seq).alias("href"), F.collect_set("salt").alias("salts")))
    before = cut_lineage(_first_claims(known.join(mine.select(*keys), keys, "left_semi")))
    # An earlier batch's claim comes before all of this one's.
    merged = mine.join(before.select(*keys, F.lit(True).alias("_old"), F.col("href").alias("_href")), keys, "left")
    owner = merged.select(
        *keys, F.when(F.col("_old"), F.lit(-(1 << 62))).otherwise(F.col("seq")).cast("bigint").alias("at"), F.coalesce("_href", "href").alias("owner"), F.explode("salts").alias("salt")
    )
    owner = cut_lineage(owner)

    def look_up(rows: DataFrame, kind: str, key: str) -> DataFrame:
        """Add the owner of a key; the salt deals the rows of a hot key to many tasks."""
        found = owner.where(F.col("kind") == kind).select("side", F.col("key").alias(key), "salt", F.struct("at", "owner").alias(kind))
        return rows.join(found, ["side", key, "salt"], "left")

    rows = look_up(salted.withColumn("landed_href", landed), "content", "content_hash")
    rows = look_up(look_up(rows, "landed", "landed_href"), "asked", "landed_href")
    taken = F.coalesce(F.col("asked.at") < F.col("seq"), F.lit(False)) | F.coalesce(F.col("landed.at") < F.col("seq"), F.lit(False))
    outcome = F.when(F.col("landed_href").isNotNull(), F.when(taken, F.lit("alias")).otherwise(F.lit("claims")))
    alias_of = F.when(F.col("href") != F.col("content.owner"), F.col("content.owner"))
    verdicts = rows.select("side", "seq", "href", "final_href", outcome.alias("outcome"), alias_of.alias("alias_of"))
    added = mine.where(F.col("seq").isNotNull()).join(before.select(*keys), keys, "left_anti").drop("salts")
    return verdicts, added


def capture_stream(captures: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Streaming form of redirect and content aliases over `(side, seq, href, final_href, content_hash)`.

    Returns each capture with `outcome` (of a page that landed elsewhere: `claims` the address, or is an `alias` of the
    page that asked for it or landed on it before) and `alias_of` (the page that showed the same content first). Captures
    of one batch are ordered by `seq`, batches by arrival. A null final address is no redirect, a null hash no alias.
    """
    return run_batches(captures, _capture, CLAIMS_DDL, _first_claims, CAPTURES_DDL, out, checkpoint)


def pages_as_captures(spark: SparkSession, sf_dir: str, schema: T.StructType) -> DataFrame:
    """Pages of a folder as a stream of captures: the URL, its arrival and the hash of its content."""
    place = f"{sf_dir}/pages.parquet"
    reader = spark.readStream.schema(schema)
    pages = reader.parquet(place) if is_folder(spark, place) else reader.option("pathGlobFilter", "pages.parquet").parquet(sf_dir)
    return pages.select(
        F.lit("source").alias("side"), F.col("page_id").alias("seq"), F.col("url").alias("href"), F.col("url").alias("final_href"), F.sha1("html").alias("content_hash")
    )
