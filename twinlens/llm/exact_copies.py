"""Exact copies among captured pages, found by exchanging Golomb-coded fingerprints.

Pages are cut into parts. A part sends each owner of a fingerprint range its sorted distinct
fingerprints, Golomb-coded. An owner answers every part with a bitmap: which of the fingerprints
that it sent stand in another part too. Only pages behind a set bit (or that repeat inside their
part) are suspects; only suspects' texts are shuffled, and equal bytes decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import keep, page_texts, schema


def golomb_encode(values: np.ndarray, low: int, span: int) -> tuple[bytes, int]:
    """Golomb-Rice codes of the gaps of sorted distinct values from `low` on, and their parameter.

    The unary quotients come first, then the remainders of k bits, so that both decode in bulk.
    """
    gaps = np.diff(values - np.uint64(low), prepend=np.uint64(0))
    k = int(np.log2(max(1.0, 0.69 * span / max(1, len(values)))))
    quotient, rest = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    unary = np.ones(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    places = np.arange(k - 1, -1, -1, dtype=np.uint64)
    tail = ((rest[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(tail.ravel()).tobytes(), k


def golomb_decode(code: bytes, count: int, k: int, low: int) -> np.ndarray:
    """The sorted values behind `golomb_encode`."""
    raw = np.frombuffer(code, np.uint8)
    tail_bytes = -(-count * k // 8)
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail_bytes]) == 0)[:count]
    quotient = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    tail = np.unpackbits(raw[len(raw) - tail_bytes :])[: count * k].reshape(count, k)
    rest = np.zeros(count, np.uint64)
    for place in range(k):
        rest = (rest << np.uint64(1)) | tail[:, place].astype(np.uint64)
    return np.cumsum((quotient << np.uint64(k)) | rest, dtype=np.uint64) + np.uint64(low)


def _ranges(owners: int) -> tuple[int, np.ndarray]:
    span = (1 << 64) // owners
    return span, np.arange(owners, dtype=np.uint64) * np.uint64(span)


def _send(owners: int):
    def send(part: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(part["fp"].to_numpy(np.int64).view(np.uint64))
        span, lows = _ranges(owners)
        owner = np.minimum(values // np.uint64(span), np.uint64(owners - 1)).astype(np.int64)
        edges, rows = np.searchsorted(owner, np.arange(owners + 1)), []
        for o in np.unique(owner):
            own = values[edges[o] : edges[o + 1]]
            code, k = golomb_encode(own, int(lows[o]), span)
            rows.append((int(o), int(part["part"].iat[0]), len(own), k, code))
        return pd.DataFrame(rows, columns=["owner", "part", "n", "k", "code"])

    return send


def _answer(owners: int):
    def answer(sent: pd.DataFrame) -> pd.DataFrame:
        low = int(_ranges(owners)[1][int(sent["owner"].iat[0])])
        parts = [golomb_decode(c, n, k, low) for c, n, k in zip(sent["code"], sent["n"], sent["k"], strict=True)]
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[times > 1]
        bitmaps = [np.packbits(np.isin(p, twice, assume_unique=True)).tobytes() for p in parts]
        return pd.DataFrame({"part": sent["part"], "owner": sent["owner"], "bitmap": bitmaps})

    return answer


def _suspect(owners: int):
    def suspect(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fps = part["fp"].to_numpy(np.int64).view(np.uint64)
        values, times = np.unique(fps, return_counts=True)
        span, _ = _ranges(owners)
        owner = np.minimum(values // np.uint64(span), np.uint64(owners - 1)).astype(np.int64)
        shared = times > 1
        edges = np.searchsorted(owner, np.arange(owners + 1))
        for o, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            n = edges[o + 1] - edges[o]
            shared[edges[o] : edges[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
        return pd.DataFrame({"fp": values[shared].view(np.int64)})

    return suspect


CHUNK_BITS = 1 << 15
MOST_CHUNKS = 1 << 12


def _bits(chunk: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(CHUNK_BITS, np.uint8)
    bits[chunk["place"].to_numpy() % CHUNK_BITS] = 1
    return pd.DataFrame({"chunk": [int(chunk["chunk"].iat[0])], "bits": [np.packbits(bits, bitorder="little").view(np.int64)]})


def suspected(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows of `texts` whose `fp` is a suspect's, and a few more, without a shuffle.

    Suspects mark bits of a map that has at most CHUNK_BITS * MOST_CHUNKS bits (16 MB), whatever their number, so it may
    be broadcast. A bit that two fingerprints share lets a page through that the comparison of texts then clears.
    """
    chunks = 1
    while chunks < MOST_CHUNKS and chunks * CHUNK_BITS < 64 * suspects.count():
        chunks *= 2
    place = F.pmod("fp", F.lit(chunks * CHUNK_BITS))
    placed = suspects.select(place.alias("place")).distinct().withColumn("chunk", F.floor(F.col("place") / CHUNK_BITS))
    maps = placed.groupBy("chunk").applyInPandas(_bits, schema(("chunk", "long"), ("bits", T.ArrayType(T.LongType()))))
    at = texts.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / CHUNK_BITS))
    inside = (F.col("place") % CHUNK_BITS).cast("int")
    word = F.get("bits", F.floor(inside / 64).cast("int"))
    return at.join(F.broadcast(maps), "chunk").filter(F.getbit(word, inside % 64) == 1).select(*texts.columns)


def exact_copies(pages: DataFrame, part_rows: int = 1 << 18, owner_rows: int = 1 << 20, least_owners: int = 8) -> DataFrame:
    """One row per captured page: which page of its group of identical texts stays.

    `pages` holds `path` (any orderable type) and `text`; other columns are ignored. Returns
    `path, keep_path, group_size, kept, text_sha256`: of pages with byte-identical text the one with
    the greatest path stays. A null text counts as empty, and all empty texts are one group. A null
    path sorts below every other; a group of null paths only keeps a null path. Rows that repeat
    path and text each return a row and count in `group_size`; `kept` holds for each row that bears
    the greatest path. An empty table returns no rows.

    `part_rows` bounds what one part holds and `owner_rows` what one owner holds on average
    (fingerprints only); both grow in number, not in size, with the table.
    """
    texts = page_texts(pages).withColumn("text", F.coalesce("text", F.lit("")))
    marked = keep(
        texts.select("path", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"),
                     F.shiftright(F.monotonically_increasing_id(), part_rows.bit_length() - 1).alias("part"))
    )
    owners = max(least_owners, -(-marked.count() // owner_rows))
    prints = marked.select("part", "path", "fp")
    sent = prints.select("part", "fp").groupBy("part").applyInPandas(_send(owners), schema(("owner", "long"), ("part", "long"), ("n", "long"), ("k", "long"), ("code", "binary")))
    answers = sent.groupBy("owner").applyInPandas(_answer(owners), schema(("part", "long"), ("owner", "long"), ("bitmap", "binary")))
    suspects = prints.select("part", "fp").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspect(owners), schema(("fp", "long")))
    held = suspected(texts.select(F.xxhash64("text").alias("fp"), "path", "text"), keep(suspects.distinct()))
    # Grouping by the whole text compares bytes; copies met in one task collapse before the shuffle.
    groups = held.groupBy("fp", "text").agg(F.max("path").alias("keep_path"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_path", "group_size").alias("g")
    alone = F.col("g.sha").isNull()
    keep_path = F.when(alone, F.col("m.path")).otherwise(F.col("g.keep_path"))
    return (
        marked.alias("m").join(groups, F.col("m.sha") == F.col("g.sha"), "left")
        .select(
            F.col("m.path").alias("path"), keep_path.alias("keep_path"), F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("m.path").eqNullSafe(keep_path).alias("kept"), F.lower(F.hex("m.sha")).alias("text_sha256"),
        )
    )
