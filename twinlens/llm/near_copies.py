"""Near copies among captured pages: ProbMinHash signatures, banding, verification, groups.

A page is a weighted set of word shingles; the weight is how often the shingle stands in the page.
Each shingle is a Poisson process whose rate is its weight: it arrives at random registers at
exponential distances, and each register keeps the shingle that arrives there first. Two pages agree
in a register with their probability Jaccard similarity. A shingle stops arriving once it is later
than every register of its page (early termination).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import few_rows_at_once, keep, page_texts, schema
from twinlens.llm.words import CHUNK, alphanumeric, buffers, join_hash, mix, powers, slices, words_of

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 192
BANDS = 64
ROWS = 8
CHUNK_IDS = 128
# A pair goes on to its texts if so much less than the wanted similarity of its registers agree: four deviations.
MARGIN = 0.12
MOST_IDS = 1_000_000


def page_shingles(column: pa.Array, tables: tuple, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: their hashes in ascending order per text, counts, and where each text begins.

    A text of fewer words than `width`, but not none, is one shingle.
    """
    words, first = words_of(column, alphanumeric(), tables)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), np.where(counts >= width, counts - width + 1, np.minimum(counts, 1)))
    begin = np.concatenate([[0], np.cumsum(np.where(counts >= width, counts - width + 1, np.minimum(counts, 1)))])
    at = first[owner] + (np.arange(len(owner)) - begin[owner])
    length = np.minimum(counts[owner], width)
    shingles = mix(length.astype(np.uint64))
    for i in range(width):
        inside = i < length
        shingles[inside] = join_hash(shingles[inside], words[at[inside] + i])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    edge = np.flatnonzero(new)
    times = np.diff(np.append(edge, len(owner)))
    return shingles[edge], times, np.searchsorted(owner[edge], np.arange(len(counts) + 1))


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, begin: np.ndarray, registers: int) -> np.ndarray:
    """One signature row per text; texts without shingles get zeros.

    Register j of a text holds the hash of the shingle whose process first arrives at j.
    """
    texts = len(begin) - 1
    arrival = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(begin))
    state, time, rate, value = shingles.copy(), np.zeros(len(shingles)), 1.0 / weights, shingles
    while len(value):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        slot = owner * registers + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        # Of arrivals in one round at one register the earliest counts; ties fall to the smaller hash.
        late = np.flatnonzero(time < arrival[slot])
        if len(late):
            order = late[np.lexsort((value[late], time[late], slot[late]))]
            kept = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])]
            arrival[slot[kept]], holder[slot[kept]] = time[kept], value[kept]
        alive = time < arrival.reshape(texts, registers).max(1)[owner]
        state, time, rate, value, owner = state[alive], time[alive], rate[alive], value[alive], owner[alive]
    return holder.reshape(texts, registers)


def band_registers(registers: int, bands: int, rows: int) -> np.ndarray:
    """The registers of each band: shuffles of all registers, each cut into bands."""
    made = np.random.default_rng(20)
    each = registers // rows
    shuffles = [made.permutation(registers)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))]
    return np.concatenate(shuffles)[:bands]


def _sign(registers: int, bands: int, rows: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, chosen = powers(CHUNK + 1), band_registers(registers, bands, rows)
        for batch in batches:
            for part in slices(batch, size=2 << 20):
                # Copies inside the slice are signed once.
                ids = np.array(part.column("id").to_pylist(), object)
                part = part.take(pa.array(np.sort(np.unique(ids, return_index=True)[1])))
                shingles, times, begin = page_shingles(part.column("text"), tables, width)
                full = np.diff(begin) > 0
                signature = prob_min_hash(shingles, times, begin, registers)[full]
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands))
                for r in range(rows):
                    keys = join_hash(keys, signature[:, chosen[:, r]])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                short = pa.array([row.tobytes() for row in (signature & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(full)), listed, short], ["id", "keys", "registers"])

    return sign


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared shingles of 1 / sum over all shingles of the greater weight ratio; equal weights give plain Jaccard."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # For shared shingle d: sum of max(wa/x_d, wb/y_d) over shared ones, plus what only one side has.
    ratio, times = np.unique(x / y, return_inverse=True)
    sx, sy = np.bincount(times, x, len(ratio)), np.bincount(times, y, len(ratio))
    # max(x_e/x_d, y_e/y_d) is x_e/x_d exactly where x_e/y_e >= x_d/y_d.
    over, under = np.cumsum(sx[::-1])[::-1], np.concatenate([[0.0], np.cumsum(sy)[:-1]])
    total = (over[times] + only_a) / x + (under[times] + only_b) / y
    return float((1.0 / total).sum())


def _verify(similarity: float, width: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers(CHUNK + 1)
        for batch in batches:
            for part in slices(batch, "text_a", 2 << 20):
                a, wa, at_a = page_shingles(part.column("text_a"), tables, width)
                b, wb, at_b = page_shingles(part.column("text_b"), tables, width)
                good = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
                    good[i] = probability_jaccard(a[x], wa[x], b[y], wb[y]) >= similarity - 1e-12
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])

    return verify


def fetch(ids: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """`id, text` of the wanted ids, one row each. The list of ids is broadcast up to MOST_IDS and joined by shuffle beyond."""
    wanted = keep(ids.distinct().join(classes, "id").select("id", "class_path"))
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
    wanted = wanted.select(F.col("id").alias("wanted_id"), "class_path")
    same = (F.col("id") == F.col("wanted_id")) & F.col("path").eqNullSafe(F.col("class_path"))
    return keep(texts.join(wanted, same, "left_semi").groupBy("id", "text").agg(F.lit(1).alias("one")).select("id", "text"))


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (`a`, `b`) of text ids whose probability Jaccard similarity is `similarity` or more."""
    fetched = fetch(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts, classes)
    left = fetched.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = fetched.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify(similarity, width), schema(("a", "binary"), ("b", "binary")))


def components(links: DataFrame) -> DataFrame:
    """`id, group` of every linked node: the least id that links (`a`, `b`) connect it with.

    Each round gives a node the least label next to it, tells the tree of its old label, and jumps to its label's own
    label. Labels are stored after each round; rounds grow with the logarithm of the longest chain, and no group is held
    in one place.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("group")))
    while True:
        offered = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("group").alias("offer"))
        nearest = keep(labels.join(offered, F.col("id") == F.col("a")).select("id", F.col("group").alias("old"), F.least("group", "offer").alias("near")))
        lower = nearest.filter("near < old").groupBy("old").agg(F.min("near").alias("lower")).withColumnRenamed("old", "root")
        told = nearest.join(lower, F.col("old") == F.col("root"), "left").select("id", "old", F.least("near", F.coalesce("lower", "near")).alias("group"))
        told = keep(told)
        jump = told.select(F.col("id").alias("via"), F.col("group").alias("further"))
        after = keep(told.join(jump, F.col("group") == F.col("via"), "left").select("id", "old", F.coalesce("further", "group").alias("group")))
        labels = after.select("id", "group")
        if after.filter("group <> old").isEmpty():
            return labels


def near_copies(
    pages: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, registers: int = REGISTERS, bands: int = BANDS, rows: int = ROWS,
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """One row per captured page with the group of near copies that it belongs to.

    `pages` holds `path` (any orderable type) and `text`. Words are runs of ASCII letters, digits and
    non-ASCII characters, blind to the case of A-Z; a text of fewer than `width` words, but not none,
    is one shingle. Two texts are linked if the probability Jaccard similarity of their shingles,
    weighted by occurrence, is `similarity` or more; groups are what links connect. Returns `path,
    class_path` (least path with the same text), `group_path` (least path of the group), `n_links`
    (links found and verified from the page's text to other texts; enough to connect the group, not
    all of its pairs) and `kept` (the page's path is the group's least).

    Banding (64 bands of 8 out of 192 registers by default) misses a pair of similarity 0.8 with a
    chance of 1 in 3,000 and one of 0.85 with 1 in 300,000; nothing else is lost. In each bucket of
    a band, every text is first verified against two others, one of them the text that shares most
    buckets with most texts. Texts of a bucket that are still in different groups are then compared
    with each other by their registers, in blocks of `chunk_ids`, and those that come near by their texts.

    A null text counts as empty; a wordless text is linked to none, and such texts are a group only
    if equal. Null paths sort below every other. Repeated rows return a row each. An empty table
    returns no rows.
    """
    texts = page_texts(pages).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    keyed = keep(texts.select("path", "id"))
    classes = keep(keyed.groupBy("id").agg(_least("path").alias("class_path")))
    signed = texts.select("id", "text").mapInArrow(
        _sign(registers, bands, rows, width), schema(("id", "binary"), ("keys", T.ArrayType(T.LongType())), ("registers", "binary"))
    )
    signed = keep(signed.dropDuplicates(["id"]))
    banded = signed.select("id", F.explode("keys").alias("key"))
    members = keep(banded.join(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    central = members.join(members.groupBy("id").agg(F.sum("n").alias("shared")), "id")
    ends = central.groupBy("key").agg(F.max_by("id", F.struct("shared", "id")).alias("centre"), F.min("id").alias("least"))
    star = members.join(ends, "key").select(F.explode(F.array("centre", "least")).alias("a"), F.col("id").alias("b")).filter("a <> b")
    star = keep(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = keep(verified(star, texts, classes, similarity, width))
    links = links.unionByName(_links_between_groups(members, components(links), signed, texts, classes, similarity, width, chunk_ids))
    links = keep(links.distinct())
    groups = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    labelled = keep(classes.join(groups, "id", "left").join(degree, "id", "left").select("id", "class_path", F.coalesce("group", "id").alias("group"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    least = labelled.groupBy("group").agg(_least("class_path").alias("group_path"))
    named = keep(labelled.join(least, "group").select("id", "class_path", "group_path", "n_links"))
    return (
        keyed.join(named, "id")
        .select("path", "class_path", "group_path", "n_links", F.col("path").eqNullSafe(F.col("group_path")).alias("kept"))
    )


def _least(name: str) -> Column:
    """The least value of a column; a null is below every other."""
    return F.when(~F.max(F.col(name).isNull()), F.min(name))


def _alike(similarity: float, width: int):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers(CHUNK + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                key, same = batch.column("key")[row].as_py(), batch.column("same")[row].as_py()
                x = _block(batch.column("left")[row].values)
                y = x if same else _block(batch.column("right")[row].values)
                found: tuple[list, list] = ([], [])
                for i in range(len(x["id"])):
                    j = np.flatnonzero((y["sign"] == x["sign"][i]).mean(1) >= similarity - MARGIN)
                    j = j[(y["group"][j] != x["group"][i]) & (j > i if same else True)]
                    # Texts that share more buckets are compared in the first of them.
                    j = j[x["keys"][i][(y["keys"][j] == x["keys"][i]).argmax(1)] == key]
                    for other in j:
                        if probability_jaccard(*_shingles_of(x, i, tables, width), *_shingles_of(y, other, tables, width)) >= similarity - 1e-12:
                            found[0].append(min(x["id"][i], y["id"][other]))
                            found[1].append(max(x["id"][i], y["id"][other]))
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], ["a", "b"])

    return alike


def _block(items: pa.StructArray) -> dict:
    n = len(items)
    return {
        "id": items.field("id").to_pylist(), "group": np.array(items.field("group").to_pylist(), object), "text": items.field("text"), "shingles": {},
        "sign": np.frombuffer(b"".join(items.field("registers").to_pylist()), np.uint8).reshape(n, -1),
        "keys": items.field("keys").flatten().to_numpy().reshape(n, -1),
    }


def _shingles_of(block: dict, i: int, tables: tuple, width: int) -> tuple[np.ndarray, np.ndarray]:
    if i not in block["shingles"]:
        block["shingles"][i] = page_shingles(block["text"].slice(i, 1), tables, width)[:2]
    return block["shingles"][i]


def _links_between_groups(
    members: DataFrame, groups: DataFrame, signed: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float, width: int, chunk_ids: int
) -> DataFrame:
    """Links of texts that share a bucket but are in different groups so far.

    A bucket is cut into blocks of about `chunk_ids` texts. A row holds two blocks of one bucket, so
    no task holds a bucket; pairs are compared by registers and, if those come near, by texts inside
    the row, and only links leave it.
    """
    placed = members.select("id", "key", "n").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    placed = keep(_mixed(keep(placed), "key"))
    whole = fetch(placed.select("id"), texts, classes).join(signed, "id")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk_ids)).cast("int")
    item = F.struct("id", "group", "text", "keys", "registers")
    blocks = keep(placed.join(whole, "id").groupBy("key", chunk.alias("chunk")).agg(F.collect_list(item).alias("block")))
    left = blocks.select("key", F.col("chunk").alias("i"), F.col("block").alias("left"))
    right = blocks.select("key", F.col("chunk").alias("j"), F.col("block").alias("right"))
    both = left.join(right, "key").filter("i <= j").select("key", "left", F.when(F.col("i") < F.col("j"), F.col("right")).alias("right"), (F.col("i") == F.col("j")).alias("same"))
    with few_rows_at_once(members.sparkSession, 4):
        return keep(both.mapInArrow(_alike(similarity, width), schema(("a", "binary"), ("b", "binary"))).distinct())


def _mixed(placed: DataFrame, *cell: str) -> DataFrame:
    """The rows whose cell holds more than one group."""
    many = placed.groupBy(*cell).agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select(*cell)
    return placed.join(many, list(cell))
