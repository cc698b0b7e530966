"""Language-model scores of captured pages from a probabilistic suffix tree.

Symbols are words, and one end after each page. The root predicts from smoothed word counts over all
training pages. A longer context is a state of the tree if it repeats and its next-symbol
distribution diverges from that of its longest shorter state; a page is scored by the longest state
that ends at each of its symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.shared import blocks_for, keep, schema, shuffles_end_with_their_action
from twinlens.llm.words import BASE, CHUNK, join_hash, lookup, mix, powers, slices, spaced, words_of

LEAST = 2.0
DEPTH = 3
DISCOUNT = 0.5
GAIN = 1.0
BLOCK_BYTES = 16 << 20
HELD_TOKENS = 1 << 21
BUCKET_TOKENS = 1 << 20
HOT_TOKENS = 1 << 18
OWNER_KEYS = 1 << 20
MOST_BITS = 27
COUNT, OWN, LEFT, CHANCE = 0, 1, 2, 3
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)
SENT = schema(("bucket", "long"), ("rows", "long"), ("tokens", "long"), ("names", "binary"), ("grams", "binary"))
ASKED = schema(("bucket", "long"), ("key", "long"))
LEARNT = schema(("d", "byte"), ("kind", "byte"), ("key", "long"), ("value", "double"), ("times", "long"))
MARKS = schema(("owner", "long"), ("bits", "binary"))
REQUESTS = schema(("block", "long"), ("owner", "long"), ("keys", "long"), ("code", "binary"))
ANSWERS = schema(("owner", "long"), ("keys", "long"), ("code", "binary"), ("kind", "binary"), ("value", "binary"), ("times", "binary"))
REPLIES = schema(("block", "long"), ("owner", "long"), ("there", "binary"), ("values", "binary"))


def squeeze(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(code: bytes, count: int, kind: type) -> np.ndarray:
    """The numbers behind `squeeze`."""
    size = np.dtype(kind).itemsize
    raw = pa.decompress(code, decompressed_size=count * size, codec="zstd", asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).view(kind).ravel()


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort beats hashing where few repeat."""
    values = np.sort(values)
    return values[np.diff(values, prepend=~values[:1]) != 0]


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the values, and where in it each distinct value begins."""
    order = np.argsort(values)
    ranked = values[order]
    return order, np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))


def find(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `lookup`, for many keys among many: they are sorted first, so that neighbours are looked up together."""
    order = np.argsort(keys)
    place, there = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    place[order], there[order] = lookup(keys[order], sorted_keys)
    return place, there


def page_tokens(column: pa.Array, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all pages, each page's words and then its end, and where each page begins."""
    words, first = words_of(column, spaced(), tables)
    pages = len(first) - 1
    begin = first + np.arange(pages + 1)
    tokens = np.full(len(words) + pages, END, np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(pages), np.diff(first))] = words
    return tokens, begin


def contexts(tokens: np.ndarray, begin: np.ndarray, depth: int) -> list[np.ndarray]:
    """For 1 to `depth`, the hash of the tokens before each token. The start of a page counts as one token; a context that would reach beyond it is 0."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begin[:-1]] = START
    found, reach = [before], np.arange(len(tokens)) - np.repeat(begin[:-1], np.diff(begin))
    for d in range(2, depth + 1):
        longer = np.zeros_like(tokens)
        # The context of d tokens ends with the last one, and the rest ends one token earlier.
        ok = np.flatnonzero(reach >= d - 1)
        longer[ok] = join_hash(found[-1][ok - 1], before[ok])
        found.append(longer)
    return found


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The tokens of pages, so many at once that what repeats is worth counting before it is sent."""
    tables, held, size = powers(CHUNK + 1), [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(page_tokens(part.column("text"), tables))
            size += len(held[-1][0])
            if size >= HELD_TOKENS:
                yield held
                held, size = [], 0
    if size:
        yield held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _held(batches):
        values, times = np.unique(np.concatenate([tokens for tokens, _ in held]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], ["token", "n"])


def grams(tokens: np.ndarray, begin: np.ndarray, depth: int, shipped) -> Iterator[tuple[np.ndarray, ...]]:
    """For 1 to `depth`: the tokens whose context may be a state, those contexts, context and token together, and which of these may be listed."""
    for context in contexts(tokens, begin, depth):
        # Only a state has next symbols.
        at = np.flatnonzero(_marked(context, shipped[0]) & (context != 0)).astype(np.int32)
        context = context[at]
        key = join_hash(context, tokens[at])
        yield at, context, key, np.flatnonzero(_marked(key, shipped[1])).astype(np.int32)


def _own_bits(bits: int, owner_bits: int):
    def own_bits(owner: int, keys: np.ndarray) -> pd.DataFrame:
        marks = np.zeros(1 << (bits - owner_bits), np.uint8)
        marks[(keys >> np.uint64(64 - bits)).astype(np.int64) - (owner << (bits - owner_bits))] = 1
        return pd.DataFrame({"owner": [owner], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    return own_bits


def _gathered(rows: DataFrame, bits: int, owner_bits: int):
    """A broadcast of the bit map that owners have marked in parts, and of its number of bits."""
    width = 1 << (bits - owner_bits - 3)
    whole = np.zeros(width << owner_bits, np.uint8)
    for owner, part in rows.collect():
        whole[owner * width : (owner + 1) * width] = np.frombuffer(part, np.uint8)
    return rows.sparkSession.sparkContext.broadcast((whole, bits))


def _marked(keys: np.ndarray, shipped) -> np.ndarray:
    whole, bits = shipped.value
    place = keys >> np.uint64(64 - bits)
    return ((whole[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _map_bits(items: int) -> int:
    """Bits of a map as a power of two: about eight an item, and 16 MB at most."""
    return min(MOST_BITS, max(16, (8 * items).bit_length()))


def _steps_back(tokens: np.ndarray, begin: np.ndarray, depth: int, start: int, none: int, seen: np.ndarray) -> list[np.ndarray]:
    """Numbers of each token, and of the 1st to `depth`-th one before it: `start` at the start of its page, `none` beyond.

    A token that is not `seen` twice in all texts is `none` too, and so is what stands before it: nothing with it repeats.
    """
    reach = np.arange(len(tokens), dtype=np.int32)
    reach -= np.repeat(begin[:-1].astype(np.int32), np.diff(begin))
    found = [np.where(seen[tokens], tokens, np.int32(none))]
    for d in range(1, depth + 1):
        back = np.full_like(tokens, none)
        back[d:] = found[0][:-d]
        back[reach < d] = none
        back[reach == d - 1] = start
        if d > 1:
            back[found[-1] == none] = none
        found.append(back)
    return found


def _context(columns: list[np.ndarray], d: int) -> np.ndarray:
    """The hash of the `d` tokens before each token, as `contexts` has it."""
    found = columns[d]
    for k in range(d - 1, 0, -1):
        found = join_hash(found, columns[k])
    return found


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values) % np.uint64(buckets)).astype(np.int64)


def _send_grams(depth: int, buckets: int, hot: np.ndarray, only_hot: bool, repeated):
    def columns_of(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The distinct tokens; numbers of each token and of those before it; whether the one before is hot."""
        begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in held]))])
        tokens = np.concatenate([np.array([0, START], np.uint64), *(t for t, _ in held)])
        held.clear()
        if only_hot:
            before = tokens[1:-1].copy()
            before[begin[:-1]] = START
            rows = np.flatnonzero(lookup(before, hot)[1])
            names, ids = np.unique(np.concatenate([tokens[:1], tokens[2:][rows], before[rows]]), return_inverse=True)
            ids = ids.astype(np.int32)
            return names, [np.where(_marked(names, repeated)[ids[1 : len(rows) + 1]], ids[1 : len(rows) + 1], ids[0]), ids[len(rows) + 1 :]], np.ones(len(rows), bool)
        order, heads = grouped(tokens)
        names, ids = tokens[order[heads]], np.empty(len(tokens), np.int32)
        ids[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(tokens)))
        del tokens, order, heads
        none, start = int(ids[0]), int(ids[1])
        columns = _steps_back(ids[2:], begin, depth, start, none, _marked(names, repeated))
        is_hot = lookup(names, hot)[1][columns[1]]
        rows = columns[1] != none
        rows &= ~is_hot | (columns[2] != none) if depth > 1 else ~is_hot
        return names, [c[rows] for c in columns], is_hot[rows]

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, columns, is_hot = columns_of(held)
        if not len(is_hot):
            return
        place = _bucket(names, buckets)[columns[1]]
        if not only_hot and is_hot.any():
            place[is_hot] = _bucket(join_hash(names[columns[2][is_hot]], names[columns[1][is_hot]]), buckets)
        # By bucket, token before and token; what stands before those only brings equal rows together.
        wide = len(names).bit_length()
        spare = 63 - 2 * wide - int(buckets).bit_length()
        rank = place << wide
        rank |= columns[1]
        rank <<= wide
        rank |= columns[0]
        if spare > 0 and len(columns) > 2:
            older = columns[2].astype(np.uint64)
            for c in columns[3:]:
                older = older * np.uint64(BASE) + c.astype(np.uint64)
            rank <<= spare
            rank |= (older * np.uint64(BASE) >> np.uint64(64 - spare)).astype(np.int64)
            del older
        order = np.argsort(rank)
        del rank
        columns = [c[order] for c in columns]
        place = place[order]
        del order
        new = np.zeros(len(place), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(new)).astype(np.uint32)
        columns, place = [c[first] for c in columns], place[first]
        edges, used, number = np.flatnonzero(np.diff(place, prepend=-1)), np.zeros(len(names), bool), np.empty(len(names), np.uint32)
        for low, high in zip(edges, [*edges[1:], len(place)], strict=True):
            own = np.concatenate([c[low:high] for c in columns])
            used[own] = True
            listed = np.flatnonzero(used)
            used[listed], number[listed] = False, np.arange(len(listed))
            row = (int(place[low]), int(high - low), len(listed), squeeze(np.diff(names[listed], prepend=np.uint64(0))), squeeze(np.concatenate([number[own], times[low:high]])))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SENT, strict=True)], _SENT.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            yield from packed(held)

    return send


_SENT = pa.schema([("bucket", pa.int64()), ("rows", pa.int64()), ("tokens", pa.int64()), ("names", pa.binary()), ("grams", pa.binary())])


def _sent_grams(sent: pa.Table, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What tasks have sent to a bucket: each token, those before it, and how often they occur so."""
    rows, at = sent.column("rows").to_numpy(), 0
    columns, n = [np.empty(rows.sum(), np.uint64) for _ in range(depth + 1)], np.empty(rows.sum(), np.int64)
    for size, tokens, names, grams in zip(*(sent.column(c) for c in ("rows", "tokens", "names", "grams")), strict=True):
        size, names = size.as_py(), np.cumsum(unsqueeze(names.as_py(), tokens.as_py(), np.uint64), dtype=np.uint64)
        numbers = unsqueeze(grams.as_py(), (depth + 2) * size, np.uint32).reshape(depth + 2, size)
        for column, own in zip(columns, numbers[:-1], strict=True):
            column[at : at + size] = names[own]
        n[at : at + size] = numbers[-1]
        at += size
    return columns, n


def _levels(columns: list[np.ndarray], n: np.ndarray, depth: int, low: float, hot: np.ndarray) -> Iterator[dict]:
    """For 1 to `depth`: every key (context and token) of a bucket that occurs `low` times, and of their contexts how often they occur."""
    is_hot = lookup(columns[1], hot)[1]
    # A token of 0 is one that never repeats.
    alive, shorter = columns[0] != 0, columns[0]
    for d in range(1, depth + 1):
        context, reach = _context(columns, d), columns[d] != 0
        key = join_hash(context, columns[0])
        rows = np.flatnonzero(reach & alive & ~is_hot if d == 1 else reach & alive)
        order, heads = grouped(key[rows])
        order = rows[order]
        total = np.add.reduceat(n[order], heads) if len(heads) else np.zeros(0, np.int64)
        stays = total >= low
        alive = is_hot & alive if d == 1 else np.zeros(len(n), bool)
        alive[order[np.repeat(stays, np.diff(heads, append=len(order)))]] = True
        first = order[heads[stays]]
        names, own = np.unique(context[first], return_inverse=True)
        yield {"key": key[first], "n": total[stays].astype(float), "shorter": shorter[first], "own": own, "context": names, "times": lambda c=context, r=reach, x=names: _times(c[r], n[r], x)}
        shorter = key


def _times(contexts: np.ndarray, n: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How often each of the sorted `names` occurs; all that follows a context counts, also what does not repeat."""
    if not len(names):
        return np.zeros(0)
    order, heads = grouped(contexts)
    return np.add.reduceat(n[order], heads)[np.searchsorted(contexts[order[heads]], names)].astype(float)


def _ask(depth: int, low: float, hot: np.ndarray):
    def ask(sent: pa.Table) -> pa.Table:
        columns, n = _sent_grams(sent, depth)
        is_hot, asked = lookup(columns[1], hot)[1], []
        for d, rows in ((1, ~is_hot), (2, is_hot)):
            if rows.any():
                *_, level = _levels([c[rows] for c in columns], n[rows], d, low, hot)
                asked.append(level["shorter"])
        keys = distinct(np.concatenate(asked))
        return pa.table({"bucket": pa.array(np.full(len(keys), sent.column("bucket")[0].as_py(), np.int64)), "key": pa.array(keys.view(np.int64))})

    return ask


def _judge(depth: int, least: float, low: float, hot: np.ndarray, bar: float, discount: float, with_chance: bool):
    def judge(sent: pa.Table, known: pa.Table) -> pa.Table:
        found = []
        if sent.num_rows:
            columns, n = _sent_grams(sent, depth)
            keys, chance = known.column("key").to_numpy().view(np.uint64), known.column("value").to_numpy()
            for d, level in enumerate(_levels(columns, n, depth, low, hot), 1):
                order = np.argsort(keys)
                keys, chance = keys[order], chance[order]
                place, there = lookup(level["shorter"], keys)
                if not there.all():
                    raise ValueError("a repeated context has no shorter one")
                short, own, times, n_own = chance[place] if len(place) else np.zeros(0), level["own"], level["times"](), level["n"]
                sums = lambda x, own=own, times=times: np.bincount(own, weights=x, minlength=len(times))
                left = 1.0 - sums(n_own - discount) / times
                higher = (n_own - discount) / times[own]
                longer = higher + left[own] * short
                others = times - sums(n_own)
                rest = others * np.log(np.maximum(1.0 - sums(longer), 1e-12) / np.maximum(1.0 - sums(short), 1e-12))
                gained = sums(n_own * np.log(longer / short)) + np.where(others > 0, rest, 0.0)
                stays = (times >= least) & (gained > bar * sums(np.ones(len(own))))
                longer = np.where(stays[own], longer, short)
                found += [(d, LEFT, level["context"][stays], left[stays], times[stays].astype(np.int64)), (d, OWN, level["key"][stays[own]], n_own[stays[own]], 0)]
                if with_chance:
                    found.append((d, CHANCE, level["key"], longer, 0))
                # The words' chances stay, for the keys of hot words that are known from before.
                keys, chance = np.concatenate([keys, level["key"]]), np.concatenate([chance, longer])
        column = lambda i, kind: np.concatenate([np.broadcast_to(np.asarray(f[i], kind), len(f[2])) for f in found]) if found else np.zeros(0, kind)
        join = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
        return pa.table({"d": column(0, np.int8), "kind": column(1, np.int8), "key": join(2, np.uint64).view(np.int64), "value": join(3, np.float64), "times": column(4, np.int64)})

    return judge


def mark_keys(keys: DataFrame, items: int):
    """A broadcast bit map of `key`; a key that is not there may share a bit with one that is."""
    bits, owner_bits = _map_bits(items), 6
    own_bits = _own_bits(bits, owner_bits)

    def mark(own: pd.DataFrame) -> pd.DataFrame:
        return own_bits(int(own["owner"].iat[0]), own["place"].to_numpy(np.int64).view(np.uint64) << np.uint64(64 - bits))

    placed = keys.select(F.shiftrightunsigned("key", 64 - owner_bits).alias("owner"), F.shiftrightunsigned("key", 64 - bits).alias("place")).distinct()
    return _gathered(placed.groupBy("owner").applyInPandas(mark, MARKS), bits, owner_bits)


def learn_tree(
    training: DataFrame, words: DataFrame, depth: int = DEPTH, context_share: float = 0.0, next_share: float = 0.0, gain: float = GAIN, discount: float = DISCOUNT,
    bucket_tokens: int = BUCKET_TOKENS, hot_tokens: int = HOT_TOKENS,
) -> list[dict]:
    """The tree, one dict of two stored tables per context length: `states` (`key, left, times`) and `symbols` (`key, n`).

    `training` holds `text`; `words` holds `token, n`, its token counts. A context is a candidate if
    it occurs twice, and a next symbol gets a probability of its own in it if both together occur
    twice: `n` less the discount, of the context's `times`. All other symbols share what is `left`, in proportion to the shorter state. So the tree grows with the text.
    `context_share` and `next_share` ask for a share of all training tokens besides.

    A candidate stays if the log-likelihood that it gains over its longest shorter state is `gain`
    times half the logarithm of the number of tokens, per symbol of its own. Longer contexts are
    sought below every candidate, retained or not.

    A context and all shorter ones end in the same token, so what is known of them is decided in one bucket of that token. Tasks
    send each bucket (of about `bucket_tokens`) their distinct tokens with those before, compressed; a bucket asks only for the
    chances of its own repeated words. What follows or precedes a word that occurs once is counted without it. A token of more than `hot_tokens` is judged alone first, and then dealt by the token before it.
    """
    size = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    if not total:
        return []
    least, low = max(LEAST, context_share * total), max(LEAST, next_share * total)
    bar, buckets = gain * 0.5 * math.log(total), blocks_for(total, bucket_tokens)
    # There is a start for each end.
    hot = np.sort(np.array([r["token"] for r in words.filter(F.col("n") > hot_tokens).select("token").collect()], np.int64).view(np.uint64))
    hot = np.sort(np.where(hot == END, START, hot))
    often = words.filter(F.col("n") >= low)
    repeated = mark_keys(often.select(F.col("token").alias("key")).unionByName(training.sparkSession.createDataFrame([(int(START),)], "key long")), distinct)
    chances = often.select(F.col("token").alias("key"), ((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1))).alias("value"))

    def learnt(depth: int, apart: np.ndarray, only_hot: bool, chances: DataFrame) -> DataFrame:
        sent = training.mapInArrow(_send_grams(depth, buckets, hot, only_hot, repeated), SENT)
        known = sent.groupBy("bucket").applyInArrow(_ask(depth, low, apart), ASKED).join(chances.hint("shuffle_hash"), "key").select("bucket", "key", "value")
        return keep(sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_judge(depth, least, low, apart, bar, discount, only_hot), LEARNT))

    rows = None
    if len(hot):
        rows = learnt(1, hot[:0], True, chances)
        chances = chances.unionByName(rows.filter(F.col("kind") == CHANCE).select("key", "value"))
    rest = learnt(depth, hot, False, chances)
    rows = rest if rows is None else rows.unionByName(rest)
    of = lambda d, kind, name, *more: rows.filter((F.col("d") == d) & (F.col("kind") == kind)).select("key", F.col("value").alias(name), *more)
    return [{"states": of(d, LEFT, "left", "times"), "symbols": of(d, OWN, "n")} for d in range(1, depth + 1)]


def _extend(level: dict, at: np.ndarray, context: np.ndarray, key: np.ndarray, marked: np.ndarray, chance: np.ndarray) -> None:
    """Turn the chances into those of one context length on; they stay where the longer context is no state."""
    place, there = find(context, level["states"])
    symbol, listed = find(key[marked], level["symbols"])
    own, higher = marked[listed], np.zeros(len(at))
    # Of a listed symbol the context is a state.
    higher[own] = (level["n"][symbol[listed]] - level["discount"]) / level["times"][place[own]]
    at, place = at[there], place[there]
    if len(at):
        chance[at] = level["left"][place] * chance[at] + higher[there]


def _wanted_keys(parts: Iterable[tuple[np.ndarray, np.ndarray]], shipped, depth: int, marks: list | None = None) -> np.ndarray:
    """The sorted keys that a block asks for: its tokens, and contexts and next symbols that may be in the tree. `marks` gets where those stand."""
    found = [np.array([START])]
    for tokens, begin in parts:
        found.append(distinct(tokens))
        for at, context, key, marked in grams(tokens, begin, depth, shipped):
            found += [distinct(context), distinct(key[marked])]
            if marks is not None:
                marks.append((at, marked))
    return distinct(np.concatenate(found))


def _tokens_of(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    tables = powers(CHUNK + 1)
    return (page_tokens(part.column("text"), tables) for part in slices(block))


def _by_owner(keys: np.ndarray, owner_bits: int) -> Iterator[tuple[int, int, int]]:
    owner = (keys >> np.uint64(64 - owner_bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    for low, high in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(owner[low]), int(low), int(high)


def _request(shipped, depth: int, owner_bits: int):
    def request(block: pa.Table) -> pa.Table:
        keys, name = _wanted_keys(_tokens_of(block), shipped, depth), block.column("block")[0].as_py()
        rows = [(name, o, high - low, squeeze(np.diff(keys[low:high], prepend=np.uint64(0)))) for o, low, high in _by_owner(keys, owner_bits)]
        return pa.table([pa.array(c) for c in zip(*rows, strict=True)], REQUESTS.names)

    return request


def _pack_answers(owner_bits: int):
    """Rows of the tree and of words, to a row for each owner of a range of keys."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys, kind, value, times = (table.column(c).to_numpy() for c in ("key", "kind", "value", "times"))
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        keys, kind, value, times = keys[order], kind[order], value[order], times[order]
        rows = []
        for o, low, high in _by_owner(keys, owner_bits):
            own = slice(low, high)
            rows.append((o, high - low, squeeze(np.diff(keys[own], prepend=np.uint64(0))), squeeze(kind[own]), squeeze(value[own]), squeeze(times[own])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ANSWERS.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= OWNER_KEYS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return pack


def _kinds(answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted keys, their values and times, for counts, next symbols and states."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0), np.zeros(0, np.int64))]
    for row in answers.to_pylist():
        n = row["keys"]
        parts.append((np.cumsum(unsqueeze(row["code"], n, np.uint64), dtype=np.uint64), unsqueeze(row["kind"], n, np.int8), unsqueeze(row["value"], n, np.float64), unsqueeze(row["times"], n, np.int64)))
    keys, kind, values, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    return [(keys[at], values[at], times[at]) for at in (order[kind[order] == k] for k in (COUNT, OWN, LEFT))]


def _reply(requests: pa.Table, answers: pa.Table) -> pa.Table:
    """Bits that say which keys are there, for each kind, and then the values of those and the times of states."""
    kinds, rows = _kinds(answers), []
    for row in requests.to_pylist():
        keys = np.cumsum(unsqueeze(row["code"], row["keys"], np.uint64), dtype=np.uint64)
        looked = [lookup(keys, names) for names, _, _ in kinds]
        values = [v[place[there]] for (_, v, _), (place, there) in zip(kinds, looked, strict=True)]
        times = kinds[LEFT][2][looked[LEFT][0][looked[LEFT][1]]].astype(np.float64)
        rows.append((row["block"], row["owner"], np.packbits(np.concatenate([there for _, there in looked])).tobytes(), squeeze(np.concatenate([*values, times]))))
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], REPLIES.names)


def _read_replies(keys: np.ndarray, replies: pa.Table, owner_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a block's keys, the sorted ones of each kind; and their values, and the times of states."""
    by_owner = {r["owner"]: r for r in replies.select(["owner", "there", "values"]).to_pylist()}
    names, values = [[], [], []], [[], [], [], []]
    for o, low, high in _by_owner(keys, owner_bits):
        there = np.unpackbits(np.frombuffer(by_owner[o]["there"], np.uint8))[: 3 * (high - low)].reshape(3, high - low).astype(bool)
        sizes = there.sum(axis=1)
        for own, at in zip(names, there, strict=True):
            own.append(keys[low:high][at])
        for own, v in zip(values, np.split(unsqueeze(by_owner[o]["values"], int(sizes.sum() + sizes[LEFT]), np.float64), np.cumsum(sizes)), strict=True):
            own.append(v)
    return [np.concatenate(x) for x in names], [np.concatenate(x) for x in values]


def _score(total: int, distinct_tokens: int, depth: int, kept: list[str], shipped, owner_bits: int, discount: float):
    def score(pages: pa.Table, replies: pa.Table) -> pa.Table:
        parts, scores, marks = list(_tokens_of(pages)), [], []
        (names, symbols, states), (counts, n, left, times) = _read_replies(_wanted_keys(parts, shipped, depth, marks), replies, owner_bits)
        level = {"states": states, "left": left, "times": times, "symbols": symbols, "n": n, "discount": discount}
        placed = iter(marks)
        for tokens, begin in parts:
            place, there = find(tokens, names)
            count = np.where(there, counts[place] if len(counts) else 0, 0)
            chance = (count + 0.5) / (total + 0.5 * (distinct_tokens + 1))
            base = np.add.reduceat(np.log10(chance), begin[:-1])
            n_known = np.add.reduceat(there.astype(np.int64), begin[:-1])
            for context in contexts(tokens, begin, depth):
                at, marked = next(placed)
                _extend(level, at, context[at], join_hash(context[at], tokens[at]), marked, chance)
            scores.append((np.diff(begin), n_known, np.full(len(begin) - 1, total, np.int64), base, np.add.reduceat(np.log10(chance), begin[:-1])))
        columns = {n: pages.column(n) for n in kept} | dict(zip(("n_tokens", "n_known", "train_tokens", "base_score", "score"), map(np.concatenate, zip(*scores, strict=True)), strict=True))
        return pa.table(columns)

    return score


def score_pages(pages: DataFrame, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH, **learning) -> DataFrame:
    """The log10 probability of every captured page, learnt from the pages whose `training` is true.

    `pages` holds `path`, `text` and the boolean `training`; `learning` goes to `learn_tree`. Words
    are parted by spaces, tabs and line ends only, and A-Z are lower-cased. Returns `path, training,
    n_tokens` (words and one end), `n_known` (tokens seen in training), `train_tokens`, `base_score` (root
    only: a token of count c has (c + 0.5) / (N + 0.5 (V + 1))) and `score` (the tree).

    Counts cover all training pages. A block of about `block_bytes` of text asks once for the count of each distinct
    word and for the states and next symbols of its own text, and gets the answers that exist; words and contexts are
    compared by 64-bit hash.

    A null text counts as empty: one token, the end. A null `training` is false. Repeated or null paths return a row
    each. Without training pages every known chance is that of an empty root. An empty table returns no rows.
    """
    spark = pages.sparkSession
    pages = pages.select("path", "text", F.coalesce("training", F.lit(False)).alias("training"))
    training = pages.filter("training").select("text")
    none = spark.createDataFrame([], schema(("key", "long"), ("value", "double"), ("times", "long")))
    with shuffles_end_with_their_action(spark):
        words = keep(training.mapInArrow(_count_words, schema(("token", "long"), ("n", "long"))).groupBy("token").agg(F.sum("n").alias("n")))
        size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        tree = learn_tree(training, words, depth, **learning)
        symbols, states = none, none
        for level in tree:
            symbols = symbols.unionByName(level["symbols"].select("key", F.col("n").alias("value"), F.lit(0).cast("long").alias("times")))
            states = states.unionByName(level["states"].withColumnRenamed("left", "value"))
        items = [states.count(), symbols.count()]
        shipped = [mark_keys(df.select("key"), n) for df, n in zip((states, symbols), items, strict=True)]
        volume = pages.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    owner_bits = max(1, ((sum(items) + size["v"]) // OWNER_KEYS).bit_length())
    counts = words.select(F.col("token").alias("key"), F.col("n").cast("double").alias("value"), F.lit(0).cast("long").alias("times"))
    kinds = [df.select("key", F.lit(kind).cast("byte").alias("kind"), "value", "times") for kind, df in ((COUNT, counts), (OWN, symbols), (LEFT, states))]
    answers = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).mapInArrow(_pack_answers(owner_bits), ANSWERS)
    dealt = pages.withColumn("block", F.pmod(F.xxhash64("path", "text"), F.lit(blocks_for(volume, block_bytes))))
    requests = dealt.groupBy("block").applyInArrow(_request(shipped, depth, owner_bits), REQUESTS)
    replies = requests.groupBy("owner").cogroup(answers.groupBy("owner")).applyInArrow(_reply, REPLIES)
    kind = pages.schema["path"].dataType
    out = schema(("path", kind), ("training", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))
    score = _score(int(size["n"]), int(size["v"]), depth, ["path", "training"], shipped, owner_bits, learning.get("discount", DISCOUNT))
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, out)
