"""SentencePiece encoding and decoding of captured pages by a shared-prefix Viterbi pass.

A text is cut into marked words (their white space, as U+2581, in front). The distinct words of a
batch are sorted, which is a depth-first walk of their trie: a word reuses the forward states of the
prefix that it shares with the word before it.

The forward state of a prefix is the last piece of the prefix's best encoding. In a unigram model
the best one has the greatest sum of scores. In a BPE model scores order merges and do not add up;
there the prefix's own encoding is the only one whose neighbouring pieces would all stay apart when
merged, so a piece extends a prefix if the pair (last piece, new piece) encodes to itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from string import punctuation
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinlens.llm.shared import key_type, page_texts, schema
from twinlens.llm.words import CHUNK, buffers, hashes, powers, slices

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6
CACHE_WORDS = 400_000
MOST_PAIRS = 300_000
SHORT = 64


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """Number, wire type and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = raw[at : at + size], at + size
        yield tag >> 3, kind, value


def read_model(raw: bytes) -> dict:
    """What encoding needs of a sentencepiece model: pieces with scores and kinds, and how it treats spaces.

    Only models whose normaliser changes no characters are taken; others raise ValueError.
    """
    pieces: list[tuple[str, float, int]] = []
    model = {"kind": UNIGRAM, "prefix": True, "collapse": True, "byte_fallback": False}
    for number, _, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for field, _, x in _fields(value):
                if field == 1:
                    piece = x.decode()
                elif field == 2:
                    score = float(np.frombuffer(x, np.float32)[0])
                else:
                    kind = x
            pieces.append((piece, score, kind))
        elif number == 2:
            settings = {f: x for f, _, x in _fields(value)}
            model["kind"], model["byte_fallback"] = settings.get(3, UNIGRAM), bool(settings.get(35, 0))
        elif number == 3:
            settings = {f: x for f, _, x in _fields(value)}
            model["prefix"], model["collapse"] = bool(settings.get(3, 1)), bool(settings.get(4, 1))
            if settings.get(2):
                raise ValueError("the model's normaliser rewrites characters")
    if model["collapse"] or model["kind"] not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models that keep extra white space are read")
    model["pieces"] = [p for p, _, _ in pieces]
    model["scores"] = [s for _, s, _ in pieces]
    model["ids"] = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    model["bytes"] = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
    model["unknown"] = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
    model["longest"] = max(map(len, model["ids"]), default=1)
    if any(SPACE in p.lstrip(SPACE) for p in model["ids"]):
        raise ValueError("pieces that reach over a space are not read")
    return model


class Walker:
    """Encodes sorted words; keeps the forward states of the last word's prefixes.

    A state is the last piece of the prefix, its score in a unigram model, and, up to SHORT characters, its ids.
    """

    def __init__(self, model: dict):
        self.model, self.word = model, ""
        self.last: list[str] = [""]
        self.score: list[float] = [0.0]
        self.codes: list[bytes] = [b""]
        self.code = {piece: pack("<i", i) for piece, i in model["ids"].items()}
        self.whole: dict[str, bool] = {}
        # For each piece, what may follow it in an encoding: the next piece's ids, or False. And the same by prefix.
        self.follow: dict[str, dict[str, bytes | bool]] = {}
        self.after: list[dict] = [{}]
        self.pairs = 0
        # An unknown character is worse than every piece.
        self.floor = min(model["scores"], default=0.0) - 10.0

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: join the neighbours whose piece scores best, the first of equals, until none is a piece."""
        ids, scores, symbols = self.model["ids"], self.model["scores"], list(symbols)
        while True:
            best, where = -np.inf, -1
            for i in range(len(symbols) - 1):
                piece = ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and scores[piece] > best:
                    best, where = scores[piece], i
            if where < 0:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether `right` is its own encoding and follows `left` in the encoding of both."""
        known = self.whole.get(right)
        if known is None:
            known = self.whole[right] = len(right) == 1 or self.merged(list(right)) == [right]
        return known and (not left or self.merged(list(left + right)) == [left, right])

    def grow_bpe(self, word: str, begin: int) -> None:
        """Forward states of the prefixes of more than `begin` characters, in a BPE model."""
        code, last, codes, after, longest = self.code, self.last, self.codes, self.after, self.model["longest"]
        if self.pairs > MOST_PAIRS:
            self.follow, self.pairs = {}, 0
        for end in range(begin + 1, len(word) + 1):
            # One piece at most fits, so the order of trial is free; most are short.
            for low in range(end - 1, max(0, end - longest) - 1, -1):
                piece = word[low:end]
                own = after[low].get(piece)
                if own is None:
                    if piece not in code and low < end - 1:
                        continue
                    own = after[low][piece] = code.get(piece, True) if self.stay_apart(last[low], piece) else False
                    self.pairs += 1
                if own is not False:
                    break
            else:
                low, piece, own = end - 1, word[end - 1], True
            if end <= SHORT:
                codes.append(self.coded(low, piece) if own is True else codes[low] + own)
            last.append(piece)
            table = self.follow.get(piece)
            if table is None:
                table = self.follow[piece] = {}
            after.append(table)

    def grow_unigram(self, word: str, begin: int) -> None:
        """Forward states of the prefixes of more than `begin` characters, in a unigram model."""
        ids, scores, longest = self.model["ids"], self.model["scores"], self.model["longest"]
        for end in range(begin + 1, len(word) + 1):
            best, chosen = -np.inf, end - 1
            for low in range(max(0, end - longest), end):
                i = ids.get(word[low:end])
                if i is not None or low == end - 1:
                    total = self.score[low] + (self.floor if i is None else scores[i])
                    if total > best:
                        best, chosen = total, low
            self.last.append(word[chosen:end])
            self.score.append(best)
            if end <= SHORT:
                self.codes.append(self.coded(chosen, word[chosen:end]))

    def coded(self, low: int, piece: str) -> bytes:
        """The ids of a prefix that ends in `piece`, given those of the `low` characters before it."""
        code = self.code.get(piece)
        if code is None:
            if self.model["byte_fallback"]:
                code = b"".join(pack("<i", self.model["bytes"][b]) for b in piece.encode())
            else:
                unknown = pack("<i", self.model["unknown"])
                code = b"" if self.codes[low].endswith(unknown) and self.last[low] not in self.code else unknown
        return self.codes[low] + code

    def encode_bytes(self, word: str) -> bytes:
        """The ids of a word as 32-bit numbers; quick if it shares a prefix with the word before."""
        if word:
            shared, before, most = 0, self.word, min(len(word), len(self.word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del self.last[shared + 1 :], self.score[shared + 1 :], self.codes[shared + 1 :], self.after[shared + 1 :]
            (self.grow_bpe if self.model["kind"] == BPE else self.grow_unigram)(word, shared)
            self.word = word
            return self.codes[-1] if len(word) <= SHORT else self.joined(self.pieces())
        return b""

    def joined(self, pieces: list[str]) -> bytes:
        """The ids of a long word's pieces; prefixes that long keep none, or memory would grow with the square of the word."""
        out, unknown = [], pack("<i", self.model["unknown"])
        for piece in pieces:
            code = self.code.get(piece)
            if code is None and self.model["byte_fallback"]:
                code = b"".join(pack("<i", self.model["bytes"][b]) for b in piece.encode())
            elif code is None:
                code = b"" if out and out[-1] is unknown else unknown
            if code:
                out.append(code)
        return b"".join(out)

    def pieces(self) -> list[str]:
        """The pieces of the last word."""
        found, end = [], len(self.word)
        while end:
            found.append(self.last[end])
            end -= len(self.last[end])
        return found[::-1]

    def encode_ids(self, word: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(word), np.int32).tolist()

    def encode(self, word: str) -> list[str]:
        """The pieces of a word."""
        self.encode_bytes(word)
        return self.pieces() if word else []


def cut_signs(model: dict) -> tuple[np.ndarray, bool]:
    """Where words may be cut further: before which bytes if a letter or digit precedes, and whether around line ends.

    A cut is made only where no piece of the model reaches over.
    """
    joined = {b for p in model["ids"] for a, b in pairwise(p) if a.isalnum()}
    signs = np.zeros(256, bool)
    signs[[ord(c) for c in punctuation if c not in joined]] = True
    return signs, not any("\n" in p and len(p) > 1 for p in model["ids"])


def marked_words(column: pa.Array, prefix: bool, signs: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, begin and end of their words (spaces in front), and the number of words before each text."""
    data, at = buffers(pc.replace_substring(column, SPACE, " "))
    if prefix:
        filled = np.diff(at) > 0
        moved = at + np.concatenate([[0], np.cumsum(filled)])
        room = np.full(moved[-1], 0x20, np.uint8)
        room[np.arange(len(data)) + np.repeat(np.cumsum(filled), np.diff(at))] = data
        data, at = room, moved
    space, line = data == 0x20, data == 0x0A
    plain = np.zeros(256, bool)
    plain[0x30:0x3A] = plain[0x41:0x5B] = plain[0x61:0x7B] = True
    new = np.zeros(len(data), bool)
    new[1:] = (space[1:] & ~space[:-1]) | (plain[data[:-1]] & signs[data[1:]])
    if lines:
        new |= line
        new[1:] |= line[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(new)
    return data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, at)


def _encode(shipped):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, tables = read_model(shipped.value), {}, powers(CHUNK + 1)
        signs, lines = cut_signs(model)
        walker = Walker(model)
        for batch in (part for whole in batches for part in slices(whole, size=2 << 20)):
            data, starts, ends, first = marked_words(batch.column("text"), model["prefix"], signs, lines)
            distinct, example, word = np.unique(hashes(data, starts, ends, tables, fold=False), return_index=True, return_inverse=True)
            names = distinct.tolist()
            if len(known) > CACHE_WORDS:  # only speed depends on what is remembered
                known = {h: known[h] for h in names if h in known}
            raw = data.tobytes()
            new = [(raw[starts[i] : ends[i]].decode().replace(" ", SPACE), h) for h, i in zip(names, example.tolist(), strict=True) if h not in known]
            for text, h in sorted(new):
                known[h] = walker.encode_bytes(text)
            codes = [known[h] for h in names]
            size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            flat, begin = np.frombuffer(b"".join(codes), np.int32), np.cumsum(size) - size
            length = size[word]
            ends_of = np.concatenate([[0], np.cumsum(length)])
            ids = flat[np.arange(ends_of[-1]) + np.repeat(begin[word] - ends_of[:-1], length)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.ListArray.from_arrays(pa.array(ends_of[first].astype(np.int32)), pa.array(ids))], ["path", "ids"])

    return encode


def _few_ids(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` ids, one row at least."""
    ends, begin = np.cumsum(np.nan_to_num(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _decode(shipped):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(shipped.value)
        own = {i: b for b, i in model["bytes"].items()}
        raw = [bytes([own[i]]) if i in own else (" ⁇ " if i == model["unknown"] else p.replace(SPACE, " ")).encode() for i, p in enumerate(model["pieces"])]
        marked = np.array([model["prefix"] and p.startswith(SPACE) for p in model["pieces"]], bool)
        size, blob = np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        for batch in (part for whole in batches for part in _few_ids(whole)):
            column = batch.column("ids")
            ids, counts = column.flatten().to_numpy().astype(np.int64), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            # The space put before a text goes again.
            heads = first[:-1][counts > 0]
            less = np.zeros(len(ids), np.int64)
            less[heads] = marked[ids[heads]]
            length, source = size[ids] - less, begin[ids] + less
            ends = np.concatenate([[0], np.cumsum(length)])
            data = blob[np.arange(ends[-1]) + np.repeat(source - ends[:-1], length)]
            texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(ends[first]), pa.py_buffer(data))
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:  # ids that encode no text
                texts = pa.array([data[i:j].tobytes().decode(errors="replace") for i, j in zip(ends[first[:-1]], ends[first[1:]], strict=True)], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), column, texts.cast(pa.string())], ["path", "ids", "text"])

    return decode


def encode_pages(pages: DataFrame, model: bytes) -> DataFrame:
    """`path, ids` of every captured page: the piece ids of its whole text, without begin or end.

    `pages` holds `path` and `text`; `model` is the content of a sentencepiece `.model` file. A
    character that no piece has becomes its bytes, or the unknown id in a model without byte pieces.
    A null or empty text has no ids. Repeated or null paths return a row each; an empty table
    returns none.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    return page_texts(pages).mapInArrow(_encode(shipped), schema(("path", key_type(pages)), ("ids", T.ArrayType(T.IntegerType()))))


def decode_pages(encoded: DataFrame, model: bytes) -> DataFrame:
    """`path, ids, text` for `path, ids`: the text that was encoded, except that U+2581 comes back as a space
    and an unknown id as a mark. Null ids count as none."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)
    return encoded.select("path", "ids").mapInArrow(_decode(shipped), schema(("path", key_type(encoded)), ("ids", T.ArrayType(T.IntegerType())), ("text", "string")))
