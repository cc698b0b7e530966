"""Fill-in-middle training texts from captured pages, and the way back.

A page's text is cut at two token bounds. Every byte of a batch then has one place in the output: its own place plus the
displacement of its part, and displacements change at part bounds only. Their differences are laid out along the bytes,
summed up, and the bytes scattered in one step; gathering along the same displacements restores the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.shared import schema
from twinlens.llm.words import CHUNK, buffers, slices

# The marks before prefix, suffix and middle, three bytes each.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
MARK = 3


def _letters() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[0x41:0x5B] = True
    inside[0x61:0x7B] = True
    return inside


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token begins at each byte: at the first letter of a run of A-Z and a-z, and at any other character."""
    letter = _letters()[data]
    begins = np.ones(len(data), bool)
    begins[1:] = ~letter[:-1]
    begins[at[:-1][at[:-1] < len(data)]] = True
    return np.where(letter, begins, (data & 0xC0) != 0x80)


def counts_before(mask: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many are set before each of the ascending `points`; memory follows CHUNK."""
    out, carry, i = np.zeros(len(points), np.int64), 0, 0
    for low in range(0, len(mask) + 1, CHUNK):
        part = mask[low : low + CHUNK]
        j = int(np.searchsorted(points, low + CHUNK, "left"))
        total = np.concatenate([[0], np.cumsum(part)])
        out[i:j] = carry + total[points[i:j] - low]
        carry, i = carry + int(total[-1]), j
    return out


def places_of(mask: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the set ones of the ascending `ranks` (from 0) stand; memory follows CHUNK."""
    out, carry, i = np.zeros(len(ranks), np.int64), 0, 0
    for low in range(0, len(mask), CHUNK):
        found = np.flatnonzero(mask[low : low + CHUNK])
        j = int(np.searchsorted(ranks, carry + len(found), "left"))
        out[i:j] = low + found[ranks[i:j] - carry]
        carry, i = carry + len(found), j
    return out


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every mark inside a text: its place, its letter, and the number of its text."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    letter = data[1:-1]
    here = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))))
    text = np.searchsorted(at, here, "right") - 1
    inside = here + MARK <= at[text + 1]
    return here[inside], data[here[inside] + 1], text[inside]


def displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For runs of bytes, the place of each after its displacement.

    Part k begins at `starts[k]` (ascending; empty parts share a start) and moves by `shifts[k]`.
    """
    steps, carry, i = np.diff(shifts, prepend=0), 0, 0
    for low in range(0, size, CHUNK):
        high = min(size, low + CHUNK)
        j = int(np.searchsorted(starts, high, "left"))
        change = np.zeros(high - low, np.int64)
        np.add.at(change, starts[i:j] - low, steps[i:j])
        change[0] += carry
        moved = np.cumsum(change)
        carry, i = int(moved[-1]), j
        yield low, high, moved + np.arange(low, high)


def layout(at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where outputs begin, where the parts of all texts begin, how far each moves, and the places of the marks P, S and M."""
    marked = form != PLAIN
    begin, end = at[:-1], at[1:]
    out_at = at + np.concatenate([[0], np.cumsum(marked * (3 * MARK))])
    head, tail, base = first - begin, end - second, out_at[:-1]
    prefix_mark = np.where(form == SPM, base + MARK + tail, base)
    suffix_mark = np.where(form == SPM, base, base + MARK + head)
    middle_mark = base + 2 * MARK + head + tail
    to = np.stack([prefix_mark, middle_mark, suffix_mark], 1) + MARK
    starts = np.stack([begin, first, second], 1)
    shifts = np.where(marked[:, None], to - starts, (base - begin)[:, None])
    return out_at, starts.ravel(), shifts.ravel(), np.stack([prefix_mark, suffix_mark, middle_mark], 1)[marked]


def scatter(data: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch, and where each begins. `first` and `second` are the byte places of the cuts."""
    out_at, starts, shifts, mark = layout(at, first, second, form)
    out = np.empty(int(out_at[-1]), np.uint8)
    for low, high, place in displaced(starts, shifts, len(data)):
        out[place] = data[low:high]
    for column, sign in enumerate((PREFIX, SUFFIX, MIDDLE)):
        out[mark[:, column, None] + np.arange(MARK)] = np.frombuffer(sign, np.uint8)
    return out, out_at


def gather(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a batch of outputs, where each begins, and whether each had the marks of its form.

    An output without them comes back empty.
    """
    place, letter, text = marks(out, out_at)
    wanted = form[text] != PLAIN
    place, letter, text = place[wanted], letter[wanted], text[wanted]
    n = len(form)
    three = np.bincount(text, minlength=n) == 3
    found, seen = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.uint8)
    nth = np.arange(len(text)) - np.searchsorted(text, text, "left")
    ok = three[text]
    found[text[ok], nth[ok]], seen[text[ok], nth[ok]] = place[ok], letter[ok]
    order = {PSM: b"PSM", SPM: b"SPM"}
    good = form == PLAIN
    for kind, signs in order.items():
        good |= (form == kind) & three & (seen == np.frombuffer(signs, np.uint8)).all(1) & (found[:, 0] == out_at[:-1])
    size = np.where(good, np.diff(out_at) - np.where(form == PLAIN, 0, 3 * MARK), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    one, two = found[:, 1] - found[:, 0] - MARK, found[:, 2] - found[:, 1] - MARK
    head, tail = np.where(form == SPM, two, one), np.where(form == SPM, one, two)
    cut = good & (form != PLAIN)
    first = np.where(cut, at[:-1] + head, at[1:])
    second = np.where(cut, at[1:] - tail, at[1:])
    moved_to, starts, shifts, _ = layout(at, first, second, np.where(cut, form, PLAIN))
    # A bad output takes room that its text does not, so displacements count from the real outputs.
    shifts = shifts + np.repeat(out_at[:-1] - moved_to[:-1], 3)
    data = np.empty(int(at[-1]), np.uint8)
    for low, high, source in displaced(starts, shifts, len(data)):
        data[low:high] = out[source]
    return data, at, good


def _strings(data: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    nulls = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data), nulls)


def _cut(keys: Sequence[str], names: Sequence[str], plain: int, swapped: int, prove: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = buffers(part.column("text"))
                h = [part.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
                starts = token_starts(data, at)
                before = counts_before(starts, at)
                n = np.diff(before)
                one, two = h[0] % (n + 1), h[1] % (n + 1)
                units = np.stack([np.minimum(one, two), np.maximum(one, two)], 1)
                # A cut after the last token has no token that begins there.
                inside = units < n[:, None]
                cuts = np.repeat(at[1:, None], 2, 1)
                cuts[inside] = places_of(starts, (before[:-1, None] + units)[inside])
                form = np.where(h[2] % 100 >= plain, PLAIN, np.where(h[3] % 100 < swapped, SPM, PSM))
                form[n == 0] = PLAIN
                form[marks(data, at)[2]] = PLAIN
                marked = form != PLAIN
                points = np.concatenate([at[:-1, None], cuts], 1)
                chars = np.diff(counts_before((data & 0xC0) != 0x80, points.ravel()).reshape(-1, 3), axis=1)
                cuts[~marked] = at[1:][~marked, None]
                out, out_at = scatter(data, at, cuts[:, 0], cuts[:, 1], form)
                made = [pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()), *[pa.array(chars[:, i], mask=~marked) for i in (0, 1)], _strings(out, out_at)]
                if prove:
                    made.append(_strings(*gather(out, out_at, form)))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *made], names=[*keys, *names])

    return cut


def fill_in_middle(pages: DataFrame, keys: Sequence[str] = ("side", "path"), seed: int = 1, plain_from: int = 90, spm_below: int = 20, prove: bool = False) -> DataFrame:
    """Cut each captured page's text into prefix, middle and suffix, and write the middle last.

    `pages` holds the columns `keys` (the library's key of a page is its side and path; any types that cast to text) and
    `text`; other columns are ignored. Returns `keys`, `n` (tokens: runs of A-Z and a-z, and every other character),
    `form`, `prefix_chars`, `middle_chars` (characters; null in plain form) and `output`. Both cuts, and the form, come
    from the SHA-256 of `seed` and the keys joined by colons, so a page is cut alike in every run; null keys are left out
    there. In form `psm` the output is prefix, suffix, middle, each behind its mark; in `spm` suffix, prefix, middle; of
    100 pages about 100 - `plain_from` stay `plain`, and of the others `spm_below` are `spm`. With `prove`, `restored` is
    added: the text rebuilt from each output and its form, as `restore_texts` does, while the output is at hand.

    A null text counts as empty. Empty texts, and texts that hold a mark, stay plain. Rows that repeat a key and a text
    return a row each, with the same cuts. An empty table returns no rows. Nothing is shuffled; memory follows the bytes
    of the longest text and of a slice of a few MB.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    rows = pages.select(*keys, "text", digest.alias("digest"))
    numbers = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    made = (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"), *[("restored", "string")] * prove)
    out = schema(*[(k, pages.schema[k].dataType) for k in keys], *made)
    return rows.select(*keys, "text", *numbers).mapInArrow(_cut(keys, [m for m, _ in made], plain_from, spm_below, prove), out)


def _restore(names: Sequence[str]):
    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                form = np.array([FORMS.index(f) if f in FORMS else PLAIN for f in part.column("form").to_pylist()], np.int64)
                data, at, good = gather(*buffers(part.column("output")), form)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(data, at, good)], names=[*names, "text"])

    return restore


def restore_texts(outputs: DataFrame) -> DataFrame:
    """Add `text`, rebuilt from `output` and `form` alone; every other column is kept.

    The inverse of `fill_in_middle`. A null or unknown form counts as plain, a null output as empty; an output without
    the marks of its form, in their order, has a null text. An empty table returns no rows. A column `text` of the input
    is replaced.
    """
    rows = outputs.drop("text")
    return rows.mapInArrow(_restore(rows.columns), schema(*[(f.name, f.dataType) for f in rows.schema], ("text", "string")))
