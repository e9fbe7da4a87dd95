"""Suffix-array dedup: bytes that lie in a repeated window of W bytes.

Method: a depth-limited radix sort of all suffixes, most significant digit
first, that stops at W bytes; equal groups are then exactly the repeated
windows. The passes are arranged so that almost no suffix is ever shuffled:

* Pass 0, the bucket. The first digit of a window is its *anchor*: the K-byte
  string in it with the least hash (leftmost on ties). That is a function of
  the window's bytes alone, so equal windows have equal anchors at equal
  offsets. Neighbouring windows mostly share an anchor occurrence; such a
  *run* of suffixes is one row (about 2.5 rows for 100 bytes).
* Pass 1, whole runs. Runs are ordered by (anchor, bytes of the run, place).
  A run whose bytes equal those of an earlier one repeats as a whole. A run
  whose anchor occurs nowhere else repeats nowhere. What remains are first
  runs of groups that disagree somewhere: the edges of repeated passages.
* Pass 2 and on, single suffixes of those runs only: within an anchor's group, digit by
  digit of 8 bytes, the most significant first. Only suffixes that are tied so far go
  on; those still tied after W bytes are equal, byte by byte. A group of more than
  `most_runs` runs is one task's work no more: its windows go by two hashes instead.

A block of documents settles its own repeats before anything is shuffled, so of
a hot anchor only one run for each block meets the others'.

Places are ordered by (doc_id, start); the first window of a group stays.
Runs are compared by the anchor's hash and one modulo 2^61 - 1; windows of large groups
by two of the latter, in different bases. These hold for any texts that are not made
with the bases in mind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import blocks, byte_view, ids_and_texts, kept_on_disk, until_result_ends

WINDOW_BYTES = 100
ANCHOR_BYTES = 32
#: Suffixes that a Python task looks at together; only memory depends on it.
BLOCK_BYTES = 2 << 20

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POSITION = np.uint64((1 << 24) - 1)
#: Substrings are hashed modulo this prime, by two bases; modulo 2^64 there are texts that collide for every base.
_PRIME = np.uint64((1 << 61) - 1)
_BASES = tuple(int(x) for x in _RNG.integers(1 << 40, (1 << 61) - 1, 2))
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_known_powers: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime, by halves of 31 and 30 bits."""
    x1, x0, y1, y0 = x >> np.uint64(31), x & _LOW31, y >> np.uint64(31), y & _LOW31
    middle = x1 * y0 + x0 * y1
    return _reduced(x1 * y1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + x0 * y0)


def _powers(base: int, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo the prime, by doubling; a task's blocks share them."""
    known = _known_powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(n - 1, 1).bit_length()
        known = np.ones(size, np.uint64)
        done = 1
        while done < size:
            known[done : 2 * done] = _times(known[:done], np.uint64(pow(base, done, int(_PRIME))))
            done *= 2
        if n <= 1 << 23:  # of longer texts they aren't kept
            _known_powers[base] = known
    return known


class _Substrings:
    """Hashes of any substrings of a byte array: polynomial prefix sums modulo 2^61 - 1 in one of two bases, shifted to a common power."""

    def __init__(self, data: np.ndarray, which: int, step: int = 1 << 22):
        n, base = len(data), _BASES[which]
        self.powers = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        carry = np.uint64(0)
        for at in range(0, n, step):  # sums of so many products stay below 2^64
            letter = data[at : at + step].astype(np.uint64) + np.uint64(1)
            power = self.powers[at : at + len(letter)]
            high, low = np.cumsum(letter * (power >> np.uint64(31))), np.cumsum(letter * (power & _LOW31))
            high = _reduced(high)
            turned = ((high & _LOW30) << np.uint64(31)) + (high >> np.uint64(30))
            self.sums[at + 1 : at + 1 + len(letter)] = _reduced(_reduced(turned) + _reduced(low) + carry)
            carry = self.sums[at + len(letter)]
        self.shift = np.uint64(pow(base, (1 << 40) - n, int(_PRIME)))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        aligned = _times(self.powers[len(self.sums) - 1 - start], self.shift)
        return _mixed(_times(_reduced(self.sums[stop] + (_PRIME - self.sums[start])), aligned))


def _groups(data: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """A number for each window, the same of equal ones: digits of 8 bytes, the most significant first; only windows that are tied go on."""
    group = np.zeros(len(begin), np.int64)
    width = min(8, window)
    digits = np.lib.stride_tricks.sliding_window_view(data, width) if len(data) >= width else np.zeros((0, width), np.uint8)
    weights = np.uint64(256) ** np.arange(width - 1, -1, -1, dtype=np.uint64)
    active, used = np.arange(len(begin)), 1
    for place in [*range(0, window - width, width), window - width]:
        if not len(active):
            break
        digit = (digits[begin[active] + place].astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        order = np.lexsort((digit, group[active]))
        active, digit = active[order], digit[order]
        own = group[active]
        opens = np.ones(len(active), bool)
        opens[1:] = (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(opens) - 1
        size = np.bincount(number)
        group[active] = used + number
        used += len(size)
        active = active[size[number] > 1]
    return group


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` (a power of two) bytes from each position; wrong where fewer are left."""
    out, step = _TABLE[data], 1
    while step < length:
        ahead = np.zeros_like(out)
        ahead[: len(out) - step] = out[step:]
        out = (out * _MIX) ^ (ahead + (out >> np.uint64(31)))
        out += out << np.uint64(7)
        step *= 2
    return _mixed(out)


def runs_of_block(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first start in the row, further starts, anchor hash, run hash) of each run of windows.

    data holds the rows' bytes back to back; windows never cross rows.
    """
    n = len(data)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = _grams(data, anchor)
    least = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    width, size = window - anchor + 1, 1
    while size * 2 <= width:
        np.minimum(least[: len(least) - size], least[size:], out=least[: len(least) - size])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    least = (least & _POSITION).astype(np.int32)
    inside = np.zeros(n + 1, np.int8)
    lengths = np.diff(offsets)
    long = lengths >= window
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - window + 1, -1)
    valid = np.cumsum(inside[:n], dtype=np.int8)[: n - window + 1].astype(bool)
    place = np.where(valid, least[: n - window + 1], -1)
    edge = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [len(place)])) - 1
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    at = place[first].astype(np.int64)
    whole = _Substrings(data, 0)(first, last + window)
    whole = _mixed(whole + (at - first).astype(np.uint64) * _MIX + (last - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first - offsets[row], last - first, grams[at], whole


def _repeats_here(ids: np.ndarray, start: np.ndarray, anchors: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Runs that an earlier place of the same block has too: they need no comparing any more."""
    order = np.lexsort((start, ids, whole, anchors))
    a, w, i, s = anchors[order], whole[order], ids[order], start[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    lead = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0)) if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = (i != i[lead]) | (s != s[lead])
    return out


def _scan_runs(window: int, anchor: int):
    names = ["doc_id", "start", "more", "anchor", "whole", "known"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids = np.asarray(block.column(0).cast(pa.int64()))
            data, offsets = byte_view(block.column(1))
            # A text beyond a block's size goes in pieces that overlap by window - 1 bytes: each suffix is in one.
            for low in range(0, max(len(data), 1), BLOCK_BYTES) if len(ids) == 1 else (0,):
                piece = data[low : low + BLOCK_BYTES + window - 1] if len(ids) == 1 else data
                at = np.array([0, len(piece)]) if len(ids) == 1 else offsets
                row, start, more, anchors, whole = runs_of_block(piece, at, window, anchor)
                start = start + low
                columns = [ids[row], start, more.astype(np.int16), anchors.view(np.int64), whole.view(np.int64), _repeats_here(ids[row], start, anchors, whole)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return scan


def _cut_contexts(window: int):
    """(doc_id, text, runs) to the bytes that each run's windows cover."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 * BLOCK_BYTES):
            data, offsets = byte_view(block.column(1))
            runs = block.column(2)
            counts = np.asarray(runs.value_lengths().fill_null(0))
            flat = runs.flatten()
            row = np.repeat(np.arange(len(counts)), counts)
            start = np.asarray(flat.field("start"))
            begin = offsets[row] + start
            end = begin + np.asarray(flat.field("more")) + window
            view = data.tobytes()
            pieces = [view[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            ids = np.asarray(block.column(0))[row] if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(ids, pa.int64()), pa.array(start), pa.array(pieces, pa.binary())], ["anchor", "doc_id", "start", "bytes"])

    return cut


def _later_windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Runs of windows that an earlier row of the batch has too; rows are whole anchor groups in the order of places."""
    data, offsets = byte_view(batch.column(3))
    many = np.diff(offsets) - window + 1
    row = np.repeat(np.arange(len(many)), many)
    index = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    group = _groups(data, offsets[row] + index, window)
    ids, start = np.asarray(batch.column(1))[row], np.asarray(batch.column(2))[row] + index
    order = np.lexsort((start, ids, group))
    group, i, s = group[order], ids[order], start[order]
    opens = np.ones(len(order), bool)
    opens[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = (i != i[lead]) | (s != s[lead])
    joined = np.zeros(len(later), bool)
    joined[1:] = later[1:] & later[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(later & ~joined)
    last = np.flatnonzero(later & ~np.append(joined[1:], False))
    none = pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(start[first]), pa.array(start[last] + window), none, none], ["doc_id", "start", "stop", "one", "two"])


def _single_windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Every window of the rows with hashes in two bases, for a group that is too large for one task's memory."""
    data, offsets = byte_view(batch.column(3))
    many = np.diff(offsets) - window + 1
    row = np.repeat(np.arange(len(many)), many)
    index = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    begin = offsets[row] + index
    one, two = (_Substrings(data, which)(begin, begin + window).view(np.int64) for which in (0, 1))
    start = np.asarray(batch.column(2))[row] + index
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.asarray(batch.column(1))[row], start, start + window, one, two)], ["doc_id", "start", "stop", "one", "two"])


def _radix(window: int, most: int):
    """The digit passes over rows sorted by anchor: groups of up to `most` runs here, larger ones as single windows."""

    def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, large, last = 0, False, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                table = pa.Table.from_batches(held).combine_chunks()
                for batch in table.to_batches():
                    yield _single_windows(batch, window) if large else _later_windows(batch, window)
            held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.asarray(batch.column(0))
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            if last is not None and anchors[0] != last:
                yield from flush()
                large = False
            i = 0
            while i < len(edges) - 1:
                # Whole groups, and the last of the batch alone: it may go on in the next batch.
                j = i + 1
                while not large and j < len(edges) - 2 and edges[j + 1] - edges[i] + size <= most:
                    j += 1
                held.append(batch.slice(edges[i], edges[j] - edges[i]))
                size += edges[j] - edges[i]
                i = j
                # What was held before is of the first group here, so more than `most` runs are one group, of any batches.
                large = large or size > most
                if i < len(edges) - 1:
                    yield from flush()
                    large = False
                elif large:
                    yield from flush()
            last = anchors[-1]
        yield from flush()

    return refine


def _apply(names: list[str], with_bytes: bool):
    """Rows with text and the spans to remove to what is left."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2 * BLOCK_BYTES):
            data, offsets = byte_view(block.column(block.schema.get_field_index("text")))
            spans = block.column(block.schema.get_field_index("spans"))
            counts = np.asarray(spans.value_lengths().fill_null(0))
            flat = spans.flatten()
            base = np.repeat(offsets[:-1], counts)
            change = np.bincount(base + np.asarray(flat.field("start")), minlength=len(data) + 1) - np.bincount(base + np.asarray(flat.field("stop")), minlength=len(data) + 1)
            gone = np.cumsum(change[: len(data)]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            before = np.concatenate(([False], gone[:-1]))
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            rises = np.concatenate(([0], np.cumsum(gone & ~before)))
            removed = total[offsets[1:]] - total[offsets[:-1]]
            runs = rises[offsets[1:]] - rises[offsets[:-1]]
            left = data[~gone].tobytes()
            ends = np.concatenate(([0], np.cumsum(np.diff(offsets) - removed))).tolist()
            kept = [left[i:j] for i, j in zip(ends, ends[1:])]
            out = [block.column(block.schema.get_field_index(x)) for x in names]
            out += [pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            labels = [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                out += [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
                labels += ["kept", "kept_text"]
            yield pa.RecordBatch.from_arrays(out, labels)

    return apply


@until_result_ends
def remove_repeats(docs: DataFrame, window: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, keep: tuple[str, ...] = (), with_bytes: bool = True, most_runs: int = 20_000) -> DataFrame:
    """Remove each byte that lies in a `window`-byte string which also starts at an earlier place.

    docs: doc_id and text; other columns named in `keep` are carried, the rest ignored, whatever
    their names. Returns doc_id, the columns of `keep`, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, with_bytes, kept (the bytes left, which need not be UTF-8) and
    kept_text (these without the parts of cut characters).

    A null text counts as empty; texts under `window` bytes lose nothing. A place is (doc_id,
    start): rows that repeat a doc_id share their places, so a whole row given twice does not
    remove itself. A row with null doc_id has no place: it stays whole and removes nothing.
    An empty table gives an empty result. Texts of any length go in pieces of BLOCK_BYTES.
    """
    texts = ids_and_texts(docs)
    runs = texts.where("doc_id is not null").mapInArrow(_scan_runs(window, anchor), "doc_id long, start long, more short, anchor long, whole long, known boolean")
    # Runs that their own block has already settled are dealt by their place, so that a hot anchor's rows do not meet.
    runs = runs.withColumn("slot", F.when(F.col("known"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))).repartition(F.col("slot"))
    same = Window.partitionBy("slot", "known", "whole").orderBy("doc_id", "start")
    group = Window.partitionBy("slot", "known")
    place = F.struct("doc_id", "start")
    marked = (
        runs.withColumn("opens", ~F.col("known") & (F.first(place).over(same) == place))
        .withColumn("mixed", F.min("whole").over(group) != F.max("whole").over(group))
        .where("not opens or mixed")
        .select("doc_id", "start", "more", F.when(F.col("opens"), F.col("anchor")).alias("anchor"))
    )
    marked = kept_on_disk(marked)
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep).repartition(F.col("doc_id"))
    edges = marked.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("start", "more", "anchor")).alias("runs"))
    # A left join puts no filter below the exchange of the texts, so both joins read the same one.
    edged = carried.join(edges, "doc_id", "left").select("doc_id", F.when(F.col("runs").isNotNull(), F.col("text")).otherwise("").alias("text"), "runs")
    contexts = edged.mapInArrow(_cut_contexts(window), "anchor long, doc_id long, start long, bytes binary")
    refined = contexts.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_radix(window, most_runs), "doc_id long, start long, stop long, one long, two long")
    # Settled spans have no hashes; each stands alone here.
    again = Window.partitionBy(F.coalesce("one", F.xxhash64("doc_id", "start")), "two").orderBy("doc_id", "start")
    later = refined.withColumn("opens", F.first(place).over(again) == place).where("one is null or not opens")
    spans = (
        marked.where("anchor is null").select("doc_id", "start", (F.col("start") + F.col("more") + window).alias("stop"))
        .unionByName(later.select("doc_id", "start", "stop"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    names = ["doc_id", *keep]
    kinds = dict(docs.dtypes) | {"doc_id": "long"}
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in names), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *["kept binary, kept_text string"] * with_bytes])
    return carried.join(spans, "doc_id", "left").select(*names, "text", "spans").mapInArrow(_apply(names, with_bytes), schema)
