"""What all training texts teach about the word after the last 1, 2 or 3 words.

A context is a hash of whole words and has one of SLOTS slots of its order. A slot holds one pair of
context and next word with a number: the vote of Boyer and Moore, as it merges (Misra and Gries with
one counter). Every token of every training text votes, once for each text that has the pair; unlike
votes cancel, so a pair with more than half of a slot's votes is held whatever the tasks and their
order, and its number is never above its true count. Tables are of fixed size, so contexts that
share a slot with more frequent ones are not held: that is the model's capacity, not a choice of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import byte_view

CONTEXT_ORDERS = (1, 2, 3)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Slots of a row: small, so that an Arrow batch of so many rows as there may be is bounded, however many tasks vote.
CHUNK = 1 << 10
#: Text of a task, about, and text that is counted at once.
TASK_BYTES = 1 << 27
BLOCK_BYTES = 1 << 20
#: Text whose words are counted at once, and how many words of it.
COUNT_BYTES = 3 << 23
COUNT_WORDS = 1 << 22
#: A pair: so many bits of the word's hash, below the others of the context's.
WORD_BITS = 40
#: Words that are hashed at once.
HASHED = 1 << 17
#: Longer words are hashed one by one.
LONG = 64

_PLACE_BITS = 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a byte array, HASHED of them at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), HASHED):
        part = slice(low, low + HASHED)
        out[part] = _hash_some(padded, starts[part], ends[part])
    return out


def _hash_some(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = sizes.astype(np.uint64) * _ODD[3]
    at, live = starts, slice(None)
    left = sizes
    for _ in range(LONG // 8):
        mixed = (out[live] ^ (eights[at] & _FIRST[np.minimum(left, 8)])) * _ODD[0]
        out[live] = mixed ^ (mixed >> np.uint64(32))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(padded[starts[k] : ends[k]].tobytes())
    out *= _ODD[1]
    return out ^ (out >> np.uint64(29))


def hash_words(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return hash_spans(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)


_END = hash_words([b""])[0]


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts that lie back to back start and end, and how many come before each of the offsets."""
    word = ~blank(data)
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    cuts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[cuts], closes[lasts] = word[cuts], word[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << 5)


def token_hashes(data: np.ndarray, offsets: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that lie back to back, each with an end, and where texts start."""
    starts, ends, before = word_spans(data, offsets)
    found = hash_spans(lowered(data), starts, ends)
    if not end:
        return found, before[:-1]
    n = len(offsets) - 1
    out = np.full(len(found) + n, _END)
    out[np.arange(len(found)) + np.repeat(np.arange(n), np.diff(before))] = found
    return out, before[:-1] + np.arange(n)


def slotted(hashes: np.ndarray) -> np.ndarray:
    """A table that has most of the hashes at their upper bits."""
    out = np.zeros(1 << SLOT_BITS, np.uint64)
    out[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = hashes
    return out


@dataclass
class WordTable:
    """Ids of words by their hashes' upper bits; a slot has one word, the others have none here."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOT_BITS, np.uint64))
    ids: np.ndarray = field(default_factory=lambda: np.full(1 << SLOT_BITS, -1, np.int32))

    def put(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """Fill free slots, the last word that has one takes it."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = np.flatnonzero(self.ids.take(slot) < 0)
        self.hashes[slot[free]], self.ids[slot[free]] = hashes[free], ids[free]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' ids; -1 where the table doesn't have them."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.ids.take(slot)
        out[self.hashes.take(slot) != hashes] = -1
        return out

    def copy(self) -> WordTable:
        return WordTable(self.hashes.copy(), self.ids.copy())


def distinct_words(texts: pa.Array, groups: np.ndarray, piece: int, without: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased words of each group of texts, their groups, numbers and hashes; a few come more than once.

    Words of one group and one 64-bit hash are the same (within the text that is looked at together: COUNT_BYTES, or a piece of one longer text).
    Those that the table `without` has are left out.
    """
    for data, offsets, at in _parts(texts, COUNT_BYTES, piece):
        opens, closes, before = word_spans(data, offsets)
        opens, closes = opens.astype(np.int32), closes.astype(np.int32)
        of = np.repeat(groups[at].astype(np.int32), np.diff(before))
        data = lowered(data)
        for low in range(0, len(opens), COUNT_WORDS):
            part = slice(low, low + COUNT_WORDS)
            yield from _distinct(data, opens[part], closes[part], of[part], without)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, without: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    hashes = hash_spans(data, starts, ends)
    if without is not None:
        kept = np.flatnonzero(without.take((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)) != hashes)
        starts, ends, hashes, group = starts.take(kept), ends.take(kept), hashes.take(kept), group.take(kept)
        if not len(kept):
            return
    keys = group.astype(np.uint64)
    keys += np.uint64(1)
    keys *= _ODD[2]
    keys ^= hashes
    bits = np.uint64(len(keys).bit_length())
    ranked = keys >> bits
    ranked <<= bits
    ranked |= np.arange(len(keys), dtype=np.uint64)
    ranked.sort()
    ranked &= (np.uint64(1) << bits) - np.uint64(1)
    place = ranked.view(np.int64)
    keys = keys.take(place)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    del keys
    number = np.diff(first, append=len(place))
    place = place.take(first)
    starts, sizes = starts.take(place), (ends - starts).take(place)
    closes = np.cumsum(sizes)
    found = data.take(np.arange(closes[-1]) + np.repeat(starts - closes + sizes, sizes))
    words = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(np.append(0, closes)), pa.py_buffer(found)]).cast(pa.binary())
    yield words, group.take(place).astype(np.int64), number, hashes.take(place)


def context_hashes(hashes: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hash of each token's context: the words before it in its text."""
    n = len(hashes)
    inside = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    context = np.zeros(n, np.uint64)
    for back in CONTEXT_ORDERS:
        before = np.zeros(n, np.uint64)
        before[back:] = hashes[:-back]
        before[inside < back] = 0
        context = (context + before + np.uint64(back)) * _ODD[0]
        context ^= context >> np.uint64(29)
        out = context * _ODD[1]
        yield out ^ (out >> np.uint64(32))


def _slot_and_pair(context: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (context >> np.uint64(64 - SLOT_BITS)).astype(np.int64), context << np.uint64(WORD_BITS) | hashes >> np.uint64(64 - WORD_BITS)


def voted(pairs: np.ndarray, counts: np.ndarray, more: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two votes as one, slot by slot: equal pairs add up, of unlike ones the greater keeps the difference (of equal numbers none is held)."""
    same = pairs == more
    wins = others > counts
    return np.where(wins, more, pairs), np.where(same, counts + others, np.where(wins, others - counts, counts - others))


@dataclass
class Votes:
    """Pairs and numbers, by order and slot."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros((len(CONTEXT_ORDERS), SLOTS), np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((len(CONTEXT_ORDERS), SLOTS), np.uint32))

    def add(self, hashes: np.ndarray, starts: np.ndarray) -> None:
        """The tokens of some texts, at most 2**24 of them; a text votes once for a pair."""
        if not len(hashes):
            return
        text = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(hashes))))
        for k, context in enumerate(context_hashes(hashes, starts)):
            slot, pair = _slot_and_pair(context, hashes)
            keys = pair * _ODD[2]
            keys >>= np.uint64(_PLACE_BITS + SLOT_BITS)
            keys <<= np.uint64(_PLACE_BITS)
            keys |= slot.astype(np.uint64) << np.uint64(64 - SLOT_BITS)
            keys |= np.arange(len(pair), dtype=np.uint64)
            keys.sort()
            place = (keys & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            keys >>= np.uint64(_PLACE_BITS)
            votes = np.ones(len(keys), bool)
            np.not_equal(keys[1:], keys[:-1], out=votes[1:])
            first = np.flatnonzero(votes)
            of = text.take(place)
            votes[1:] |= of[1:] != of[:-1]
            so_far = np.cumsum(votes, dtype=np.int32)
            number = np.diff(so_far.take(first), append=so_far[-1] + 1)
            place = place.take(first)
            slots = slot.take(place)
            opens = np.ones(len(slots) + 1, bool)
            np.not_equal(slots[1:], slots[:-1], out=opens[1:-1])
            alone = opens[:-1] & opens[1:]
            at = np.flatnonzero(alone)
            self._take_in(k, slots.take(at), pair.take(place.take(at)), number.take(at))
            # The pair of a slot with most votes, less those of the next: in the order of slot, falling number, place.
            at = np.flatnonzero(~alone)
            if not len(at):
                continue
            slots, number, pair = slots.take(at), number.take(at), pair.take(place.take(at))
            ranked = np.sort((slots.astype(np.uint64) << np.uint64(64 - SLOT_BITS)) | (np.uint64((1 << 20) - 1) - np.minimum(number, (1 << 20) - 1).astype(np.uint64)) << np.uint64(_PLACE_BITS) | np.arange(len(at), dtype=np.uint64))
            at = (ranked & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            best = np.flatnonzero(np.append(True, np.diff(slots.take(at)) != 0))
            self._take_in(k, slots.take(at[best]), pair.take(at[best]), number.take(at[best]) - number.take(at[best + 1]))

    def _take_in(self, k: int, slot: np.ndarray, pair: np.ndarray, number: np.ndarray) -> None:
        self.pairs[k, slot], self.counts[k, slot] = voted(self.pairs[k].take(slot), self.counts[k].take(slot), pair, number.astype(np.uint32))


@dataclass
class Contexts:
    """The votes of all training texts, numbers up to 255."""

    pairs: np.ndarray
    counts: np.ndarray

    def said(self, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By order the word's hash bits that each token's context is held with, and the number; 0 where it isn't held."""
        mask = np.uint64((1 << WORD_BITS) - 1)
        for k, context in enumerate(context_hashes(hashes, starts)):
            slot, pair = _slot_and_pair(context, hashes)
            held = self.pairs[k][slot]
            yield (held & mask).astype(np.int64), np.where((held ^ pair) & ~mask == 0, self.counts[k][slot], np.uint8(0))


def _blank_from(data: np.ndarray, at: int, stop: int) -> int:
    """Where the first blank from `at` on is, `stop` if there is none before it."""
    for low in range(at, stop, 1 << 16):
        found = np.flatnonzero(blank(data[low : min(low + (1 << 16), stop)]))
        if len(found):
            return low + int(found[0])
    return stop


def _parts(texts: pa.Array, limit: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of `limit` bytes at a time, or pieces of one longer text: bytes, offsets and which texts they are of."""
    whole, offsets = byte_view(texts)
    start = 0
    while start < len(texts):
        stop = max(int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1, start + 1)
        low, high = int(offsets[start]), int(offsets[stop])
        if high - low > max(limit, piece):
            while high - low > piece:
                cut = _blank_from(whole, low + piece, high)
                yield whole[low:cut], np.array([0, cut - low]), np.array([start])
                low = cut
        yield whole[low:high], np.append(low, offsets[start + 1 : stop + 1]) - low, np.arange(start, stop)
        start = stop


def _add_texts(votes: Votes, texts: pa.Array, piece: int) -> None:
    """Contexts don't reach from one piece of a long text into the next, and a piece before the last has no end."""
    last = None
    for data, offsets, at in _parts(texts, BLOCK_BYTES, piece):
        if last is not None:
            votes.add(*token_hashes(*last[:2], end=last[2][-1] != at[0]))
        last = data, offsets, at
    if last is not None:
        votes.add(*token_hashes(*last[:2]))


def _row(part: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pairs.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "pairs", "counts"])


def _vote(piece: int):
    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes()
        for batch in batches:
            _add_texts(votes, batch.column(0), piece)
        for part in range(len(CONTEXT_ORDERS) * SLOTS // CHUNK):
            k, chunk = divmod(part, SLOTS // CHUNK)
            at = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
            if votes.counts[k, at].any():
                yield _row(part, votes.pairs[k, at], votes.counts[k, at])

    return vote


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's votes as one; they come sorted by part."""
    now, pairs, counts = None, None, None
    for batch in batches:
        for part, more, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more, others = np.frombuffer(more, np.uint64), np.frombuffer(others, np.uint32)
            if part == now:
                pairs, counts = voted(pairs, counts, more, others)
                continue
            if now is not None:
                yield _row(now, pairs, np.minimum(counts, 255).astype(np.uint8))
            now, pairs, counts = part, more, others
    if now is not None:
        yield _row(now, pairs, np.minimum(counts, 255).astype(np.uint8))


def learn_contexts(training: DataFrame, total: int, piece: int) -> Contexts:
    """Votes of all texts of `training` (column text, `total` bytes about).

    A task votes on TASK_BYTES of text or more, so that tables are a share of the input on disk; the driver receives one table of each order.
    """
    schema = "part int, pairs binary, counts binary"
    texts = training.select("text").coalesce(max(1, -(-total // TASK_BYTES)))
    parts = texts.mapInArrow(_vote(piece), schema).repartition(F.col("part")).sortWithinPartitions("part", "pairs", "counts").mapInArrow(_merge, schema)
    out = Contexts(np.zeros((len(CONTEXT_ORDERS), SLOTS), np.uint64), np.zeros((len(CONTEXT_ORDERS), SLOTS), np.uint8))
    for row in parts.toLocalIterator():
        k, chunk = divmod(row["part"], SLOTS // CHUNK)
        at = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        out.pairs[k, at], out.counts[k, at] = np.frombuffer(row["pairs"], np.uint64), np.frombuffer(row["counts"], np.uint8)
    return out
