"""Spelling variant grouping: Bloom-guided neighbourhoods of a corpus' vocabulary.

Words are counted over all texts. The vocabulary goes into blocked Bloom filters (BITS_A_WORD bits a word,
PROBES bits of one 512-bit block each), one for every word length; their total is cut by hash into
passes of at most PASS_BITS, so what a pass broadcasts is bounded at any size of the vocabulary. Every
word generates its deletions and those replacements that raise a code point (insertions and the other
replacements are the same pairs seen from the other word) and probes the filter of the length that results.
Edits are hashed without being written out: a word's hash is a sum over its places. Only positives become
text and shuffle, to a join with the vocabulary, which removes false ones. Each pair of near words
is met by exactly one edit of one of the two.

Forms are chosen by an aggregate, roots by pointer jumping: n at least doubles along forms, so chains are
shorter than 64 words and seven rounds suffice. A word has at most some 90 near words for each place, which
bounds every group of the joins and aggregates.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, checkpointed, ids_and_texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: What a run can hold once A-Z are lower-cased.
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint64)
#: One run of SLIPS loses a code point, by crc32.
SLIPS = 97
BITS_A_WORD = 16
PROBES = 7
BLOCK_BITS = 512
#: Of the filters that one pass broadcasts; a power of two, 16 MB.
PASS_BITS = 1 << 27
#: Counts that a task holds before it gives them to the shuffle: distinct words, and their bytes.
COUNTS_HELD, BYTES_HELD = 400_000, 32 << 20
#: Edits that are hashed at a time.
EDITS_HELD = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The share of a code point at a place in a word's hash."""
    return _mixed(place.astype(np.uint64) * _ODD + code.astype(np.uint64))


def slipped(doc_id: str, run: str) -> str:
    """The lower-cased run, without one code point where the crc32 of `<doc_id>:<run>` is a multiple of SLIPS."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counting(least: int):
    """(doc_id as text, text) to (word, n): counts of a task's part, given out whenever enough are held."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            size = 0
            return out

        for block in blocks(batches, 4 << 20):
            for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                own = Counter(RUN.findall(text.translate(_LOWER)))
                before = len(counts)
                for run, n in own.items():
                    word = slipped(doc, run)
                    if len(word) >= least:
                        counts[word] += n
                        size += len(word) if len(word) > 64 else 0
                size += 64 * (len(counts) - before)
                if len(counts) >= COUNTS_HELD or size >= BYTES_HELD:
                    yield flush()
        if counts:
            yield flush()

    return count


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences, over all texts."""
    texts = ids_and_texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(_counting(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // length)  # of long words few at a time
        for at in range(0, len(rows), step):
            yield length, rows[at : at + step]


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, rows in _by_length(words):
        out[rows] = _placed(np.arange(length), _codes([words[i] for i in rows], length)).sum(1)
    return out


class Filters:
    """Blocked Bloom filters by word length, of the words whose hash falls into one part of `parts`."""

    def __init__(self, sizes: dict[int, int], parts: int, part: int):
        self.parts, self.part = parts, part
        self.lengths = {n: i for i, n in enumerate(sorted(sizes))}
        blocks_ = np.array([-(-sizes[n] * BITS_A_WORD // (BLOCK_BITS * parts)) + 1 for n in sorted(sizes)], np.uint64)
        self.blocks = blocks_
        self.start = np.concatenate([[0], np.cumsum(blocks_)]).astype(np.uint64)
        self.n_bits = int(self.start[-1]) * BLOCK_BITS
        self.bits: np.ndarray | None = None

    def _spots(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of this part, by place in `hashes`, and their bits, PROBES a row."""
        h = _mixed(hashes)
        mine = np.flatnonzero(h % np.uint64(self.parts) == self.part) if self.parts > 1 else np.arange(len(h))
        h = h[mine]
        shard = self.lengths[length]
        block = self.start[shard] + ((h >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32))
        low = _mixed(h + _ODD)
        bit = np.stack([(low >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1) for k in range(PROBES)], axis=1)
        return mine, block[:, None] * np.uint64(BLOCK_BITS) + bit

    def spots(self, words: list[str]) -> np.ndarray:
        """Distinct bits that the words of this part set."""
        hashes = word_hashes(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = [self._spots(hashes[lengths == n], n)[1].ravel() for n in np.unique(lengths).tolist()]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def has(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that may be words of the length."""
        if length not in self.lengths:
            return np.zeros(0, np.int64)
        mine, spots = self._spots(hashes, length)
        hit = np.ones(len(mine), bool)
        for k in range(PROBES):
            left = np.flatnonzero(hit)
            at = spots[left, k]
            hit[left] = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return mine[hit]


def _regions(filters: Filters, region_bits: int):
    """Words to (region, bits as bytes): a task's part of each region of the bit field that it sets bits in."""

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = filters.spots(batch.column(0).to_pylist())
            edges = np.searchsorted(spots, np.arange(0, filters.n_bits + region_bits, region_bits, dtype=np.uint64))
            for region in np.flatnonzero(np.diff(edges)).tolist():
                own = spots[edges[region] : edges[region + 1]] - np.uint64(region * region_bits)
                yield pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), pa.array([own.astype(np.uint32).tobytes()], pa.binary())], ["region", "spots"])

    return fill


def _merged(region_bits: int):
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by region to one row each."""
        now, bits = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["region", "bits"])
        for batch in batches:
            for region, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if region != now:
                    if now is not None:
                        yield done()
                    now, bits = region, np.zeros(region_bits, np.uint8)
                bits[np.frombuffer(spots, np.uint32)] = 1
        if now is not None:
            yield done()

    return merge


def _filled(words: DataFrame, filters: Filters, region_bits: int = 1 << 23) -> Filters:
    """The filters with the words' bits: regions are merged in tasks and read out one after the other."""
    regions = words.select("word").mapInArrow(_regions(filters, region_bits), "region int, spots binary")
    merged = regions.repartition("region").sortWithinPartitions("region").mapInArrow(_merged(region_bits), "region int, bits binary")
    bits = np.zeros(-(-filters.n_bits // region_bits) * region_bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # n_bits in all: PASS_BITS and a block for each length
        bits[row["region"] * region_bits // 8 : (row["region"] + 1) * region_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    filters.bits = bits[: -(-filters.n_bits // 8)]
    return filters


def _probing(broadcast):
    """Words to (edit, word, n): those edits of theirs that the filters know."""

    def edits(words: list[str], length: int, filters: Filters) -> Iterator[tuple[int, str]]:
        codes = _codes(words, length)
        places = np.arange(length)
        own = _placed(places, codes)
        total = own.sum(1)
        if length - 1 in filters.lengths:
            # Of equal neighbours the last one goes: each shorter word comes up once.
            moved = np.zeros_like(own)
            moved[:, 1:] = _placed(places[:-1], codes[:, 1:])
            after = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1]
            before = np.cumsum(own, axis=1)
            left = before - own
            right = np.zeros_like(own)
            right[:, :-1] = after[:, 1:]
            lasts = np.ones(codes.shape, bool)
            lasts[:, :-1] = codes[:, :-1] != codes[:, 1:]
            row, place = np.nonzero(lasts)
            for k in filters.has((left + right)[row, place], length - 1):
                word, at = words[row[k]], place[k]
                yield row[k], word[:at] + word[at + 1 :]
        for at in range(length):
            rest = total - own[:, at]
            higher = _placed(np.full(len(ALPHABET), at), ALPHABET)
            row, letter = np.nonzero(ALPHABET[None, :] > codes[:, at][:, None])
            for k in filters.has(rest[row] + higher[letter], length):
                word = words[row[k]]
                yield row[k], word[:at] + chr(int(ALPHABET[letter[k]])) + word[at + 1 :]

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = broadcast.value
        names = ["edit", "word", "n"]
        for batch in batches:
            words, many = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length, rows in _by_length(words):
                step = max(1, EDITS_HELD // (len(ALPHABET) * min(length, 64)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    found: list[tuple[str, str, int]] = []
                    size = 0
                    for row, edit in edits([words[i] for i in part], length, filters):
                        i = part[row]
                        found.append((edit, words[i], many[i]))
                        size += 2 * length
                        if size >= BYTES_HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)

    return probe


def near_pairs(words: DataFrame, pass_bits: int = PASS_BITS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    spark = words.sparkSession
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}  # a row for each length of a word
    passes = max(1, -(-sum(sizes.values()) * BITS_A_WORD // pass_bits))
    found = []
    for part in range(passes):
        filters = _filled(words, Filters(sizes, passes, part))
        found.append(words.select("word", "n").mapInArrow(_probing(spark.sparkContext.broadcast(filters)), "edit string, word string, n long"))
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    return positives.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), F.col("edit_n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following the forms ends."""
    at = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, pass_bits: int = PASS_BITS) -> DataFrame:
    """The words of the documents, with the more frequent form that each may be a misspelling of.

    Returns word, n, n_near (words that differ by one inserted, deleted or replaced code point), form (the near word of
    largest n, ties by code points, if that n is at least twice the word's; else null), form_n, and root (where
    following forms ends; the word itself without one). Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF
    with A-Z lower-cased, of at least least_length code points and least_n occurrences. A null text has no words, a null
    doc_id counts as the empty text in the crc32; rows that repeat are counted again; an empty table gives
    no rows; other columns are ignored.
    """
    words = checkpointed(vocabulary(docs, least_length, least_n))
    pairs = near_pairs(words, pass_bits)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    both = pairs.select(F.explode(ends).alias("e")).select("e.*")
    # min of (-n, word) is the largest n, then the first in code-point order.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
    joined = words.join(best, "word", "left")
    enough = -F.col("b.less") >= 2 * F.col("n")
    formed = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")))
    rooted = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
