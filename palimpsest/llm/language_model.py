"""LM scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and an end. Bits of the words' codes are
predicted by several hashed contexts and mixed while the texts are scored (see
context_mixing); the spelling of words that no training text has is predicted bit by bit
as well, from the last 1 to 4 bytes of the word (SpellingModel).

All words of the training texts are counted, once for each word and input task, and all
vote for what their contexts predict (word_contexts). Texts go to blocks by a hash of their
content: the least hash of their 16-byte windows, so copies and near copies meet and predict
each other; a hash that very many texts share has blocks by document id as well. Frequent words (HOT_WORDS at most) and the
code tree reach every task; the other words' counts are sent to the blocks that have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context_mixing import CLASS_BITS, HASH_BITS, SIZE_BITS, CodeTree, Tokens, token_logs
from .textblocks import blocks as blocks_of
from .textblocks import byte_view, kept_on_disk, until_result_ends
from .word_contexts import Contexts, WordTable, distinct_words, hash_spans, hash_words, learn_contexts, lowered, slotted, word_spans

FOLDS = 7
HELD_OUT = 2
#: Text of a block, about; texts are read in pieces of at most so many bytes, and contexts don't reach from one piece into the next.
BLOCK_BYTES = 1 << 22
PIECE_BYTES = 1 << 21
#: Text whose words are looked up together.
TEXT_BYTES = 1 << 20
#: Tokens that are scored together, about.
TOKENS = 1 << 19
#: Every task knows the most frequent words, at most so many.
HOT_WORDS = 1 << 18
#: Content hashes with at least one of so many bytes (and more than a block) get several blocks.
HOT_KEYS = 1 << 16
WINDOW = 16

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 19
#: Slots of a row: small, so that an Arrow batch of so many rows as there may be is bounded, however many tasks count.
CHUNK = 1 << 10
#: Distinct grams of a task that counts or learns them, about.
TASK_GRAMS = 1 << 15
_START, _SYMBOLS = 256, 257
_SPACE = b" \t\n\x0b\x0c\r"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo FOLDS, is HELD_OUT; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in pieces of about PIECE_BYTES; one piece at least."""
    data = text.encode()
    low = 0
    while len(data) - low > PIECE_BYTES:
        cut = low + PIECE_BYTES
        while cut < len(data) and data[cut] not in _SPACE:
            cut += 1
        yield data[low:cut].lower().split()
        low = cut
    yield data[low:].lower().split()


# Spellings


def gram_slices(words: list[bytes], size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of words, so many at a time whatever the words' lengths, and the word of each.

    For each byte of each word and for the blank after it one number: the last bytes before it in its word (_START before the word), then the byte.
    """
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    for low in range(0, len(data), size):
        at = np.arange(low, min(low + size, len(data)))
        word = np.searchsorted(starts, at, side="right") - 1
        inside = at - starts[word]
        out = np.zeros(len(at), np.int64)
        for back in range(max(ORDERS), 0, -1):
            before = np.where(inside < back, _START, data[np.maximum(at - back, 0)].astype(np.int64))
            out = out * _SYMBOLS + before
        yield out * 256 + data[at], word


def grams(words: list[bytes]) -> np.ndarray:
    return np.concatenate([found for found, _ in gram_slices(words)])


def _slot(context: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    x = (context * np.uint64(256) + node) * _ODD[k]
    x ^= x >> np.uint64(29)
    return (x * _ODD[0] >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


@dataclass
class SpellingModel:
    """Count tables (order, bit value, slot), mixing weights (gate, input) and the adaptive map (gate, bucket)."""

    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(ORDERS), 2, SLOTS), np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([np.full((len(ORDERS) + 1, len(ORDERS)), 0.3), np.zeros((len(ORDERS) + 1, len(ORDERS) + 1))], axis=1))
    refined: np.ndarray = field(default_factory=lambda: np.tile(_squash(np.linspace(-8, 8, SpellingModel.BUCKETS)), (len(ORDERS) + 1, 1)))

    BUCKETS = 33

    def inputs(self, slots: list[np.ndarray], taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions that the bit is one, and the gate: the longest context that has been seen; taken: bits that are taken out of the counts, once each."""
        x = np.zeros((len(slots[0]), 2 * len(ORDERS) + 1), np.float32)
        x[:, -1] = 0.3
        gate = np.zeros(len(x), np.int64)
        for k, slot in enumerate(slots):
            zeros, ones = self.tables[k, 0][slot].astype(np.float32), self.tables[k, 1][slot].astype(np.float32)
            if taken is not None:
                zeros, ones = np.maximum(zeros - ~taken, 0), np.maximum(ones - taken, 0)
            n = zeros + ones
            one, zero = ones + np.float32(0.2), zeros + np.float32(0.2)
            x[:, k] = np.log(one / zero)  # of the counts: the probability is 1 in single precision from some millions on
            x[:, len(ORDERS) + k] = np.where(n > 0, (one / (one + zero) - 0.5) * np.log2(n + 1), 0)
            gate = np.where(n > 0, k + 1, gate)
        return x, gate

    def _bits(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """The eight bits of each gram's byte, and the slots that predict them."""
        data = found % 256
        contexts = [(found // 256 % _SYMBOLS**order).astype(np.uint64) for order in ORDERS]
        for bit in range(8):
            node = ((1 << bit) | (data >> (8 - bit))).astype(np.uint64)
            yield (data >> (7 - bit) & 1).astype(bool), [_slot(c, node, k) for k, c in enumerate(contexts)]

    def count(self, found: np.ndarray, times: np.ndarray) -> None:
        for one, slots in self._bits(found):
            for k, slot in enumerate(slots):
                np.add.at(self.tables[k, 0], slot[~one], times[~one].astype(np.uint32))
                np.add.at(self.tables[k, 1], slot[one], times[one].astype(np.uint32))

    def learn(self, found: np.ndarray, times: np.ndarray, passes: int = 4, rate: float = 0.02, size: int = 512) -> None:
        """Learn weights and map online: a batch's bits are predicted from the other words' counts, then their errors change the weights; the map has the means of the last pass."""
        gates = len(self.weights)
        seen = np.full(self.refined.size, 16.0)
        came = self.refined.ravel() * seen
        for turn in range(passes):
            for low in range(0, len(found), size):
                often = times[low : low + size].astype(np.float64)
                for one, slots in self._bits(found[low : low + size]):
                    x, gate = self.inputs(slots, one)
                    z = np.clip((x * self.weights[gate]).sum(axis=1), -8, 8)
                    error = (one - _squash(z)) * often
                    step = rate * gates / max(often.sum(), 1)
                    for k in range(x.shape[1]):
                        self.weights[:, k] += step * np.bincount(gate, error * x[:, k], gates)
                    if turn == passes - 1:
                        cell = gate * self.BUCKETS + np.rint((z + 8) * 2).astype(np.int64)
                        seen += np.bincount(cell, often, len(seen))
                        came += np.bincount(cell, one * often, len(seen))
        self.refined = (came / seen).reshape(self.refined.shape)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's spelling with its blank."""
        if not words:
            return np.zeros(0)
        out = np.zeros(len(words))
        for part, word in gram_slices(words):
            found, at = np.unique(part, return_inverse=True)
            out[word[0] : word[-1] + 1] += np.bincount(word - word[0], self._log10_of(found)[at])
        return out

    def _log10_of(self, found: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after the bytes before it."""
        total = np.zeros(len(found))
        for one, slots in self._bits(found):
            x, gate = self.inputs(slots)
            z = np.clip((x * self.weights[gate]).sum(axis=1), -8, 8)
            near = np.clip((z + 8) * 2, 0, self.BUCKETS - 1.001)
            low = near.astype(np.int64)
            share = near - low
            p = 0.5 * (_squash(z) + self.refined[gate, low] * (1 - share) + self.refined[gate, low + 1] * share)
            p = np.clip(p, 1e-5, 1 - 1e-5)
            total += np.log10(np.where(one, p, 1 - p))
        return total


def _word_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w for w in batch.column(0).to_pylist() if w]
        for part, _ in gram_slices(words) if words else ():
            found, times = np.unique(part, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["gram", "n"])


def _part(part: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["part", "data"])


def _count_spellings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams to this task's tables, in chunks without the empty ones."""
    model = SpellingModel()
    for batch in batches:
        model.count(*map(np.asarray, batch.columns))
    for part in range(len(ORDERS) * SLOTS // CHUNK):
        k, chunk = divmod(part, SLOTS // CHUNK)
        counts = np.ascontiguousarray(model.tables[k, :, chunk * CHUNK : (chunk + 1) * CHUNK])
        if counts.any():
            yield _part(part, counts)


def _add_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each part's rows, which come sorted by part."""
    now, total = None, None
    for batch in batches:
        for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(data, np.uint32)
            if part == now:
                total = total + values
                continue
            if now is not None:
                yield _part(now, total)
            now, total = part, values
    if now is not None:
        yield _part(now, total)


def _learn_weights(shared) -> Callable:
    """Grams to one row: this task's weights and map, times the number of its grams."""

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[np.asarray(c) for c in batch.columns] for batch in batches]
        if columns:
            found, times = (np.concatenate(x) for x in zip(*columns, strict=True))
            model = SpellingModel(shared.value)
            model.learn(found, times)
            yield pa.RecordBatch.from_arrays([pa.array([(len(found) * np.concatenate([[1.0], model.weights.ravel(), model.refined.ravel()])).tolist()], pa.list_(pa.float64()))], ["sums"])

    return learn


def learn_spellings(words: DataFrame) -> SpellingModel:
    """A model of the words' spellings: all words are counted, then weights and map are learned online in every task and averaged.

    Words go in as their distinct grams with how many words have them. The driver receives the
    tables, and the weights of all tasks added up.
    """
    model = SpellingModel()
    spelled = kept_on_disk(words.select("word").mapInArrow(_word_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    few = spelled.coalesce(max(1, -(-spelled.count() // TASK_GRAMS)))
    parts = few.mapInArrow(_count_spellings, "part int, data binary").repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(_add_parts, "part int, data binary")
    for row in parts.toLocalIterator():
        k, chunk = divmod(row["part"], SLOTS // CHUNK)
        model.tables[k, :, chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(row["data"], np.uint32).reshape(2, CHUNK)
    tables = words.sparkSession.sparkContext.broadcast(model.tables)
    dealt = few.sortWithinPartitions(F.xxhash64("gram"))  # similar grams must not come one after another
    learned = dealt.mapInArrow(_learn_weights(tables), "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum")).orderBy("pos").collect()
    if learned:
        values = np.array([r["sum"] for r in learned[1:]]) / learned[0]["sum"]
        model.weights = values[: model.weights.size].reshape(model.weights.shape)
        model.refined = values[model.weights.size :].reshape(model.refined.shape)
    spelled.unpersist()
    return model


# Blocks


def content_key(data: np.ndarray) -> int:
    """The least hash of the 16-byte windows of a text, of the text itself where it is shorter; as a signed 64-bit number."""
    if len(data) < WINDOW:
        return xxhash.xxh64_intdigest(data.tobytes()) - (1 << 63)
    least = None
    for low in range(0, len(data) - WINDOW + 1, 1 << 20):
        part = data[low : low + (1 << 20) + WINDOW - 1]
        n = len(part) - WINDOW + 1
        first, second = (np.ndarray((n,), "<u8", part, at, (1,)) for at in (0, 8))
        mixed = first * _ODD[0]
        mixed += second
        mixed *= _ODD[1]  # its upper bits, which the least one is found by, depend on all 16 bytes
        found = int(mixed.min())
        least = found if least is None else min(least, found)
    return xxhash.xxh64_intdigest(least.to_bytes(8, "little")) - (1 << 63)


def _keys(texts: pa.Array) -> np.ndarray:
    data, offsets = byte_view(texts)
    return np.array([content_key(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def _key_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(byte_view(batch.column(0))[1])
        yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0))), pa.array(sizes.astype(np.int64))], ["key", "bytes"])


@dataclass
class Placement:
    """Which block a text goes to: `blocks` blocks by its content hash; hot hashes have `hot[key] = (first, number)` of their own, dealt by document id."""

    blocks: int
    hot: dict[int, tuple[int, int]]

    def of(self, keys: np.ndarray, ids: list[int | None]) -> np.ndarray:
        out = (keys.view(np.uint64) % np.uint64(self.blocks)).astype(np.int64)
        if self.hot:
            for k, key in enumerate(keys.tolist()):
                if key in self.hot:
                    first, number = self.hot[key]
                    out[k] = first + xxhash.xxh64_intdigest(str(k if ids[k] is None else ids[k])) % number
        return out


def place_texts(texts: DataFrame, total: int) -> Placement:
    blocks = max(1, -(-total // BLOCK_BYTES))
    sizes = texts.select("text").mapInArrow(_key_bytes, "key long, bytes long").groupBy("key").agg(F.sum("bytes").alias("bytes"))
    hot, first = {}, blocks
    for row in sizes.where(F.col("bytes") > max(BLOCK_BYTES, total // HOT_KEYS)).orderBy("key").collect():
        number = -(-row["bytes"] // BLOCK_BYTES)
        hot[row["key"]] = (first, number)
        first += number
    return Placement(blocks, hot)


# Words


def _count_words(languages: list[str]) -> Callable:
    """(lang, text) of training texts to (word, class, n) of each batch; the end is the empty word."""
    place = {x: k for k, x in enumerate(languages)}
    rest = len(place)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array([place.get(lang, rest) for lang in batch.column(0).to_pylist()], np.int64)
            for words, kind, number, _ in distinct_words(batch.column(1), kinds, PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([words, pa.array(kind.astype(np.int32)), pa.array(number)], ["word", "class", "n"])
            kinds, number = np.unique(kinds, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([b""] * len(kinds), pa.binary()), pa.array(kinds.astype(np.int32)), pa.array(number)], ["word", "class", "n"])

    return count


def count_words(training: DataFrame) -> DataFrame:
    """(word, c, code) of all training texts (lang, text)."""
    most = (1 << CLASS_BITS) - 1
    known = training.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in known.orderBy(F.desc("n"), "lang").limit(most).collect())
    counted = training.select("lang", "text").mapInArrow(_count_words(languages), "word binary, class int, n long")
    by_class = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages) + 1)]
    words = counted.groupBy("word").agg(F.sum("n").alias("c"), *by_class)
    sums = F.array(*(F.col(f"n{k}") for k in range(len(by_class))))
    kind = F.array_position(sums, F.array_max(sums)) - 1
    size = F.least(F.floor((F.length(F.bin("c")) - 1) / 2).cast("int"), F.lit((1 << SIZE_BITS) - 1))
    code = F.shiftleft(kind, SIZE_BITS + HASH_BITS) + F.shiftleft(size, HASH_BITS) + F.xxhash64("word").bitwiseAND((1 << HASH_BITS) - 1)
    return words.select("word", "c", code.cast("int").alias("code"))


@dataclass
class Shared:
    """What every task has: the corpus's sums, its code cells, frequent words with counts and codes, and the spelling model; all of bounded size."""

    tokens: int
    distinct: int
    once: int
    cells: np.ndarray
    cell_counts: np.ndarray
    words: list[bytes]
    counts: np.ndarray
    codes: np.ndarray
    spelling: SpellingModel
    contexts: Contexts | None = None

    @property
    def escape(self) -> float:
        return min(max((self.once + 1) / (self.tokens + 2), 1e-6), 0.5)

    def tree(self) -> CodeTree:
        if "_tree" not in self.__dict__:
            self._tree = CodeTree.of_cells(self.cells, self.cell_counts)
        return self._tree

    def index(self) -> dict[bytes, int]:
        if "_index" not in self.__dict__:
            self._index = {w: k for k, w in enumerate(self.words)}
        return self._index

    def hashes(self) -> np.ndarray:
        if "_hashes" not in self.__dict__:
            self._hashes = hash_words(self.words)
        return self._hashes

    def table(self) -> WordTable:
        if "_table" not in self.__dict__:
            self._table = WordTable()
            by_count = np.argsort(self.counts, kind="stable")
            self._table.put(self.hashes()[by_count], by_count)
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def share_model(words: DataFrame, contexts: Contexts | None = None) -> Shared:
    row = words.agg(F.sum("c"), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    tokens, distinct, once = (x or 0 for x in row)
    cells = words.groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    # Sizes of counts, the largest first, as long as they have HOT_WORDS words at most.
    size = F.length(F.bin("c"))
    least, taken = 65, 0
    for k, n in sorted(words.groupBy(size).count().collect(), reverse=True):
        taken += n
        if taken > HOT_WORDS:
            break
        least = k
    hot = words.where(size >= least).toArrow()
    by_word = np.argsort(np.array(hot["word"].to_pylist(), object)) if hot.num_rows else np.zeros(0, np.int64)
    hot = hot.take(pa.array(by_word))
    return Shared(tokens, distinct, once, np.asarray(cells["code"]), np.asarray(cells["c"]).astype(np.float64), hot["word"].to_pylist(), np.asarray(hot["c"]).astype(np.float64), np.asarray(hot["code"]).astype(np.int64), learn_spellings(words), contexts)


def _not_among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known.take(np.searchsorted(known, hashes), mode="clip") != hashes if len(known) else np.ones(len(hashes), bool)


def _wanted(placement: Placement, shared) -> Callable:
    """(doc_id, text) to the words that each block needs the counts of."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(shared.value.hashes())
        most = slotted(known)
        end = hash_words([b""])
        for batch in batches:
            blocks = placement.of(_keys(batch.column(1)), batch.column(0).to_pylist())
            for words, block, _, hashes in distinct_words(batch.column(1), blocks, PIECE_BYTES, most):
                asked = _not_among(hashes, known)
                yield pa.RecordBatch.from_arrays([pa.array(block[asked]), words.filter(pa.array(asked))], ["block", "word"])
            if _not_among(end, known)[0]:
                blocks = np.unique(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([b""] * len(blocks), pa.binary())], ["block", "word"])

    return find


def _placed(placement: Placement) -> Callable:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(placement.of(keys, batch.column(0).to_pylist())), pa.array(keys), *batch.columns], ["block", "key", "doc_id", "held", "text"])

    return place


# Scores


class _Index(dict):
    """Ids of words beside those that every task knows; one that is asked for and isn't there gets the next."""

    def __init__(self, everywhere: dict[bytes, int]):
        super().__init__()
        self.everywhere = everywhere

    def __missing__(self, word: bytes) -> int:
        k = self.everywhere.get(word)
        if k is None:
            self[word] = k = len(self.everywhere) + len(self)
        return k


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


class BlockScorer:
    """Scores of one block's texts: first its words are told, then its texts come in order.

    Words are found by their 64-bit hashes where the table of words has them, else by their bytes.
    """

    def __init__(self, shared: Shared):
        self.shared = shared
        self.index = _Index(shared.index())
        self.table = shared.table().copy()
        self.counts, self.codes, self.hashes = [shared.counts], [shared.codes], [shared.hashes()]
        self.told, self.spelled = 0, []
        self.ids, self.starts, self.sizes, self.train = [], [], 0, []
        self.of_piece: list[int] = []
        self.texts: list[list] = []

    def tell(self, words: list[bytes], counts: np.ndarray, codes: np.ndarray) -> None:
        place = dict(zip(words, range(len(words)), strict=True))  # two input tasks may have asked for a word
        fresh = [w for w in place if w not in self.index and w not in self.index.everywhere]
        first = len(self.index.everywhere) + self.told
        ids = range(first, first + len(fresh))
        self.index.update(zip(fresh, ids, strict=True))
        new = list(map(place.__getitem__, fresh))
        self.counts.append(counts[new].astype(np.float64))
        self.codes.append(codes[new].astype(np.int64))
        self.hashes.append(hash_words(fresh))
        self.table.put(self.hashes[-1], np.array(ids, np.int32))
        self.told += len(new)

    def add_texts(self, doc_ids: list[int | None], held: list[bool], texts: pa.Array) -> None:
        """Texts of PIECE_BYTES together at most, or one longer one."""
        data, offsets = byte_view(texts)
        if len(data) > PIECE_BYTES:
            for k in range(len(texts)):
                self.add(doc_ids[k], held[k], data[offsets[k] : offsets[k + 1]].tobytes().decode())
            return
        ids, starts = self._ids_of(data, offsets)
        bytes_of, stops = np.diff(offsets).tolist(), np.append(starts[1:], len(ids))
        row = 0
        while row < len(starts):
            first = starts[row]
            # Up to the text with which there are TOKENS tokens.
            stop = min(row + int(np.searchsorted(stops[row:] - first, TOKENS - self.sizes)) + 1, len(starts))
            self.of_piece.extend(range(len(self.texts), len(self.texts) + stop - row))
            self.texts.extend([i, h, 0, 0, 0.0, 0.0, size] for i, h, size in zip(doc_ids[row:stop], held[row:stop], bytes_of[row:stop], strict=True))
            self.ids.append(ids[first : stops[stop - 1]])
            self.starts.extend((starts[row:stop] + (self.sizes - first)).tolist())
            self.train.extend(not h for h in held[row:stop])
            self.sizes += len(self.ids[-1])
            if self.sizes >= TOKENS:
                self._score()
            row = stop

    def _ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lower-cased words of texts that lie back to back, each with its end, and where texts start."""
        opens, closes, before = word_spans(data, offsets)
        data = lowered(data)
        found = self.table.find(hash_spans(data, opens, closes)).astype(np.int64)
        others = np.flatnonzero(found < 0)
        if len(others):
            whole = data.tobytes()
            found[others] = [self.index[whole[a:b]] for a, b in zip(opens[others].tolist(), closes[others].tolist(), strict=True)]
        texts = np.arange(len(offsets) - 1)
        out = np.full(len(found) + len(texts), self.index[b""])
        out[np.arange(len(found)) + np.repeat(texts, np.diff(before))] = found
        return out, before[:-1] + texts

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        """A text of any length, in pieces."""
        get = self.index.__getitem__
        self.texts.append([doc_id, held, 0, 0, 0.0, 0.0, len(text.encode())])
        parts = pieces(text)
        words = next(parts)
        while words is not None:
            following = next(parts, None)
            ids = list(map(get, words))
            if following is None:
                ids.append(get(b""))
            if ids:
                self.ids.append(np.array(ids, np.int64))
                self.starts.append(self.sizes)
                self.sizes += len(ids)
                self.train.append(not held)
                self.of_piece.append(len(self.texts) - 1)
            if self.sizes >= TOKENS:
                self._score()
            words = following

    def _score(self) -> None:
        if not self.ids:
            return
        shared = self.shared
        new = list(islice(self.index, self.told + sum(map(len, self.spelled)), None))
        self.spelled.append(shared.spelling.log10(new))
        self.hashes.append(hash_words(new))
        unknown = sum(map(len, self.spelled))
        counts = np.concatenate([*self.counts, np.zeros(unknown)])
        codes = np.concatenate([*self.codes, np.full(unknown, -1)])
        spelled = np.concatenate([np.zeros(len(counts) - unknown), *self.spelled])
        hashes = np.concatenate(self.hashes) if shared.contexts is not None else None
        tokens = Tokens(np.concatenate(self.ids), np.array(self.starts), np.array(self.train), codes, counts, spelled, hashes, shared.contexts)
        logs = token_logs(shared.tree(), tokens, shared.escape)
        c = counts[tokens.ids]
        base = np.log10((c + 1) / (shared.tokens + shared.distinct + 1))
        sums = [np.add.reduceat(x, tokens.starts) for x in ((c > 0).astype(np.int64), base, logs)]
        lengths = np.diff(np.append(tokens.starts, len(tokens.ids)))
        for k, text in enumerate(self.of_piece):
            row = self.texts[text]
            row[2] += int(lengths[k])
            row[3] += int(sums[0][k])
            row[4] += float(sums[1][k])
            row[5] += float(sums[2][k])
        self.ids, self.starts, self.sizes, self.train, self.of_piece = [], [], 0, [], []

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Scores of the texts so far."""
        self._score()
        rows = [(i, held, n, known, self.shared.tokens, base, total, -total * np.log2(10) / max(size, 1)) for i, held, n, known, base, total, size in self.texts]
        self.texts = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _score(shared) -> Callable:
    """Rows sorted by block, a block's words before its texts, to the texts' scores."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scorer = None, None
        for batch in batches:
            blocks, kinds = (np.asarray(batch.column(k)) for k in (0, 1))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if low == high:
                    continue
                if scorer is None or blocks[low] != now:
                    if scorer is not None:
                        yield from scorer.rows()
                    scorer = None  # given up before the next one is made
                    now, scorer = blocks[low], BlockScorer(shared.value)
                part = batch.slice(low, high - low)
                if kinds[low] == 0:
                    scorer.tell(part.column(5).to_pylist(), np.asarray(part.column(2)), np.asarray(part.column(3)))
                    continue
                for some in blocks_of([part], TEXT_BYTES, part.schema.names[5]):
                    scorer.add_texts(some.column(3).to_pylist(), some.column(4).to_pylist(), some.column(5))
                    if len(scorer.texts) >= 4096 and not scorer.ids:
                        yield from scorer.rows()
        if scorer is not None:
            yield from scorer.rows()

    return score


@until_result_ends
def score_texts(docs: DataFrame) -> DataFrame:
    """Score all texts with a model of the training ones, those whose id isn't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, add-one unigrams),
    score (log10 of the model's probability of the token sequence) and bits_per_byte (of the text).
    A null text counts as empty: the end alone. A null doc_id isn't held out. Repeated rows count
    as often as they come. Other columns are ignored, but the language labels of training texts
    shape their words' codes where there are any (the CLASS_BITS most frequent ones and the rest);
    scores come from the text alone. An empty table gives no rows. Without training tokens only
    spellings of an untrained model are left. A task holds the words and texts of one block.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang")).withColumn("held", held_out(F.col("doc_id")))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placement = place_texts(texts, total)
    training = texts.where("not held")
    words = kept_on_disk(count_words(training))
    shared = docs.sparkSession.sparkContext.broadcast(share_model(words, learn_contexts(training, total, PIECE_BYTES)))
    wanted = texts.select("doc_id", "text").mapInArrow(_wanted(placement, shared), "block long, word binary")
    # A word's count, code and bytes are where a text has its key, id and text: rows of one shape.
    told = wanted.join(words, "word").select("block", F.lit(0).alias("kind"), F.col("c").alias("key"), F.col("code").cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held"), F.col("word").alias("data"))
    placed = texts.select("doc_id", "held", "text").mapInArrow(_placed(placement), "block long, key long, doc_id long, held boolean, text string")
    rows = placed.select("block", F.lit(1).alias("kind"), "key", "doc_id", "held", F.col("text").cast("binary").alias("data"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return told.unionByName(rows).repartition(F.col("block")).sortWithinPartitions("block", "kind", "key", "doc_id", "data").mapInArrow(_score(shared), schema)
