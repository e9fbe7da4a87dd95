"""Packing: token sequences of near-equal fill by Karmarkar-Karp multiway differencing.

A document longer than a sequence first gives whole sequences of its own; what is
left of it (cut to pieces of at most PIECE_TOKENS) goes into the windows of its
block. Differencing starts with one partial partition per piece and keeps merging
the two with the largest imbalance, the fullest slot of one onto the emptiest of
the other, until one partition is left. If a window exceeds the capacity the
window count rises and the block is differenced again, until all fit. So that the
first count can fit, its windows are to hold SLACK_TOKENS less than their capacity
each; the block's other tokens form whole sequences and ones of power-of-two
lengths, which need no padding.

A block is about BLOCK_DOCS neighbouring documents of one Spark partition, so
nothing is shuffled, memory is bounded, and a task that is run again after a lost
executor makes the same sequences from the same input.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textblocks import blocks, ids_and_texts

SEQUENCE_TOKENS = 4096
PIECE_TOKENS = 512
BLOCK_DOCS = 1024
SLACK_TOKENS = 16
END_ID = 2
#: Words whose ids a worker remembers, and their length; at the bound it starts anew.
WORDS_KEPT = 1_000_000
KEPT_CHARS = 64

#: Texts of these characters only (ASCII and composed Latin letters) are split here as the tokenizer splits them.
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[\t-\r -~{_LETTERS}]*")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTERS}0-9]+")
#: Others at white space. str.split() splits at these too, the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r ]+")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of sizes in `windows` groups of near-equal sum."""
    if windows <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(windows - 1)]
    # A slot's content is a node: below len(sizes) a piece, else a pair of nodes; -1 is empty.
    pairs: list[tuple[int, int]] = []
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        more, others = more[::-1], others[::-1]
        both = np.flatnonzero((nodes >= 0) & (others >= 0))
        joined = np.where(nodes >= 0, nodes, others)
        joined[both] = len(sizes) + len(pairs) + np.arange(len(both))
        pairs.extend(zip(nodes[both].tolist(), others[both].tolist(), strict=True))
        sums = sums + more
        order = np.argsort(-sums, kind="stable")
        sums, joined = sums[order], joined[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, joined))
        serial += 1
    groups = []
    for node in heap[0][3].tolist():
        stack, group = [node] if node >= 0 else [], []
        while stack:
            if (top := stack.pop()) < len(sizes):
                group.append(top)
            else:
                stack.extend(pairs[top - len(sizes)])
        groups.append(sorted(group))
    return groups


Piece = tuple[int, int, int]  # document in the block, start, length


def pack_block(lengths: list[int], capacity: int = SEQUENCE_TOKENS, piece: int = PIECE_TOKENS, slack: int = SLACK_TOKENS) -> list[list[Piece]]:
    """Sequences of pieces that together hold each token of the block's documents once.

    Windows get `slack` tokens less than they hold, so that the first number of windows can fit; as
    long as differencing puts more than the capacity into one, there is one window more. The
    tokens left over are cut into whole sequences and ones of power-of-two lengths.
    """
    sequences: list[list[Piece]] = []
    items: list[Piece] = []
    for doc, length in enumerate(lengths):
        whole = length // capacity * capacity
        sequences.extend([(doc, at, capacity)] for at in range(0, whole, capacity))
        items.extend((doc, at, min(piece, length - at)) for at in range(whole, length, piece))
    total = sum(x[2] for x in items)
    windows = total // capacity
    tail = total - windows * (capacity - slack)
    ends: list[Piece] = []
    while tail:  # cut from the last pieces
        doc, at, length = items.pop()
        take = min(length, tail)
        ends.append((doc, at + length - take, take))
        if take < length:
            items.append((doc, at, length - take))
        tail -= take
    sequences.extend(_exactly_filled(ends, capacity))
    if not windows:
        return sequences
    sizes = [x[2] for x in items]
    count = windows
    while True:
        groups = differencing(sizes, count)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            break
        count += 1
    sequences.extend([items[i] for i in g] for g in groups if g)
    return sequences


def _exactly_filled(pieces: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Sequences without padding: of the capacity, and of the powers of two that the rest is the sum of."""
    whole, rest = divmod(sum(x[2] for x in pieces), capacity)
    for room in [capacity] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]:
        out = []
        while room:
            doc, at, length = pieces.pop()
            take = min(length, room)
            out.append((doc, at, take))
            if take < length:
                pieces.append((doc, at + take, length - take))
            room -= take
        yield out


class WordIds:
    """Texts to ids (as little-endian unsigned 32-bit) by the tokenizer file.

    The tokenizer drops white space and never joins over it, so ids are looked up by word; words
    that several texts are the first to have are given to it together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # Numbers of words and ids by number: for texts that are split here, and for others.
        self.known = {True: _Numbers(), False: _Numbers()}
        self.found: dict[bool, list[bytes]] = {True: [], False: []}

    def __call__(self, text: str) -> bytes:
        return self.texts([text])[0]

    def texts(self, texts: list[str]) -> list[bytes]:
        if sum(x.next for x in self.known.values()) > WORDS_KEPT:
            self._forget()
        numbers = []
        for text in texts:
            if plain := _PLAIN.fullmatch(lower := text.lower()) is not None and "<|" not in text and len(lower) == len(text):
                parts = _PARTS.findall(lower)
            else:
                parts = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
            numbers.append((plain, list(map(self.known[plain].__getitem__, parts))))
        long = {plain: self._learn(plain) for plain in self.known}
        out = [b"".join(map(self.found[plain].__getitem__, own)) for plain, own in numbers]
        for plain, words in long.items():
            for word in words:
                self.found[plain][self.known[plain].pop(word)] = b""
        return out

    def _learn(self, plain: bool) -> list[str]:
        """Finds the ids of the words that are new, and returns the long ones among them."""
        known, found = self.known[plain], self.found[plain]
        new, known.new = known.new, []
        if not new:
            return new
        if plain:  # each part gives one token with a word end, its last
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            data = ids.tobytes()
            found.extend([data[i:j] for _, i, j in zip(new, [0, *stops[:-1]], stops, strict=True)])
        else:
            found.extend(np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))
        return [word for word in new if len(word) > KEPT_CHARS]


class _Numbers(dict):
    """Numbers of words; one that is asked for and isn't there gets the next and is new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, word: str) -> int:
        self[word] = k = self.next
        self.next += 1
        self.new.append(word)
        return k


def word_ids(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids by the tokenizer file."""
    return WordIds(path)


_ENCODERS: dict[str, WordIds] = {}


def _pack(path: str, end_id: int, capacity: int, block_docs: int):
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        encode = _ENCODERS[path]
        serial = TaskContext.get().partitionId() << 36

        def sequences(ids: list, encoded: list[bytes]) -> pa.RecordBatch:
            nonlocal serial
            rows = []
            for sequence in pack_block([len(x) // 4 for x in encoded], capacity):
                offset = 0
                for doc, at, length in sequence:
                    own = encoded[doc]
                    rows.append((ids[doc], at, length, zlib.crc32(own[4 * at : 4 * (at + length)]), len(own) // 4, serial, offset))
                    offset += length
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        ids, encoded, size = [], [], 0
        for block in blocks(batches, 1 << 20):
            for doc_id, own in zip(block.column(0).to_pylist(), encode.texts(block.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                encoded.append(own + end)
                size += len(encoded[-1])
                if len(ids) >= block_docs or size > 64 << 20:
                    yield sequences(ids, encoded)
                    ids, encoded, size = [], [], 0
        if ids:
            yield sequences(ids, encoded)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Cut all documents into pieces and pack them into sequences of at most `capacity` tokens.

    tokenizer: path of a tokenizers file whose pre-tokenizer drops white space. Each document is its
    ids, without special tokens, then end_id; a null or empty text is end_id alone. Returns one row
    a piece: doc_id (null stays null), start, length, ids_crc32, doc_tokens, sequence_id (unique,
    not dense), offset. Repeated rows are packed as often as they come; other columns are ignored;
    an empty table gives no rows. Memory: the tokens of one block (64 MB) or of one longer document.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ids_and_texts(docs).mapInArrow(_pack(tokenizer, end_id, capacity, block_docs), schema)
