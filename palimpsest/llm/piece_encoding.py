"""Exact encoding and decoding with a SentencePiece merge-type model.

No piece joins a space mark to a character before it, and none holds a line
feed, so a text falls into words whose encodings are independent. A word is
encoded by backtracking instead of by merging: an Aho-Corasick automaton gives
all pieces at each position, the longest is tried first, and a piece may follow
another only if merging the two texts gives just these two pieces again. Since a
prefix has one valid encoding at most, a position from which all pieces failed
can be marked in a bit field and never tried again.

Merging itself (by a heap of scored pairs) is used for the pair checks and for
runs of spaces, whose pieces share one score so that only their order decides.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import blocks, ids_and_texts

SPACE = "▁"
#: Words whose encodings a worker remembers, and their length; at the bound it starts anew.
WORDS_KEPT = 600_000
KEPT_CHARS = 64
PAIRS_KEPT = 1_000_000
#: Characters whose pieces are looked up together: a longer word is never looked up as a whole.
STRETCH = 1 << 15


class PieceModel:
    """Pieces and scores of a model file, and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.bytes) if i != self.unknown}
        long = "".join(p for p in self.ids if len(p) > 1)
        #: Characters that only occur inside longer pieces: words with these are merged.
        self.inner = {c for c in long if c not in self.ids}
        if "\n" in long or any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces that reach over words")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.stable: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.letters = {p for p in self.ids if len(p) == 1}
        #: Of each id: its decimal, and the bytes it decodes to after the text's first space mark.
        self.numbers = [str(i).encode() for i in range(len(self.pieces))]
        self.decoded = [self.byte_of[i] if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equal ones, until none can be merged."""
        parts: list[str | None] = list(text)
        left = list(range(-1, len(parts) - 1))
        right = list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (score := self.scores.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def alone(self, i: int) -> bool:
        """Whether merging the piece's text gives the piece."""
        if (known := self.stable.get(i)) is None:
            known = self.stable[i] = self.merge(self.pieces[i]) == [self.pieces[i]]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' texts gives the two pieces."""
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        one, two = self.pieces[a], self.pieces[b]
        known = self.pairs[a << 32 | b] = self.merge(one + two) == [one, two]
        return known

    def backtrack(self, text: str) -> list[int] | array:
        """Ids of a stretch of known characters."""
        if len(text) > STRETCH:
            return self._backtrack_long(text)
        size, stable, pairs = len(text), self.stable, self.pairs
        at: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, i) in self.automaton.iter(text):
            if (known := stable.get(i)) is None:
                known = self.alone(i)
            if known:
                at[end + 1 - length].append((end + 1, i))  # ends ascend, so the longest comes last
        failed = 0
        tokens: list[int] = []
        starts: list[int] = []
        place = 0
        while place < size:
            options = at[place]
            while options:
                end, i = options.pop()
                if failed and failed >> end & 1:
                    continue
                if tokens:
                    if (known := pairs.get(tokens[-1] << 32 | i)) is None:
                        known = self.fits(tokens[-1], i)
                    if not known:
                        continue
                tokens.append(i)
                starts.append(place)
                place = end
                break
            else:
                failed |= 1 << place
                if not tokens:
                    raise ValueError(f"no encoding of {text!r}")
                tokens.pop()
                place = starts.pop()
        return tokens

    def _pieces_from(self, text: str, low: int) -> list[list[tuple[int, int]]]:
        """The pieces that start at each of the STRETCH characters from `low` on, as (end, id), the longest last."""
        at: list[list[tuple[int, int]]] = [[] for _ in range(min(STRETCH, len(text) - low))]
        for end, (length, i) in self.automaton.iter(text[low : low + STRETCH + self.longest]):
            if end + 1 - length < len(at) and self.alone(i):
                at[end + 1 - length].append((low + end + 1, i))
        return at

    def _backtrack_long(self, text: str) -> array:
        """As backtrack, with the pieces of three stretches at a time; where it goes back beyond these, they are looked up again.

        What has been tried at a place needs no memory: the options that are left there end before the token that was taken back.
        """
        size = len(text)
        stretches: dict[int, list[list[tuple[int, int]]]] = {}
        failed = bytearray(size // 8 + 1)
        tokens, starts = array("l"), array("l")
        place, below = 0, size + 1
        while place < size:
            number = place // STRETCH
            if number not in stretches:
                if len(stretches) > 2:
                    del stretches[max(stretches, key=lambda k: abs(k - number))]
                stretches[number] = self._pieces_from(text, number * STRETCH)
            for end, i in reversed(stretches[number][place % STRETCH]):
                if end >= below or failed[end >> 3] >> (end & 7) & 1:
                    continue
                if tokens:
                    if (known := self.pairs.get(tokens[-1] << 32 | i)) is None:
                        known = self.fits(tokens[-1], i)
                    if not known:
                        continue
                tokens.append(i)
                starts.append(place)
                place, below = end, size + 1
                break
            else:
                failed[place >> 3] |= 1 << (place & 7)
                if not tokens:
                    raise ValueError(f"no encoding of a word of {size} characters")
                tokens.pop()
                below, place = place, starts.pop()
        return tokens

    def _fallback(self, text: str) -> list[int]:
        """Of a character that is no piece."""
        return [self.bytes[b] for b in text.encode()] if self.byte_of else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one independent word."""
        if word.startswith(SPACE * 2) or self.inner and not self.inner.isdisjoint(word):
            return [i for p in self.merge(word) for i in ([self.ids[p]] if p in self.ids else self._fallback(p))]
        if self.letters.issuperset(word):
            return self.backtrack(word)
        out: list[int] = []
        start = 0
        for end in range(len(word) + 1):
            if end == len(word) or word[end] not in self.ids:
                if start < end:
                    out += self.backtrack(word[start:end])
                if end < len(word):
                    out += self._fallback(word[end])
                start = end + 1
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Of ids that begin after the text's first space mark."""
        return b"".join([self.decoded[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of all ids: without the space that encoding put before it."""
        out = self.decode_bytes(ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text: each with its space marks before it; a line feed begins a word."""
        out: list[str] = []
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            words = line.split(" ")
            first = "\n" + words[0] if k else SPACE + words[0]
            if "" not in words:
                out.append(first)
                out += [SPACE + w for w in words[1:]]
                continue
            # Empty words are spaces of a run; a run ends with the next word, or with the line.
            run = "" if k else SPACE * (words[0] == "" and len(words) > 1)
            if k or words[0]:
                out.append(first)
            elif len(words) == 1:
                out.append(SPACE)
            for w in words[1:]:
                run += SPACE
                if w:
                    out.append(run + w)
                    run = ""
            if run:
                out.append(run)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self.encode_word(w)] if text else []

    def digest_parts(self, text: str) -> tuple[bytes, bytes]:
        """The text's ids as decimals joined by commas, and the bytes of its ids decoded."""
        if not text:
            return b"", b""
        words, known = self.split(text), self.words
        try:
            found = [known[w] for w in words]
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            found = []
            for w in words:
                if (both := known.get(w)) is None:
                    ids = self.encode_word(w)
                    both = b",".join([self.numbers[i] for i in ids]), self.decode_bytes(ids)
                    if len(w) <= KEPT_CHARS:
                        known[w] = both
                found.append(both)
        ids, decoded = zip(*found, strict=True)
        joined = b"".join(decoded)
        return b",".join(ids), (joined[1:] if joined[:1] == b" " else joined)


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode every text with the model file and decode the ids again, as digests.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    A null text counts as empty: no ids. Null doc_ids and repeated rows stay as they are, other
    columns are ignored, an empty table gives no rows. There is no begin or end id and no sampling.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for block in blocks(batches, 1 << 20):
            count, one, two = [], [], []
            for text in block.column(1).to_pylist():
                ids, decoded = pieces.digest_parts(text)
                count.append(ids.count(b",") + 1 if ids else 0)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every text; nulls as in encode_digests."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for block in blocks(batches, 1 << 20):
            ids = [pieces.encode(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give the empty text."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("doc_id", "cast(ids as array<int>) ids").mapInArrow(decode, "doc_id long, text string")
