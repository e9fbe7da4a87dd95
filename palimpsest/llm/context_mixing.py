"""Online logistic context mixing over bits that spell a text's words.

A known word is told by bits:

* Is it the word that followed the same last 3 words (else 2, else 1) before, earlier in
  the text or else in another training text of the block? Contexts are hashes of whole
  words, so they reach over blanks. Each order has a say: its confidence comes from an
  adaptive map by how often in a row it has been right in this text, for the word if it
  predicts it and against it if it predicts another. Each order has a second say for the word
  that all training texts vote for after the context (word_contexts), its confidence by
  the size of the vote; where that is the surer, its word is the one that is asked for.
* If not, the LEVELS bits of its code: the class of texts the word is most frequent in,
  the size of its count (its base-4 logarithm), and bits of its hash. Each is predicted by
  the counts of all training tokens below the two branches of the code's tree, and by
  those of the text's own words so far that were told this way. Words of one code share
  its probability by their counts.

Gated weights mix the predictions in the logistic domain and a second adaptive map
refines the mixed probability. Weights and maps are learned online while a block's texts
are scored: a chunk of bits is predicted first, then its errors change the weights for
the next one. Bits of held-out texts are predicted and never learned from. A word outside
the training texts is an escape and its spelling; the escape's probability follows the
text so far. A predicted word keeps its code as well, so probabilities add up to less
than one rather than more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .word_contexts import WORD_BITS, Contexts

CLASS_BITS, SIZE_BITS, HASH_BITS = 3, 4, 12
LEVELS = CLASS_BITS + SIZE_BITS + HASH_BITS
#: Words of the contexts, shortest first.
ORDERS = (1, 2, 3)
#: Bits that are predicted before the weights change.
CHUNK = 16384
RATE = 0.02
#: How much a text's own rate of unknown words outweighs the corpus's: as this many tokens do.
ESCAPE_TOKENS = 20.0
BUCKETS = 33

#: ln(n + 0.4); more tokens are as many as the last.
_LOGS = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)
_MOST = len(_LOGS) - 1
_RUNS = 8
_STATES = 2 * _RUNS
#: Sizes of a vote: from 2 on by powers of two. A training text's own vote is left out.
_VOTES = 7
_VOTE_OF = np.searchsorted(2 ** np.arange(1, _VOTES + 1), np.arange(256), side="right").astype(np.int8) - np.int8(1)
#: Gates of the codes' bits: by how many of the text's own words are below the node.
_SEEN = (0, 1, 2, 3, 5, 9, 33)
_GATE_OF = np.searchsorted(np.array(_SEEN), np.arange(64), side="right") - 1
_PLACE_BITS = 24
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LEAST = 1e-5


@dataclass
class CodeTree:
    """Training tokens below each code; of each node (numbered as in a heap) the stretched prediction of its bit, whether both branches have words, and whether several codes below it have."""

    below: np.ndarray
    stretched: np.ndarray
    forked: np.ndarray
    several: np.ndarray

    @classmethod
    def of_cells(cls, cells: np.ndarray, counts: np.ndarray) -> CodeTree:
        below = np.zeros(1 << LEVELS, np.float64)
        below[cells] = counts
        stretched, forked, several = np.zeros(1 << LEVELS, np.float32), np.zeros(1 << LEVELS, bool), np.zeros(2 << LEVELS, bool)
        sums = below
        for level in range(LEVELS - 1, -1, -1):
            zero, one = sums[0::2], sums[1::2]
            part = slice(1 << level, 2 << level)
            forked[part] = (zero > 0) & (one > 0)
            below_too = several[2 << level : 4 << level]
            several[part] = forked[part] | below_too[0::2] | below_too[1::2]
            stretched[part] = np.log(np.maximum(one, 1e-9)) - np.log(np.maximum(zero, 1e-9))
            sums = zero + one
        return cls(below, stretched, forked, several)


@dataclass
class Tokens:
    """A block's texts one after another: word ids, where texts start, which of them are for training; and of each id its code (-1: unknown), count and log10 of its spelling's probability.

    With `contexts`, the votes of all training texts, `hashes` has each id's hash.
    """

    ids: np.ndarray
    starts: np.ndarray
    train: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    spelled: np.ndarray
    hashes: np.ndarray | None = None
    contexts: Contexts | None = None


def _lengths(tokens: Tokens) -> np.ndarray:
    return np.diff(np.append(tokens.starts, len(tokens.ids)))


def _text_of(tokens: Tokens) -> np.ndarray:
    return np.repeat(np.arange(len(tokens.starts)), _lengths(tokens))


def candidates(tokens: Tokens, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the place of the token that its context predicts (-1: none), and whether that is in its own text.

    It is the latest place with the same context in the text itself; else the last training
    text's before it in the block, else the next one's after it.
    """
    n = len(tokens.ids)
    context = np.full(n, order, np.uint64)
    for back in range(1, order + 1):
        before = np.zeros(n, np.uint64)
        before[back:] = tokens.ids[:-back]
        before += np.uint64(1)
        for k in range(back):  # the first words of texts have none so far back
            before[(tokens.starts + k)[k < _lengths(tokens)]] = 0
        context += before
        context *= _MIX[0]
        context ^= context >> np.uint64(29)
    context *= _MIX[1]
    context >>= np.uint64(_PLACE_BITS)
    context <<= np.uint64(_PLACE_BITS)
    context |= np.arange(n, dtype=np.uint64)
    context.sort()
    group = context >> np.uint64(_PLACE_BITS)
    new_group = np.ones(n + 1, bool)
    np.not_equal(group[1:], group[:-1], out=new_group[1:-1])
    shared = np.flatnonzero(~(new_group[:-1] & new_group[1:]))  # a context that comes once predicts nothing
    place = (context.take(shared) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new_group = new_group.take(shared)
    m = len(place)
    at = np.arange(m, dtype=np.int32)
    of = _text_of(tokens).take(place)
    new_run = new_group.copy()
    new_run[1:] |= of[1:] != of[:-1]
    # Of runs, tokens of one context and one text: the last token of the run that teaches before, and the first one of the next.
    opens = np.flatnonzero(new_run).astype(np.int32)
    runs = len(opens)
    run = np.arange(runs, dtype=np.int32)
    teaches = tokens.train.take(of.take(opens))
    first = np.maximum.accumulate(run * new_group.take(opens))
    last = np.full(runs + 1, -1, np.int32)
    last[1:] = np.maximum.accumulate((run + 1) * teaches - 1)
    following = np.full(runs + 1, runs, np.int32)
    following[:-1] = np.minimum.accumulate((runs - (runs - run) * teaches)[::-1])[::-1]
    last, following = last[:-1], following[1:]
    ends = np.append(opens[1:], m) - 1
    inside = np.append(first, -1).take(following) == first
    other = np.where(last >= first, ends.take(last, mode="clip"), np.where(inside, opens.take(following, mode="clip"), -1))
    chosen = at - 1
    chosen[opens] = other
    out = np.full(n, -1, np.int64)
    predicts = place.take(chosen, mode="clip")
    predicts[opens[other < 0]] = -1
    out[place] = predicts
    own = np.zeros(n, bool)
    own[place] = ~new_run
    return out, own


_RUN_OF = np.searchsorted(np.array([1, 2, 3, 5, 9, 17, 33]), np.arange(64), side="right").astype(np.int8)


def _runs(hit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hits in a row come right before each token in its text, as one of _RUNS sizes."""
    at = np.arange(len(hit))
    before = np.empty(len(hit), np.int64)
    before[0] = -1
    np.subtract((at[:-1] + 1) * ~hit[:-1], 1, out=before[1:])
    before[starts] = starts - 1
    at -= 1
    at -= np.maximum.accumulate(before)
    return _RUN_OF.take(at, mode="clip")


class _OwnWords:
    """Counts of the text's own earlier words below the branches of the code's tree, level by level: a wavelet tree.

    Tokens of one text and one node lie together, in the order of the text; `cuts` are where these groups start, and their end.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.codes, self.place = codes, np.arange(len(codes))
        self.cuts = np.append(starts[sizes > 0], len(codes)).astype(np.int32)

    def level(self, level: int) -> np.ndarray:
        """By token the earlier tokens below the node whose bit is zero, and those whose bit is one: the lower and the upper half, _MOST at most."""
        met = np.zeros(len(self.codes), np.uint32)
        self._without_lone()
        m = len(self.place)
        if not m:
            return met
        bit = self.codes.take(self.place, mode="clip")
        bit >>= LEVELS - 1 - level
        bit &= 1
        ones = np.empty(m + 1, np.int32)
        ones[0] = 0
        np.cumsum(bit, out=ones[1:])
        opens, sizes = self.cuts[:-1], np.diff(self.cuts)
        before = ones.take(self.cuts)
        first, zeros = before[:-1], sizes - np.diff(before)
        seen_ones = ones[:-1] - np.repeat(first, sizes)
        to_zero = np.arange(m, dtype=np.int32)
        to_zero -= seen_ones  # its place among the group's zeros
        seen_zeros = to_zero - np.repeat(opens, sizes)
        split = opens + zeros
        come = np.repeat(split, sizes)
        come += seen_ones
        come -= to_zero
        come *= bit
        come += to_zero
        np.minimum(seen_ones, _MOST, out=seen_ones)
        np.minimum(seen_zeros, _MOST, out=seen_zeros)
        seen_ones <<= 16
        seen_ones |= seen_zeros
        met[self.place] = seen_ones.view(np.uint32)
        place = np.empty(m, np.int64)
        place[come] = self.place
        cuts = np.empty(2 * len(opens) + 1, np.int32)
        cuts[0:-1:2], cuts[1::2], cuts[-1] = opens, split, m
        self.place, self.cuts = place, cuts[np.append(cuts[1:] != cuts[:-1], True)]
        return met

    def _within(self, kept: np.ndarray) -> None:
        """Go on with these groups."""
        sizes = np.diff(self.cuts)
        self.place = self.place[np.repeat(kept, sizes)]
        self.cuts = np.append(0, np.cumsum(sizes[kept])).astype(np.int32)

    def _without_lone(self) -> None:
        """A token that is alone below its node meets no others further down."""
        several = np.diff(self.cuts) > 1
        if len(several) - np.count_nonzero(several) > 0.1 * len(self.place):
            self._within(several)

    def keep(self, kept: np.ndarray) -> None:
        """Go on with these tokens; of a text and a node all are kept or none."""
        self._within(kept.take(self.place.take(self.cuts[:-1])))
        rank = np.cumsum(kept)
        rank -= 1
        self.codes, self.place = self.codes[kept], rank.take(self.place)


class _Mixer:
    """Gated weights, and the map that refines what they mix: of one kind of bit. `gate_of`: the gate of each number that bits come with."""

    def __init__(self, weights: list[float], gate_of: np.ndarray):
        self.gates, self.gate_of = int(gate_of[-1]) + 1, gate_of
        self.opens = np.searchsorted(gate_of, np.arange(self.gates))
        self.cells = gate_of * BUCKETS + BUCKETS // 2
        self.weights = np.tile(np.array([*weights, 0.0], np.float32)[:, None], (1, self.gates))
        self.refined = np.tile((1 / (1 + np.exp(8 - np.arange(BUCKETS) / 2))).astype(np.float32), self.gates)

    def _by_gate(self, number: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bincount(number, values, len(self.gate_of)), self.opens)

    def mix(self, x: list[np.ndarray], number: np.ndarray, bit: np.ndarray, taught: np.ndarray) -> np.ndarray:
        """Probability of each bit as it came; the errors of the bits that are taught change weights and map afterwards. Bits are numbers of 0 or 1, taught too."""
        weights = self.weights[:, self.gate_of]
        z = weights[-1].take(number, mode="clip")
        for k, column in enumerate(x):
            part = weights[k].take(number, mode="clip")
            part *= column
            z += part
        np.clip(z, -12, 12, out=z)
        one = np.negative(z)
        np.exp(one, out=one)
        one += 1
        np.reciprocal(one, out=one)
        z += z
        np.rint(z, out=z)
        np.clip(z, -16, 16, out=z)
        cell = self.cells.take(number, mode="clip")
        cell += z.astype(np.int32)
        p = self.refined.take(cell, mode="clip")
        p += one
        p *= np.float32(0.5)
        np.clip(p, _LEAST, 1 - _LEAST, out=p)
        # Bits of a cell by what they are and whether they are taught.
        cell *= 4
        cell += bit + 2 * taught
        came = np.bincount(cell, minlength=4 * len(self.refined)).reshape(-1, 4)
        of_cell = came[:, 2] + came[:, 3]
        n = of_cell.reshape(self.gates, BUCKETS).sum(axis=1)
        step = RATE * np.minimum(np.sqrt(n), 16) / np.maximum(n, 1)
        error = np.subtract(bit, one, dtype=np.float32)
        error *= taught
        for k, column in enumerate(x):
            self.weights[k] += (step * self._by_gate(number, error * column)).astype(np.float32)
        self.weights[-1] += (step * self._by_gate(number, error)).astype(np.float32)
        mean = came[:, 3] / np.maximum(of_cell, 1)
        self.refined += ((mean - self.refined) * (1 - 0.98**of_cell)).astype(np.float32)
        p -= np.subtract(1, bit, dtype=np.float32)
        return np.abs(p, out=p)


def token_logs(tree: CodeTree, tokens: Tokens, escape: float) -> np.ndarray:
    """log10 of the probability of each token given those before it in its text; escape is the corpus's rate of unknown words."""
    if not len(tokens.ids):
        return np.zeros(0)
    text, codes = _text_of(tokens), tokens.codes[tokens.ids]
    known = codes >= 0
    out = _escapes(tokens, text, known, escape)
    predicted, came = _predicted_words(tokens, known, text)
    out[known] += np.log10(predicted[known])
    at = np.flatnonzero(known & ~came)
    sizes = np.bincount(text[at], minlength=len(tokens.starts))
    chance = _codes_chance(tree, codes[at].astype(np.int32), tokens.train[text[at]].astype(np.int32), np.cumsum(sizes) - sizes, sizes)
    out[at] += np.log10(chance) + np.log10(tokens.counts[tokens.ids[at]] / tree.below[codes[at]])
    return out


def _voted_words(tokens: Tokens, known: np.ndarray, text: np.ndarray, name: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order the name of the word that all training texts vote for after each token's context (-1: none), and the vote's size."""
    own = tokens.train[text]
    for word, number in tokens.contexts.said(tokens.hashes.take(tokens.ids), tokens.starts):
        number -= (word == name) & own & (number > 0) & (number < 255)
        size = _VOTE_OF.take(number)
        yield np.where((size >= 0) & known, word, -1), np.maximum(size, 0)


def _names(tokens: Tokens) -> np.ndarray:
    """A number of each token's word: its id, or its hash where words come that have no id."""
    return tokens.ids if tokens.contexts is None else (tokens.hashes.take(tokens.ids) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _predicted_words(tokens: Tokens, known: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of whether each known token is the predicted word, as it came, and whether it is; 1 and false where none is predicted."""
    n, name = len(known), _names(tokens)
    words, states, rights = [], [], []
    asked = np.zeros(n, bool)
    for order in ORDERS:
        place, own = candidates(tokens, order)
        at = np.flatnonzero(place >= 0)
        there, word, hit = place.take(at), np.full(n, -1), np.zeros(n, bool)
        hit[at] = tokens.ids.take(there) == tokens.ids.take(at)
        both = known.take(there) & known.take(at)
        word[at[both]] = name.take(there[both])
        words.append(word)
        states.append(_runs(hit, tokens.starts) + _RUNS * own.view(np.int8))
        rights.append(4.0 * np.tile(np.linspace(0.1, 0.98, _RUNS), 2))  # as if some had been seen
        asked |= word >= 0
    for word, size in _voted_words(tokens, known, text, name) if tokens.contexts is not None else ():
        words.append(word)
        states.append(size)
        rights.append(4.0 * np.linspace(0.2, 0.5, _VOTES))
        asked |= word >= 0
    at = np.flatnonzero(asked)
    p, came = np.ones(n), np.zeros(n, bool)
    taught = tokens.train[text[at]].astype(np.int32)
    gates = np.append(0, np.cumsum([len(r) for r in rights]))
    mixer = _Mixer([0.3, 0.4, 0.5] + [0.3] * (len(words) - len(ORDERS)), np.arange(gates[-1]))
    every = [np.full(len(r), 4.0) for r in rights]
    for low in range(0, len(at), CHUNK):
        part = at[low : low + CHUNK]
        t, here = taught[low : low + CHUNK], name.take(part)
        said = [word.take(part) for word in words]
        state = [s.take(part).astype(np.int64) for s in states]
        sure = [np.log((r + 0.02) / (e - r + 0.02)).astype(np.float32).take(s) for r, e, s in zip(rights, every, state, strict=True)]
        chosen, gate, most = np.full(len(part), -1), np.zeros(len(part), np.int64), np.full(len(part), -np.inf, np.float32)
        for k, word in enumerate(said):  # the longest known context's, or a surer vote's
            takes = word >= 0
            if k >= len(ORDERS):
                takes &= sure[k] > most
            np.copyto(chosen, word, where=takes)
            np.copyto(gate, gates[k] + state[k], where=takes)
            np.copyto(most, sure[k], where=takes)
        hit = chosen == here
        came[part] = hit
        x = []
        for word, s in zip(said, sure, strict=True):
            column = -np.abs(s)
            np.copyto(column, s, where=word == chosen)
            column *= word >= 0
            x.append(column)
        p[part] = mixer.mix(x, gate, hit.astype(np.int32), t)
        for k, (word, s) in enumerate(zip(said, state, strict=True)):
            # By state: words that are right, wrong and none, of texts that teach.
            kind = (word == here).astype(np.int8)
            kind += word >= 0
            kind *= t == 1
            seen = np.bincount(s * 3 + kind, minlength=3 * len(every[k])).reshape(-1, 3)
            every[k] += seen[:, 1] + seen[:, 2]
            rights[k] += seen[:, 2]
    return p, came


def _codes_chance(tree: CodeTree, code: np.ndarray, taught: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probability of each code, bit by bit; a node with one branch has no choice, and a token leaves where no choice is left."""
    out, live = np.ones(len(code), np.float64), np.arange(len(code))
    chance = out.copy()
    own_words = _OwnWords(code, starts, sizes)
    for level in range(LEVELS):
        if not len(live):
            break
        shift = LEVELS - 1 - level
        node = code >> shift + 1
        node += 1 << level
        met = own_words.level(level)
        mixer = _Mixer([0.7, 0.3], _GATE_OF)
        at = np.flatnonzero(tree.forked.take(node, mode="clip"))
        for low in range(0, len(at), CHUNK):
            part = at[low : low + CHUNK]
            seen = met.take(part, mode="clip")
            ones = seen >> 16
            seen &= _MOST
            own = _LOGS.take(ones)
            own -= _LOGS.take(seen)
            seen += ones
            np.minimum(seen, len(_GATE_OF) - 1, out=seen)
            bit = code.take(part, mode="clip")
            bit >>= shift
            bit &= 1
            stretched = tree.stretched.take(node.take(part, mode="clip"), mode="clip")
            p = mixer.mix([stretched, own], seen.astype(np.int64), bit, taught.take(part, mode="clip"))
            chance[part] = chance.take(part, mode="clip") * p
        if level == LEVELS - 1:
            break
        node <<= 1
        node |= code >> shift & 1
        kept = tree.several.take(node, mode="clip")
        if np.count_nonzero(kept) < 0.9 * len(kept):
            out[live] = chance
            live, chance, code, taught = live[kept], chance[kept], code[kept], taught[kept]
            own_words.keep(kept)
    out[live] = chance
    return out


def _escapes(tokens: Tokens, text: np.ndarray, known: np.ndarray, escape: float) -> np.ndarray:
    """log10 of whether each token is known, and of an unknown word's probability: its spelling's, or as one of the text's unknown words so far."""
    inside = np.arange(len(known)) - tokens.starts[text]
    unknown = np.append(0, np.cumsum(~known))
    before = unknown[:-1] - unknown[tokens.starts[text]]
    p = (before + escape * ESCAPE_TOKENS) / (inside + ESCAPE_TOKENS)
    out = np.log10(np.where(known, 1 - p, p))
    at = np.flatnonzero(~known)
    if len(at):
        # Unknown tokens by text and word: how often this one came, and how many unknown ones repeated a word so far.
        key = text[at] * np.int64(len(tokens.codes)) + tokens.ids[at]
        order = np.argsort(key, kind="stable")
        opens = np.append(True, key[order][1:] != key[order][:-1])
        times = np.empty(len(at), np.int64)
        times[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
        again = np.append(0, np.cumsum(times > 0))
        first = np.searchsorted(at, tokens.starts[text[at]])
        repeats = again[:-1] - again[first]
        met = before[at]
        b = np.where(met > 0, (repeats + 0.5) / (met + 2.0), 0.0)
        out[at] += np.log10((1 - b) * 10.0 ** np.maximum(tokens.spelled[tokens.ids[at]], -290) + b * times / np.maximum(met, 1))
    return out
