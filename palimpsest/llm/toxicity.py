"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are first given classes: insult with a weight (stems learned from labelled
rows, and seeds), harm, target, speaker, will, negation and report (fixed lists in
four languages). Five transducers are composed once, each reading what the one before
writes: negation and reported speech mark the scope of every word, the target
machine guesses whether the clause addresses somebody and accepts only if it guessed
right, the threat machine marks the end of SPEAKER WILL HARM TARGET, and the insult
machine writes weighted arcs to the tracks. A clause counts only by its accepted path
through the composed machine; clauses without an insult or a word of harm are never
read. A logistic model turns the tracks into a score.

Lexicon and model are fitted on at most SAMPLE_ROWS labelled rows, those with the
least hashes of their doc_id, and the lexicon has at most MOST_STEMS stems, chosen among
the 20 * MOST_STEMS most frequent of toxic rows; everything else runs over all documents.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import ids_and_texts, kept_on_disk, released

SAMPLE_ROWS = 20_000
#: A stem is the first 4 to 7 letters of a word, or a whole word (then with a `$`).
STEM_LETTERS = range(4, 8)
LEAST_POSITIVE = 8
LEAST_LOG_ODDS = 3.0
MOST_STEMS = 5_000
#: Words over which a negation or a threat's parts reach.
REACH = 4
FOLDS = 5
HELD_OUT = 0

# Words of each class in English, German, French and Spanish.
SEEDS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumm idiota imbécile estúpido".split()
HARM = "kill hurt destroy beat stab shoot töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()
TARGET = "you your yours u yourself du dich dir ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split()
SPEAKER = "i we ich wir je nous yo nosotros".split()
WILL = "will shall gonna going must werde werden vais allons voy vamos quiero".split()
NEGATION = "not no never isn't aren't don't won't nicht kein keine nie ne pas jamais non nunca ni".split()
REPORT = "said says say wrote claims claimed called calls quoted sagte schrieb nannte dit écrit appelle dijo escribió llamó".split()

#: What clauses write; the last is the most that one clause writes to plain, targeted and threats.
TRACKS = ("plain", "negated", "reported", "targeted", "threats", "strongest")

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_CLASS = {w: c for c, words in (("harm", HARM), ("target", TARGET), ("speaker", SPEAKER), ("will", WILL), ("negation", NEGATION), ("report", REPORT)) for w in words}
#: The alphabet that the first machine reads; a word of harm with a weight is a harmful insult.
CLASSES = ("other", "insult", "harm", "harmful insult", "target", "speaker", "will", "negation", "report")
SOFTENED_THREAT = 0.3


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEM_LETTERS if n <= len(word)] + [word + "$"]


@dataclass(frozen=True)
class Machine:
    """A transducer: start states, arcs from (state, read) to (state, written), and accepting states."""

    starts: tuple
    arcs: dict
    accepting: frozenset

    def written(self) -> set:
        return {w for _, w in self.arcs.values()}

    def read(self, symbols: list) -> list[tuple]:
        """What each accepted path writes for the symbols."""
        out = []
        for state in self.starts:
            wrote = []
            for symbol in symbols:
                if (state, symbol) not in self.arcs:
                    break
                state, w = self.arcs[state, symbol]
                wrote.append(w)
            else:
                if state in self.accepting:
                    out.append(tuple(wrote))
        return out


def machine(starts: tuple, alphabet: Iterable, step: Callable, accepts: Callable = lambda state: True) -> Machine:
    """The states that step(state, symbol) reaches from the starts; where it gives None there is no arc."""
    alphabet, arcs, seen, todo = list(alphabet), {}, set(starts), list(starts)
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            if (arc := step(state, symbol)) is not None:
                arcs[state, symbol] = arc
                if arc[0] not in seen:
                    seen.add(arc[0])
                    todo.append(arc[0])
    return Machine(starts, arcs, frozenset(filter(accepts, seen)))


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that writes what second writes when it reads what first writes."""

    def step(state: tuple, symbol):
        if (one := first.arcs.get((state[0], symbol))) is None or (two := second.arcs.get((state[1], one[1]))) is None:
            return None
        return (one[0], two[0]), two[1]

    starts = tuple((x, y) for x in first.starts for y in second.starts)
    return machine(starts, {symbol for _, symbol in first.arcs}, step, lambda s: s[0] in first.accepting and s[1] in second.accepting)


def _negation(left: int, kind: str):
    left = REACH if kind == "negation" else max(left - 1, 0)
    return left, (kind, "negated" if left else "plain")


def _report(said: bool, read: tuple):
    said = said or read[0] == "report"
    return said, (read[0], "reported" if said and read[1] == "plain" else read[1])


def _target(guess: tuple, read: tuple):
    """guess: (the clause addresses somebody, it has done so)."""
    addressed, seen = guess
    if read[0] == "target":
        return ((True, True), (*read, True)) if addressed else None
    return guess, (*read, addressed)


def _threat(state: tuple, read: tuple):
    """state: (parts of a threat read so far, words since the last of them)."""
    parts, since = state
    part = {"speaker": 0, "will": 1, "harm": 2, "harmful insult": 2, "target": 3}.get(read[0])
    since += 1
    if part == 0:
        return (1, 0), (*read, False)
    if parts and part == parts and since <= REACH:
        return ((0, 0), (*read, True)) if parts == 3 else ((parts + 1, 0), (*read, False))
    return ((parts, since) if parts and since <= REACH else (0, 0)), (*read, False)


def _insult(state: int, read: tuple):
    """Writes (track, constant, share of the word's weight) for each track that gets something."""
    kind, scope, addressed, threat = read
    out = [(TRACKS.index("threats"), 1.0 if scope == "plain" else SOFTENED_THREAT, 0.0)] if threat else []
    if kind in ("insult", "harmful insult"):
        out.append((TRACKS.index(scope), 0.0, 1.0))
        if addressed and scope == "plain":
            out.append((TRACKS.index("targeted"), 0.0, 1.0))
    return state, tuple(out)


def grammar_machines() -> list[Machine]:
    """The five machines; each one's alphabet is what the one before writes."""
    out = [machine((0,), CLASSES, _negation)]
    rest = [((False,), _report, lambda s: True), (((False, False), (True, False)), _target, lambda s: s[0] == s[1]), (((0, 0),), _threat, lambda s: True), ((0,), _insult, lambda s: True)]
    for starts, step, accepts in rest:
        out.append(machine(starts, out[-1].written(), step, accepts))
    return out


def composed(machines: list[Machine]) -> tuple[tuple, list[list], list[bool]]:
    """Their composition with numbered states: starts, arcs by state and class, and which states accept."""
    whole = functools.reduce(compose, machines)
    states = list({s: None for s in (*whole.starts, *(t for t, _ in whole.arcs.values()))})
    number = {s: k for k, s in enumerate(states)}
    arcs = [[(number[a[0]], a[1]) if (a := whole.arcs.get((s, c))) else None for c in CLASSES] for s in states]
    return tuple(number[s] for s in whole.starts), arcs, [s in whole.accepting for s in states]


STARTS, ARCS, ACCEPTING = composed(grammar_machines())
_NUMBER = {c: k for k, c in enumerate(CLASSES)}
_NUMBERS = {w: _NUMBER[c] for w, c in _CLASS.items()}
_OTHER, _INSULT, _HARM = (_NUMBER[c] for c in ("other", "insult", "harm"))


@dataclass
class Grammar:
    """Insult stems with weights and the model's coefficients, read by the composed machines."""

    weights: dict[str, float]
    center: list[float] = field(default_factory=lambda: [0.0] * len(TRACKS))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(TRACKS))
    coefficients: list[float] = field(default_factory=lambda: [0.8, 0.2, 0.3, 0.5, 2.0, 0.3])
    intercept: float = -2.5

    def automaton(self) -> ahocorasick.Automaton:
        """Finds places of stems and of words of harm in lower-cased text."""
        found = ahocorasick.Automaton()
        for key in {s.rstrip("$") for s in self.weights} | set(HARM):
            if key:
                found.add_word(key, len(key))
        if len(found):
            found.make_automaton()
        return found

    def weight(self, word: str) -> float:
        return max((self.weights.get(s, 0.0) for s in stems(word)), default=0.0)

    def classes(self, words: list[str]) -> tuple[list[int], list[float]]:
        """The number of each word's class, and its weight as an insult."""
        kinds, weights = [], []
        for word in words:
            kind = _NUMBERS.get(word, _OTHER)
            weight = self.weight(word) if kind in (_OTHER, _HARM) else 0.0
            kinds.append(kind + 1 if weight > 0 else kind)  # other, harm: insult, harmful insult
            weights.append(weight)
        return kinds, weights

    def clause(self, words: list[str], tracks: list[float]) -> None:
        """Add what the accepted path of the composed machine writes for one clause."""
        kinds, weights = self.classes(words)
        for state in STARTS:
            wrote = []
            for kind, weight in zip(kinds, weights):
                if (arc := ARCS[state][kind]) is None:
                    break
                state, out = arc
                if out:
                    wrote += [(track, constant + share * weight) for track, constant, share in out]
            else:
                if ACCEPTING[state]:
                    for track, value in wrote:
                        tracks[track] += value
                    tracks[5] = max(tracks[5], sum(value for track, value in wrote if track in (0, 3, 4)))
                    return

    def tracks(self, text: str, found: ahocorasick.Automaton) -> list[float]:
        """What the grammar writes for a text: one number a track."""
        out = [0.0] * len(TRACKS)
        lower = text.lower()
        if len(found) == 0:
            return out
        done = -1
        for end, length in found.iter(lower):
            start = end + 1 - length
            if start < done or start and (lower[start - 1].isalpha() or lower[start - 1] == "'"):
                continue
            low = 1 + max(lower.rfind(c, 0, start) for c in ".!?;\n")
            stop = m.start() if (m := _CLAUSE_END.search(lower, end)) else len(lower)
            self.clause(_WORD.findall(lower, low, stop), out)
            done = stop
        return out

    def score(self, tracks: list[float]) -> float:
        z = self.intercept + sum(c * (math.log1p(t) - m) / s for c, t, m, s in zip(self.coefficients, tracks, self.center, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def _count_stems(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({s for w in set(_WORD.findall(text.lower())) for s in stems(w)})
        keys = list(counts[1])  # a stem of no toxic row can't be an insult
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))], ["stem", "positive", "negative"])


def _fit(rows: np.ndarray, labels: np.ndarray, grammar: Grammar) -> Grammar:
    """Logistic regression on the tracks by Newton steps with a ridge."""
    x = np.log1p(rows)
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    x = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
    return Grammar(grammar.weights, center.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def _tracks(shared, names: list[str]):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        found = grammar.automaton()
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in names]
            rows = [grammar.tracks(t, found) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(rows, pa.list_(pa.float64())), pa.array([grammar.score(r) for r in rows])], [*names, "tracks", "score"])

    return read


def fit_grammar(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn insult stems and the model from at most sample_rows labelled rows outside the held-out fold.

    labels: doc_id and toxic (0 or 1; others are ignored). Where a label is missing or all labels are
    the same, the seeds and default coefficients stay. Rows that repeat a doc_id count once, with the least text; so do
    documents of equal texts, as toxic if one of them is.
    """
    with released():
        return _fitted(docs, labels, sample_rows)


def _fitted(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Grammar:
    spark = docs.sparkSession
    seeds = Grammar({w + "$": 4.0 for w in SEEDS})
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    labelled = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = kept_on_disk(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return seeds
    odds = F.log((F.col("positive") + 0.5) / (size[1] + 1.0)) - F.log((F.col("negative") + 0.5) / (size[0] + 1.0))
    learned = (
        rows.mapInArrow(_count_stems, "stem string, positive long, negative long").groupBy("stem").agg(F.sum("positive").alias("positive"))
        .where(F.col("positive") >= min(LEAST_POSITIVE, max(size[1] // 8, 2)))
    )
    # The negatives of a batch without a positive were not counted there, so they are counted again for these stems.
    kept = [r["stem"] for r in learned.orderBy(F.desc("positive"), "stem").limit(20 * MOST_STEMS).collect()]
    shared = spark.sparkContext.broadcast(frozenset(kept))

    def recount(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({s for w in set(_WORD.findall(text.lower())) for s in stems(w)} & shared.value)
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))], ["stem", "positive", "negative"])

    table = rows.mapInArrow(recount, "stem string, positive long, negative long").groupBy("stem").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).withColumn("odds", odds)
    best = table.where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(F.desc("odds"), "stem").limit(MOST_STEMS).collect()
    grammar = Grammar(seeds.weights | {r["stem"]: r["odds"] for r in best})
    found = rows.mapInArrow(_tracks(spark.sparkContext.broadcast(grammar), ["toxic"]), "toxic int, tracks array<double>, score double").select("toxic", "tracks").toPandas()
    return _fit(np.array(found["tracks"].tolist()), found["toxic"].to_numpy(float), grammar)


def score_toxicity(docs: DataFrame, grammar: Grammar, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, tracks (an array in the order of TRACKS) and score (0 to 1) of every document.

    A null or empty text has empty tracks and the score of a text without matches. Null doc_ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", *keep]
    kinds = dict(docs.dtypes) | {"doc_id": "long"}
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(x for x in keep if x != "text"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    return docs.select(*columns).mapInArrow(_tracks(shared, names), ", ".join([*(f"`{x}` {kinds[x]}" for x in names), "tracks array<double>, score double"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from the labels outside the held-out fold."""
    scored = score_toxicity(docs, fit_grammar(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
