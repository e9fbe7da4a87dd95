"""op11 to op13 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as N
from palimpsest.llm import spelling as S
from palimpsest.llm.personal import FORMS, KINDS, matches, personal_spans, scored_instances

VECTORS = "vec_id long, embedding array<float>, label int, vector string, rank int, cell int"


def mined(rows, anchors, positives=5, negatives=10):
    """Brute force over (vec_id, label, integer vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in rows:
        if i in anchors:
            best = lambda same: sorted(((-dot(v, w), j) for j, other, w in rows if j != i and (other == label) == same))
            for ps, p in best(True)[:positives]:
                window = [(ns, n) for ns, n in best(False) if -30 * ps <= -100 * ns <= -90 * ps]
                out |= {(i, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(window[:negatives])}
    return out


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(4, 6))
    data = [(int(i), [float(x) for x in middle[i % 4] + 0.3 * rng.normal(size=6)], int(i % 3), "clash", 1, 2) for i in range(300)]
    data += [(1000 + i, data[7][1], i % 3, None, None, None) for i in range(90)]  # one vector many times
    data += [(7, data[7][1], 0, "again", 0, 0), (2000, None, 1, "", 0, 0), (2001, [1.0, None], 1, "", 0, 0), (2002, [math.inf, 0.0], 1, "", 0, 0), (2003, [math.nan], 1, "", 0, 0), (2004, [1.0], None, "", 0, 0), (None, [1.0], 1, "", 0, 0), (2005, [], 1, "", 0, 0), (2010, [0.5, 0.25], 2, "", 0, 0)]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    clean = N.scaled(df)
    own = {}
    for i, v, label, *_ in data:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
            own[i] = min(own.get(i, row), row)
    rows = [(i, label, v) for i, (label, v) in own.items()]
    assert sorted((r[0], r[1], r[2]) for r in clean.collect()) == sorted(rows)
    want = mined(rows, {i for i in own if i % 10 == 0})
    for block_rows, a_task in ((4096, 4096), (40, 7)):
        got = N.hard_negatives(clean, F.col("vec_id") % 10 == 0, block_rows=block_rows, anchors_a_task=a_task).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert N.hard_negatives(clean.where("false"), F.col("vec_id") % 10 == 0).isEmpty()
    assert N.hard_negatives(clean, F.col("vec_id") == -1).isEmpty()
    with pytest.raises(ValueError, match="squared norm"):
        N.hard_negatives(spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label long, vector array<long>"), F.lit(True))


def test_cover_tree_skips_nodes_and_holds_its_radii():
    rng = np.random.default_rng(4)
    points = np.floor(np.repeat(rng.normal(size=(40, 8)) * 400, 25, axis=0) + rng.normal(size=(1000, 8)) * 9)
    norm = float((points**2).sum(1).max()) + 1
    tree = N.CoverTree(points, np.arange(1000), np.zeros(1000, int), norm, leaf_rows=8)
    space = N.Space(points, norm)

    def under(node):
        if tree.below[node] is None:
            return tree.rows[node].tolist()
        assert max(space.gaps_to(tree.center[node])[tree.center[tree.below[node]]]) <= tree.radius[node] + 1e-6
        return [r for k in tree.below[node] for r in under(k)]

    assert sorted(under(0)) == list(range(1000)) and len(tree.center) > 40
    for node in range(len(tree.center)):
        assert space.gaps_to(tree.center[node])[under(node)].max() <= tree.radius[node] + 1e-6
    seen = 0
    for q in points[::50]:
        score = points @ q
        low, high = np.quantile(score, [0.5, 0.8])
        (top, mid), n = tree.best(q, -1, 0, True, [(-(2**62), 2**62), (math.ceil(low), math.floor(high))], 10)
        seen += n
        rank = lambda ok: [(int(-s), i) for s, i in sorted((-score[i], i) for i in np.flatnonzero(ok))[:10]]
        assert top == rank(score == score) and mid == rank((score >= low) & (score <= high))
    assert seen < 0.5 * 20 * 1000  # what it verifies, of all rows


def spelled(docs, least=5, least_n=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(others, default=None)
        out[w] = [best[1] if best and -best[0] >= 2 * n else None, None, n, len(others), -best[0] if best and -best[0] >= 2 * n else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {(w, *x) for w, x in out.items()}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeé") for _ in range(k % 4 + 4)) for k in range(60)] + ["aaaaab", "aaaab", "aaaaa", "ÄÖÜäöü", "äöüäö", "ÿÿÿÿÿ", "zzzzzzzz"]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1 :]])

    docs = [(i, " ".join(typo(rng.choice(stems[: 5 + i])) for _ in range(200))) for i in range(40)]
    docs += [(100, None), (101, ""), (None, "nulls nulls nulls Nulls"), (102, "x" * 5000), (102, "x" * 5000), (103, "x" * 5000 + "y"), (104, "12 -- 中文 é"), (105, "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷")]
    docs += [(106, "y" * 4000 + "x")] * 3 + [(107, "y" * 4000 + "z")] * 4
    df = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in docs], "doc_id long, text string, word string, n int, root string").repartition(3)
    want = spelled(docs)
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    for pass_bits in (S.PASS_BITS, 2000):  # the latter in several passes
        got = S.spelling_variants(df, pass_bits=pass_bits)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert S.spelling_variants(df.where("false")).isEmpty()


def test_filters_know_all_their_words_and_few_others():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(5000)})
    filters = S.Filters({9: len(words)}, 1, 0)
    bits = np.zeros(filters.n_bits, np.uint8)
    bits[filters.spots(words).astype(np.int64)] = 1
    filters.bits = np.packbits(bits, bitorder="little")
    assert len(filters.has(S.word_hashes(words), 9)) == len(words)
    others = ["".join(rng.choice("ijklmnop") for _ in range(9)) for _ in range(5000)]
    assert len(filters.has(S.word_hashes(others), 9)) < 50 and not len(filters.has(S.word_hashes(others), 8))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fixed(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum((lambda v: v if k % 2 == 0 else 2 * v - 9 * (v > 4))(int(c)) for k, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_fixed_kinds_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["a.b", "@", "x-1", ".com", ".", "..", "é", "😀", " ", "-", "+", "+1", "(", ")", "12", "4111111111111111", "4111 1111-1111 1111", "256", "1.2.3.4", "01.002.0003.255", "_", "%", "9" * 20, "\n", "378282246310005", "555-12 34", "user_1@mail.example.org"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.fg", "x@y@z.a", "1.2.3.4.5.6.7.8", "9" * 4000, "a" * 4000 + "@b.c", "a." * 2000 + "@b.c", "1 " * 2000, "+1" + " " * 4000, ("user@mail.org 10.0.0.1 é " * 3000)]
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, spans string, base string").repartition(4)
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in personal_spans(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == fixed(t), (k, (t or "")[:80])


def test_long_runs_are_read_once(spark):
    million = 1_000_000
    texts = ["9" * million, "a" * million, "a" * million + "@b.c", "a." * (million // 2), "1 " * (million // 2), "+1" + " " * million, "!" * million + "12", "x12!!" * (million // 5), "1." * (million // 2)]
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # Of `1.` again and again, every four parts are an address.
    assert [len(got[k]) for k in range(9)] == [0, 0, 1, 0, 0, 0, 0, 0, million // 8] and got[2] == [("email", 0, million + 4)]
    assert got[8][:2] == [("ip", 0, 7), ("ip", 8, 15)] and got[8][-1] == ("ip", million - 8, million - 1)


def test_matches_start_where_they_are(spark):
    text = "é12 x345\n6" * 700
    (row,) = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "[0-9]+").alias("m")).collect()
    want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert [(m["start"], m["stop"], m["value"]) for m in row["m"]] == want and len(want) > 2 * 700
    assert not re.search("cross", " ".join(FORMS))


def scores(rows, rounds=3, support=3, accept=0.8, weight=2.8, unknown=0.25):
    """Brute force over (node, state, patterns)."""
    state, edges = {}, defaultdict(set)
    for node, s, patterns in rows:
        for p in patterns:
            edges[p].add(node)
    for p, nodes in edges.items():
        for node in nodes:
            state[p, node] = max((s for n, s, ps in rows if n == node and p in ps and s is not None), default=None)
    accepted = {}
    for _ in range(rounds):
        known = {}
        for p, nodes in edges.items():
            held = [accepted.get(n, 0.0) if state[p, n] is None else float(state[p, n]) for n in nodes]
            all_ = sum(accepted.get(n, unknown) if state[p, n] is None else 1.0 for n in nodes)
            if sum(h > 0 for h in held) >= support:
                known[p] = (sum(held) / (all_ + 1), math.log1p(sum(h > 0 for h in held)))
        met = defaultdict(list)
        for p, (c, w) in known.items():
            for n in edges[p]:
                if state[p, n] is None:
                    met[n].append((c, w))
        accepted = {n: round(sum(c * w for c, w in x) / sum(w for _, w in x), 9) for n, x in met.items()}
        accepted = {n: s for n, s in accepted.items() if s >= accept and sum(w for _, w in met[n]) >= weight}
    return accepted


def test_pattern_graph_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(n, rng.choice([1, 1, 1, 0, None, None]), sorted({f"p{min(int(rng.expovariate(0.4)), 9)}" for _ in range(3)})) for n in range(200)]
    rows += [(1000 + n, 1, ["sure", "label x="]) for n in range(40)] + [(2000 + n, None, ["sure", "own"]) for n in range(6)] + [(3000, None, ["own", "label x="])]
    got = {r["node"]: r["score"] for r in scored_instances(spark.createDataFrame(rows, "node long, state int, patterns array<string>")).collect()}
    want = scores(rows)
    assert set(got) == set(want) and 3000 in got and all(abs(got[n] - want[n]) < 1e-8 for n in want)


def test_context_finds_unseen_identifiers(spark):
    seeds = [(k, f"Please write to user{k}@mail.example.org today. Lines follow.") for k in range(40)]
    unseen = [(100, "Please write to @handle_77 today."), (101, "é 😀 Please write to member=\"AB12345\", today ok"), (102, "Numbers like 1234567 are nothing. Nor is write-up 20240101."), (103, None), (104, ""), (None, "Please write to @other_88 today.")]
    late = [(200 + k, f"somewhere member=Q{k}Z00{k}, said someone") for k in range(5)]
    traps = [(300, "Please write to 4111111111111112 today.")]  # a card's form that fails its check
    more = [(400 + k, f"Please write to member=\"XX{k}000{k}\" today.") for k in range(20)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in seeds + unseen + late + traps + more], "doc_id long, text string, node string").repartition(3)
    rows = {r["doc_id"]: r for r in personal_spans(df).collect()}
    text = dict(seeds + unseen + late + traps + more)
    found = lambda i: [text[i][s["start"] : s["stop"]] for s in rows[i]["found"]]
    assert found(100) == ["handle_77"] and found(101) == ["AB12345"] and found(None) == ["other_88"]
    assert [found(200 + k) for k in range(5)] == [[f"Q{k}Z00{k}"] for k in range(5)]  # by a label that only unseen ones have
    assert not found(102) and not found(103) and not found(104) and not found(300) and all(not found(k) for k in range(40))
    assert personal_spans(df.where("false")).isEmpty()
