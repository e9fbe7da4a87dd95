import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.line_dedup import drop_repeated_lines
from palimpsest.llm.near_dedup import _dealt, _links_of, components, near_duplicates
from palimpsest.llm.suffix_dedup import _radix, remove_repeats


def sha(b):
    return hashlib.sha256(b).hexdigest()


def removed(rows, window):
    """Kept bytes and spans by brute force; rows of one doc_id share their places."""
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - window + 1):
                w = b[p : p + window]
                first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - window + 1):
                if first[b[p : p + window]] < (i, p):
                    gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


@pytest.mark.parametrize("window,anchor,most", [(100, 32, 20_000), (20, 8, 20_000), (20, 8, 2)])
def test_suffix_dedup_against_brute_force(docs, rows, window, anchor, most):
    unique = [(i, t) for i, t in rows if i != 20]  # two texts of one id have places in common: see the docstring
    found = remove_repeats(docs.where("doc_id is null or doc_id != 20"), window, anchor, with_bytes=False, most_runs=most).collect()
    assert Counter(tuple(r) for r in found) == Counter(removed(unique, window))


def test_suffix_dedup_of_groups_over_many_batches(spark, docs, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        test_suffix_dedup_against_brute_force(docs, rows, 20, 8, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_large_anchor_group_is_not_held():
    taken = 0

    def batches(anchors):
        nonlocal taken
        for low in range(0, len(anchors), 2):
            taken += 1
            part = range(low, min(low + 2, len(anchors)))
            yield pa.RecordBatch.from_arrays([pa.array([anchors[k] for k in part]), pa.array(list(part)), pa.array([0 for _ in part]), pa.array([b"x%03d" % k + b"y" * 20 for k in part])], ["anchor", "doc_id", "start", "bytes"])

    out = _radix(20, 5)(batches([1] * 3 + [2] * 40 + [3] * 3))
    assert next(out).column("one").null_count == 0 or next(out).column("one").null_count == 0
    assert taken <= 6
    rest = list(out)
    singles = {d for b in rest for d, one in zip(b.column("doc_id").to_pylist(), b.column("one").to_pylist()) if one is not None}
    assert singles >= set(range(12, 43)) and not singles & {0, 1, 2, 43, 44, 45}


def test_suffix_dedup_carries_columns_and_takes_empty_tables(docs, rows, empty):
    assert remove_repeats(empty).count() == 0
    out = remove_repeats(docs, keep=("lang", "source"))
    assert out.columns == ["doc_id", "lang", "source", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
    assert out.count() == len(rows)


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 16])
def test_line_dedup_against_brute_force(docs, rows, most_bits):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    wanted = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        wanted.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    found = drop_repeated_lines(docs, with_text=False, most_bits=most_bits).collect()
    assert Counter(tuple(r) for r in found) == Counter(wanted)
    assert sum(r["n_dropped"] for r in found) > 0


def test_line_dedup_of_an_empty_table(empty):
    assert drop_repeated_lines(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("block_bytes,block", [(8 << 20, 256), (8 << 20, 2), (5000, 256), (1, 2)])
def test_near_dedup_against_brute_force(spark, docs, rows, block_bytes, block):
    extra = [(100 + k, " ".join(f"w{j}" for j in range(200) if j != 7 * k)) for k in range(12)]
    # Two families that a chain of near copies may or may not join: links within groups of several components.
    extra += [(200 + 20 * f + k, " ".join(f"v{j}" for j in range(f * 6, 200 + f * 6) if j != 60 + 5 * k)) for f in range(4) for k in range(8)]
    every = [(i, t) for i, t in rows if i not in (20, 21, None)] + extra
    table = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in every}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(table, block_bytes=block_bytes, block_docs=block).collect()}
    assert found == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_links_between_blocks_are_a_spanning_forest_of_all():
    rng = np.random.default_rng(3)
    pools = [rng.choice(300, 60, replace=False) for _ in range(5)]
    sets = [np.sort(rng.choice(pools[k % 5], 57, replace=False)).astype(np.uint64) for k in range(60)]
    sets += [np.sort(rng.choice(400, int(rng.integers(1, 200)), replace=False)).astype(np.uint64) for _ in range(30)]
    size, component = np.array([len(s) for s in sets]), np.array([k // 2 * 2 for k in range(90)])

    def joined(links):
        root = dict.fromkeys(component.tolist())
        root = {c: c for c in root}
        find = lambda c: c if root[c] == c else find(root[c])
        for a, b in links:
            x, y = find(component[a].item()), find(component[b].item())
            root[max(x, y)] = min(x, y)
        return [find(c) for c in component.tolist()]

    every = [(a, b) for a in range(90) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    for block_docs in (1, 7, 256):
        links = _links_of(np.arange(90), component, np.concatenate(sets), size, 85, block_docs)
        assert {(max(x), min(x)) for x in links} <= set(every) and joined(links) == joined(every)
        assert len(links) == len(set(component.tolist())) - len(set(joined(every)))


def test_blocks_of_one_component_never_meet(spark):
    """Each two documents of different components share a task; copies grow with the number of blocks, not of documents."""
    rows = [(1, k, 0 if k < 300 else 1000 if k < 600 else k, 1024) for k in range(640)] + [(2, k, 7, 1024) for k in range(700, 720)]
    grouped = spark.createDataFrame(rows, "least long, id long, component long, n_bytes long")
    for block_bytes in (1 << 30, 100 * 1024, 10 * 1024):
        tasks = defaultdict(set)
        dealt = _dealt(grouped, block_bytes).collect()
        for r in dealt:
            tasks[r["task"]].add((r["id"], r["component"]))
        met = {(a, b) for docs in tasks.values() for a, x in docs for b, y in docs if a < b and x != y}
        assert met == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] == 1 and a[1] < b[1] and a[2] != b[2]}
        most = 640 * 1024 / block_bytes + 3
        assert len(dealt) <= 640 * 1.2 * most and not any(i >= 700 for docs in tasks.values() for i, _ in docs)
        if block_bytes < 1 << 20:
            pure = [docs for docs in tasks.values() if len({c for _, c in docs}) == 1]
            assert not any({0} == {c for _, c in docs} or {1000} == {c for _, c in docs} for docs in pure)


def test_near_dedup_keeps_every_row(docs, rows, empty):
    assert near_duplicates(docs).count() == len(rows)
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(edges).collect()} == {0}


def test_line_filter_notes_region_by_region(monkeypatch):
    from palimpsest.llm import line_dedup

    monkeypatch.setattr(line_dedup, "REGIONS_A_BATCH", 3)
    lines = ["a line of more than twenty characters %d" % (k % 40) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(lines)], ["doc_id", "text"])
    size = 16 * line_dedup.REGION
    noted = [r for b in line_dedup._note(size, 20)(iter([batch])) for r in b.to_pylist()]
    hashes = line_dedup._hashes([x.encode() for x in lines], 20)
    bits = {int(b) for b in line_dedup._bits(hashes, size).ravel()}
    assert {r["region"] * line_dedup.REGION + int(b) for r in noted for b in np.frombuffer(r["once"], np.uint16)} == bits
    twice = {int(b) for h in set(hashes[:20].tolist()) for b in line_dedup._bits(np.array([h], np.uint64), size).ravel()}
    assert {r["region"] * line_dedup.REGION + int(b) for r in noted for b in np.frombuffer(r["twice"], np.uint16)} >= twice


def test_hot_lines_join_as_the_others(spark, monkeypatch):
    from palimpsest.llm import line_dedup

    hot, rare = "this line is in all of the documents here", "this line is in a few of the documents here"
    rows = [(k, "\n".join([hot, f"own line number {k} of this document"] + [rare] * (k % 7 == 0))) for k in range(70)]
    out = {}
    for keys in (1, 10**9):  # none is hot, all are
        monkeypatch.setattr(line_dedup, "HOT_KEYS", keys)
        out[keys] = sorted(tuple(r) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[1] == out[10**9] and sum(r[2] for r in out[1]) == 69 + 9


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_hashes_tell_thue_morse_words_apart(spark):
    from palimpsest.llm.suffix_dedup import _BASES, _PRIME, _Substrings, _times

    p = int(_PRIME)
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, p, 500, dtype=np.uint64) for _ in range(2))
    assert [int(z) for z in _times(x, y)] == [int(a) * int(b) % p for a, b in zip(x, y)]
    data = np.frombuffer(b"the same words, the same hashes; the same words, the others", np.uint8)
    for which in (0, 1):
        h = _Substrings(data, which)
        assert h.sums[7] == sum((int(c) + 1) * pow(_BASES[which], k, p) for k, c in enumerate(data[:7])) % p
        again = _Substrings(np.concatenate([data, data]), which, step=7)
        a, b = np.array([0, 4]), np.array([14, 14])
        assert (h(a, b) == h(a + 33, b + 33)).all() and (h(a, b) == again(a + len(data), b + len(data))).all() and len({*h(a, b).tolist()}) == 2
    one = thue_morse(1024)
    other = one.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(0, one), (1, other), (2, f"{one} b c d e f"), (3, f"{other} b c d e f"), (4, one.upper())], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (2, True), 3: (3, True), 4: (0, False)}


def test_groups_by_digits():
    from palimpsest.llm.suffix_dedup import _groups

    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    for window in (3, 8, 21, 100):
        begin = rng.permutation(len(data) - window + 1)
        texts = [data[b : b + window].tobytes() for b in begin]
        group = _groups(data, begin, window)
        first = {}
        assert [first.setdefault(t, g) for t, g in zip(texts, group.tolist())] == group.tolist() and len(first) == len(set(group.tolist()))
    assert not len(_groups(np.zeros(2, np.uint8), np.zeros(0, np.int64), 100))
