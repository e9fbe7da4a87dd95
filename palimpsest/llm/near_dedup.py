"""MinHash near-dedup with tensored banding, every link confirmed on full sets.

Table keys are not computed from hash functions of their own: two small
collections of HALF_KEYS half keys (ROWS_A_HALF minhashes each) are made, and a
table is a pair of a half key of one and a half key of the other. So
2 * HALF_KEYS * ROWS_A_HALF minhashes serve HALF_KEYS ** 2 tables. With the
defaults, a pair at similarity 0.85 meets in no table with probability 1.5e-4.

Documents with equal sets are one class and are linked without being compared.
Between classes, each table bucket first compares all its members with its least
one only; the links make components. Documents that share a bucket's least member
and are not all in one component by then are compared in blocks of about BLOCK_BYTES
of shingles. A component that fills a block has blocks of its own, which never meet
each other. A task gets two blocks, counts the intersections of their sets by matrix
products of BLOCK_DOCS documents each, leaving out those of one component and those
whose sizes rule a link out, and gives a spanning forest of the links. So no link is
assumed or capped, and no list of a group's pairs is ever made. Components come
from label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import _MIX, _mixed, _Substrings
from .textblocks import blocks, byte_view, checkpointed, give_up, ids_and_texts, kept_on_disk, until_result_ends

SHINGLE_WORDS = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 85
HALF_KEYS = 10
ROWS_A_HALF = 3
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 256
#: A document counts as this many bytes at least, so that blocks of short ones have at most 8,192.
LEAST_BYTES = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, back to back, and the n + 1 offsets of the rows.

    A-Z count as a-z; words are runs of bytes other than ASCII white space. A row with fewer words
    than a shingle has its whole sequence as one; one without words has none.
    """
    n = len(offsets) - 1
    blank = _BLANK[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[:-1] = ~blank
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inner[:-1]
    before[offsets] = False
    start = np.flatnonzero(inner & ~before)
    after = np.append(inner[1:], False)
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    stop = np.flatnonzero(inner & ~after) + 1
    lower = _LOWER[data]
    # Words are hashed modulo a prime; a shingle mixes five of them to 64 bits.
    one = _mixed(_Substrings(lower, 0)(start, stop) + (stop - start).astype(np.uint64))
    bounds = np.searchsorted(start, offsets)  # of the rows' words
    many = np.diff(bounds)
    size = np.where(many == 0, 0, np.maximum(many - words + 1, 1))
    row = np.repeat(np.arange(n), size)
    first = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + bounds[:-1][row]
    short = np.minimum(many[row], words)
    shingles = short.astype(np.uint64)
    for k in range(words):
        there = k < short
        word = np.where(there, one[np.minimum(first + k, max(len(one) - 1, 0))], 0) if len(one) else np.zeros(0, np.uint64)
        shingles = _mixed(shingles * _MIX + word.astype(np.uint64))
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    shingles, row = shingles[fresh], row[fresh]
    return shingles, np.searchsorted(row, np.arange(n + 1))


def _signatures(words: int, half_keys: int, rows: int):
    seeds = np.random.default_rng(85).integers(0, 2**63, (2, half_keys, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["doc_id", "n_shingles", "set_1", "set_2", "left", "right"]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2 << 20):
            shingles, bounds = shingle_sets(*byte_view(block.column(1)), words)
            some = np.flatnonzero(np.diff(bounds))
            size = np.diff(bounds)
            sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
            halves = [np.zeros((len(some), half_keys), np.uint64) for _ in range(2)]
            if len(some):
                at = bounds[:-1][some]
                for k, salt in enumerate((0x1234567, 0x7654321)):
                    sums[k][some] = np.add.reduceat(_mixed(shingles ^ np.uint64(salt)), at)
                for side in range(2):
                    for key in range(half_keys):
                        for r in range(rows):
                            # The high bits of a product by an odd number order the shingles anew.
                            least = np.minimum.reduceat((shingles ^ (shingles >> np.uint64(31))) * seeds[side, key, r] ^ seeds[side, key, r], at)
                            halves[side][:, key] = _mixed(halves[side][:, key] * _MIX + least)
            columns = [block.column(0), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums)]
            has = np.concatenate(([0], np.cumsum(size > 0))) * half_keys
            columns += [pa.ListArray.from_arrays(pa.array(has, pa.int32()), pa.array(h.ravel().view(np.int64))) for h in halves]
            yield pa.RecordBatch.from_arrays(columns, names)

    return sign


def _confirm(words: int, percent: int):
    """(a, b, text_a, text_b) to the pairs whose full sets are similar enough."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            known: dict[bytes, np.ndarray] = {}
            texts = [batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)]
            for i, (one, two) in enumerate(zip(*texts, strict=True)):
                sets = []
                for text in (one, two):
                    if text not in known:
                        if len(known) > 256:
                            known.clear()
                        known[text] = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)[0]
                    sets.append(known[text])
                common = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32()))], ["a", "b"])

    return confirm


def _intersections(sets: np.ndarray, row: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of n sets; sets are numbers of shingles, row says whose each is."""
    many = np.bincount(sets) if len(sets) else np.zeros(1, np.int64)
    column = (np.cumsum(many > 1) - 1)[sets]
    row, column = row[many[sets] > 1], column[many[sets] > 1]
    common = np.zeros((n, n), np.float32)
    dense = np.zeros((n, width), np.float32)
    for low in range(0, int(np.count_nonzero(many > 1)), width):
        here = (column >= low) & (column < low + width)
        dense[:] = 0
        dense[row[here], column[here] - low] = 1
        common += dense @ dense.T
    return common


def _links_of(ids: np.ndarray, component: np.ndarray, sets: np.ndarray, size: np.ndarray, percent: int, block_docs: int = BLOCK_DOCS) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components among the documents."""
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    # Shingles that two documents have get numbers; others can't be in an intersection.
    row = np.repeat(np.arange(len(size)), size)
    _, number, many = np.unique(sets, return_inverse=True, return_counts=True)
    row, number = row[many[number] > 1], (np.cumsum(many > 1) - 1)[number][many[number] > 1]
    order = np.lexsort((size, component))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_place = np.argsort(place[row], kind="stable")
    row, number = place[row][by_place], number[by_place]
    ids, component, size = ids[order], component[order], size[order]
    cuts = list(range(0, len(ids), block_docs)) + [len(ids)]
    edges = np.searchsorted(row, cuts)
    parts = [(slice(i, j), slice(e, f), np.unique(component[i:j]).tolist()) for i, j, e, f in zip(cuts, cuts[1:], edges, edges[1:])]
    out = []
    for k, (docs, has, roots) in enumerate(parts):
        for docs_2, has_2, roots_2 in parts[k:]:
            if len({find(c) for c in (*roots, *roots_2)}) == 1:
                continue
            if 100 * size[docs].max() < percent * size[docs_2].min() or 100 * size[docs_2].max() < percent * size[docs].min():
                continue
            both = [(docs, has)] if docs is docs_2 else [(docs, has), (docs_2, has_2)]
            who = np.concatenate([np.arange(d.start, d.stop) for d, _ in both])
            shift = np.concatenate([row[h] - d.start + (docs.stop - docs.start if n else 0) for n, (d, h) in enumerate(both)])
            common = _intersections(np.concatenate([number[h] for _, h in both]), shift, len(who))
            union = size[who][:, None] + size[who][None, :] - common
            one, two = np.nonzero(np.triu((100 * common >= percent * union) & (component[who][:, None] != component[who][None, :]), 1))
            for i, j in zip(who[one].tolist(), who[two].tolist(), strict=True):
                a, b = find(component[i].item()), find(component[j].item())
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i].item(), ids[j].item()))
    return out


def _compare_blocks(words: int, percent: int, block_docs: int):
    """Rows (task, id, component, text) sorted by task to links; of a text only its set is held."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            links = _links_of(*(np.concatenate(x) for x in zip(*held, strict=True)), percent, block_docs)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for block in blocks(batches, 2 << 20):
            task, ids, component = (block.column(k).to_numpy() for k in range(3))
            sets, bounds = shingle_sets(*byte_view(block.column(3)), words)
            edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for i, j in zip(edges, edges[1:]):
                if held and task[i] != now:
                    yield flush()
                    held = []
                now = task[i]
                held.append((ids[i:j], component[i:j], sets[bounds[i] : bounds[j]], np.diff(bounds[i : j + 1])))
        if held:
            yield flush()

    return compare


def _dealt(grouped: DataFrame, block_bytes: int) -> DataFrame:
    """(least, id, component, n_bytes) of groups with several components to (task, id, component), a task for each two blocks to compare."""
    shares = grouped.groupBy("least", "component").agg(F.sum("n_bytes").alias("n_bytes"))
    large = F.col("n_bytes") >= block_bytes
    whole = shares.groupBy("least").agg(F.sum(F.when(~large, F.col("n_bytes"))).alias("rest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    count = lambda n: F.greatest(F.ceil(n / block_bytes), F.lit(1)).cast("int")
    shares = shares.join(whole, "least").select("least", "component", F.when(large, F.col("component")).alias("own"), F.when(large, count(F.col("n_bytes"))).otherwise(count(F.col("rest"))).alias("parts"))
    every = shares.select("least", "own", "parts").distinct().withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("least", "own", "part")
    key = F.struct(F.col("own").isNull(), F.coalesce("own", F.lit(0)), F.col("part"))
    every = every.select("least", "own", key.alias("block"))
    # Two blocks of one large component never meet; a block of small ones meets itself.
    met = every.join(every.select("least", F.col("own").alias("own_2"), F.col("block").alias("block_2")), "least").where("block <= block_2 and (own is null or own_2 is null or own != own_2)")
    tasks = met.select("least", F.xxhash64("least", "block", "block_2").alias("task"), F.explode(F.array_distinct(F.array("block", "block_2"))).alias("block"))
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("component")).otherwise(F.col("id"))), F.col("parts")).cast("int")
    placed = grouped.join(shares, ["least", "component"]).withColumn("part", part).select("least", "id", "component", key.alias("block"))
    return placed.join(tasks, ["least", "block"]).select("task", "id", "component")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b): the least id that is reachable."""
    both = kept_on_disk(edges.select("a", "b").union(edges.select("b", "a")))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("hooked"))
        target = labels.select(F.col("id").alias("hooked"), F.col("component").alias("jump"))
        labels = checkpointed(hooked.join(target, "hooked", "left").select("id", F.least("hooked", F.coalesce("jump", "hooked")).alias("component"), F.col("component").alias("was")))
        if labels.where("component != was").isEmpty():
            give_up(both)  # the labels are checkpointed and need it no more
            return labels.select("id", "component")
        labels = labels.select("id", "component")


@until_result_ends
def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, half_keys: int = HALF_KEYS, rows: int = ROWS_A_HALF, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Groups of near-duplicate documents.

    Returns doc_id, n_shingles (size of its set), component_id (the least doc_id reachable over
    links) and kept (doc_id = component_id). Documents without words, null texts among them, are
    linked with nothing. Rows that repeat a doc_id are one node each with the texts they have; a
    null doc_id has a null component and is kept. Other columns are ignored; an empty table gives
    no rows. Candidates come from table collisions; all of them are confirmed on full sets.
    """
    texts = ids_and_texts(docs)
    signed = kept_on_disk(texts.mapInArrow(_signatures(words, half_keys, rows), "doc_id long, n_shingles long, set_1 long, set_2 long, left array<long>, right array<long>"))
    placed = signed.where("n_shingles > 0 and doc_id is not null")
    classes = kept_on_disk(
        placed.groupBy("set_1", "set_2").agg(F.min(F.struct("doc_id", "n_shingles", "left", "right")).alias("r")).select("set_1", "set_2", "r.*").withColumnRenamed("doc_id", "id")
    )
    # Half keys that only one class has open no table.
    entries = lambda side, n: F.transform(n, lambda v, i: F.struct(F.lit(side).alias("side"), i.alias("half"), v.alias("value")))
    halves = classes.select("id", F.explode(F.concat(entries(0, "left"), entries(1, "right"))).alias("h")).select("id", "h.*")
    shared = halves.groupBy("side", "half", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    open_ = halves.join(shared, ["side", "half", "value"]).groupBy("id").agg(
        *(F.collect_list(F.when(F.col("side") == s, F.struct("half", "value"))).alias(side) for s, side in enumerate(("left", "right")))
    )
    tables = open_.withColumn("l", F.explode("left")).withColumn("r", F.explode("right")).select("id", F.xxhash64("l.half", "l.value", "r.half", "r.value").alias("table"))
    buckets = tables.groupBy("table").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = checkpointed(tables.join(buckets, "table").select("id", "least").distinct().join(classes.select("id", "n_shingles"), "id"))

    # The texts of the documents that share a table with another, read once for both rounds.
    used = members.select(F.col("id").alias("doc_id")).distinct()
    own = kept_on_disk(texts.join(used, "doc_id", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        out = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return out.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long")

    sizes = classes.select(F.col("id").alias("least"), F.col("n_shingles").alias("n_least"))
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  else no union can be small enough
    first = members.where("id != least").join(sizes, "least").where(alike(F.col("n_shingles"), F.col("n_least")))
    links = checkpointed(confirmed(first.select(F.col("least").alias("a"), F.col("id").alias("b"))))
    labels = components(links)

    # Any two that share a table share its least member. Groups by it that are in one component are done.
    weight = F.greatest(F.col("n_shingles") * 8, F.lit(LEAST_BYTES)).alias("n_bytes")
    grouped = members.join(labels, "id", "left").select("least", "id", F.coalesce("component", "id").alias("component"), weight)
    mixed = grouped.groupBy("least").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("least")
    grouped = checkpointed(grouped.join(mixed, "least"))
    texted = _dealt(grouped, block_bytes).join(own.select(F.col("doc_id").alias("id"), "text"), "id").select("task", "id", "component", "text")
    compared = texted.repartition("task").sortWithinPartitions("task").mapInArrow(_compare_blocks(words, percent, block_docs), "a long, b long")
    more = checkpointed(compared)
    give_up(own)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    found = classes.select("set_1", "set_2", "id").join(labels, "id", "left").select("set_1", "set_2", F.coalesce("component", "id").alias("component"))
    return signed.join(found, ["set_1", "set_2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))).otherwise(F.lit(True)).alias("kept"),
    )
