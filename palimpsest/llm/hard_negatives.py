"""Hard-negative mining: exact windows of inner products by cover trees over norm-augmented candidates.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm; an anchor q
gets 0 there. So inner products stay as they are, and points within the distance r of a centre c
have inner products with q within r * |q| of c's. That bounds a whole node of a cover tree by
one product.

The top level is a net of at most CELLS centres, taken from a bounded sample of rows; every row goes to
the nearest centre's cell, and a cell's radius is that of all its rows. Cells are cut into blocks of
about BLOCK_ROWS rows, however many rows are alike. A task gets one block and those anchors whose
windows the cell's bound reaches, builds the block's tree (each level's covering radius is that of
the level above divided by BASE), descends best first for each window, skips nodes that lie outside it or
below the anchor's best rows so far, and verifies leaves exactly. Each block gives an anchor its best rows;
the best of these are the result. Anchors are the stated query set: they meet all rows block by block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import checkpointed, default_partitions

#: Centres of the top level, and rows of the sample that they are chosen from.
CELLS = 64
SAMPLE_ROWS = 4096
#: Rows of a block, and anchors that meet it in one task.
BLOCK_ROWS = 4096
ANCHORS_A_TASK = 4096
#: A level's covering radius is BASE times that of the level below it.
BASE = 1.3
#: Rows of a leaf; a node whose children would have fewer on average is a leaf as well.
LEAF_ROWS = 64
#: Squared distances and scores are exact in doubles, and 100 times a score in a long, up to this squared norm.
MOST_NORM = 2.0**50
_ANY = (-(2**62), 2**62)


class Space:
    """Integer points with the coordinate that gives them all the same norm."""

    def __init__(self, points: np.ndarray, norm: float):
        self.points, self.squares = points, np.einsum("ij,ij->i", points, points)
        self.more = np.sqrt(np.maximum(norm - self.squares, 0))

    def __len__(self) -> int:
        return len(self.points)

    def at(self, rows: np.ndarray) -> Space:
        out = Space.__new__(Space)
        out.points, out.squares, out.more = self.points[rows], self.squares[rows], self.more[rows]
        return out

    def gaps(self, center: np.ndarray, square: float, more: float) -> np.ndarray:
        """Distances of all points to a centre; of equal points 0, as the sums of integers are exact."""
        return np.sqrt(np.maximum(self.squares + square - 2 * (self.points @ center), 0) + (self.more - more) ** 2)

    def gaps_to(self, row: int) -> np.ndarray:
        return self.gaps(self.points[row], self.squares[row], self.more[row])


def net(space: Space, first: int, radius: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, farthest first, until every point is within the radius of one or there are `most`; each point's nearest, and how far it is."""
    centers, owner, gap = [first], np.zeros(len(space), np.int64), space.gaps_to(first)
    while len(centers) < most and gap.max() > radius:
        far = int(gap.argmax())
        new = space.gaps_to(far)
        closer = new < gap
        owner[closer], gap[closer] = len(centers), new[closer]
        centers.append(far)
    return centers, owner, gap


class CoverTree:
    """The tree of a block: nodes with a centre, a covering radius, and either children or rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float, leaf_rows: int = LEAF_ROWS, base: float = BASE):
        self.points, self.ids, self.labels = points, ids, labels
        space = Space(points, norm)
        self.slack = 1e-9 * np.sqrt(norm) + 1e-9
        self.center, self.radius, self.below = [0], [0.0], [None]
        self.rows: list[np.ndarray | None] = [np.arange(len(points))]
        at = 0
        while at < len(self.center):
            rows = self.rows[at]
            here, own = space.at(rows), int(np.flatnonzero(rows == self.center[at])[0])
            self.radius[at] = float(here.gaps_to(own).max())
            if len(rows) > leaf_rows and self.radius[at] > 0:
                # A net of smaller parts costs more than it skips: such a node is verified as a whole.
                centers, owner, near = net(here, own, self.radius[at] / base, max(2, len(rows) // leaf_rows))
                if near.max() <= self.radius[at] / base:
                    self.below[at] = np.arange(len(self.center), len(self.center) + len(centers))
                    for k, c in enumerate(centers):
                        self.center.append(int(rows[c]))
                        self.radius.append(0.0)
                        self.below.append(None)
                        self.rows.append(rows[owner == k])
                    self.rows[at] = None
            at += 1
        self.radius = np.array(self.radius)
        self.center = np.array(self.center)

    def best(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> tuple[list[list[tuple[int, int]]], int]:
        """For each window (from, to) the first k (score, id) within, highest first, ties by id; and how many rows were verified."""
        length = float(np.sqrt(query @ query))
        least = min(low for low, _ in windows)
        leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # scores and ids of the rows that any window may take, first ones first
        centers: dict[int, np.ndarray] = {}
        verified = 0
        out = []
        for low, high in windows:
            found: list[tuple[int, int]] = []
            heap = [(-np.inf, 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if len(found) == k and -bound < found[-1][0]:
                    break
                if self.below[node] is None:
                    if node not in leaves:
                        rows = self.rows[node]
                        score = self.points[rows] @ query
                        verified += len(rows)
                        fits = np.flatnonzero((score >= least) & ((self.labels[rows] == label) == same) & (self.ids[rows] != own))
                        score, ids = score[fits], self.ids[rows[fits]]
                        first = np.lexsort((ids, -score))
                        leaves[node] = score[first], ids[first]
                    score, ids = leaves[node]
                    a = int(np.searchsorted(-score, -high))
                    b = min(a + k, int(np.searchsorted(-score, -low, side="right")))
                    if b > a:
                        more = zip(score[a:b].astype(np.int64).tolist(), ids[a:b].tolist(), strict=True)
                        found = sorted([*found, *more], key=_first)[:k]
                    continue
                kids = self.below[node]
                if node not in centers:
                    centers[node] = self.points[self.center[kids]] @ query
                reach = (self.radius[kids] + self.slack) * length + 1e-6
                top = centers[node] + reach
                for i in np.flatnonzero((top >= low) & (centers[node] - reach <= high)):
                    heapq.heappush(heap, (-min(float(top[i]), float(high)), int(kids[i])))
            out.append(found)
        return out, verified


def _first(x: tuple[int, int]) -> tuple[int, int]:
    return -x[0], x[1]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of numbers; shorter rows end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _placing(centers: Space, dims: int, norm: float):
    """(vec_id, label, vector, is_anchor) with the nearest centre's number and the distance to it."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = Space(_matrix(batch.column(2), dims), norm)
            gaps = np.stack([space.gaps(*c) for c in zip(centers.points, centers.squares, centers.more, strict=True)], axis=1)
            cell = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gaps.min(1))], [*batch.schema.names, "cell", "gap"])

    return place


def _routing(centers: Space, cells: dict[int, tuple[int, float]], dims: int, norm: float):
    """A row for each block that an anchor's windows may reach: (cell, part, vec_id, label, vector, lows, highs)."""
    order = sorted(cells)
    middle = centers.points[order]
    radius, parts = (np.array([cells[c][k] for c in order]) for k in (1, 0))
    slack = 1e-9 * np.sqrt(norm) + 1e-9

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                query = _matrix(batch.column(2), dims)
                score = query @ middle.T
                reach = np.sqrt(np.einsum("ij,ij->i", query, query))[:, None] * (radius + slack) + 1e-6
                take, cell, part = [], [], []
                lows, highs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i in range(len(query)):
                    meets = np.zeros(len(order), bool)
                    for low, high in zip(lows[i], highs[i], strict=True):
                        meets |= (score[i] + reach[i] >= low) & (score[i] - reach[i] <= high)
                    for c in np.flatnonzero(meets):
                        take += [i] * int(parts[c])
                        cell += [order[c]] * int(parts[c])
                        part += range(int(parts[c]))
                rows = batch.take(pa.array(take, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), *rows.columns], ["cell", "part", *batch.schema.names])

    return route


def _searching(dims: int, norm: float, same: bool, k: int):
    """Rows of a block, then its anchors, sorted by the block's key, to each anchor's best rows of the block by window."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or asks[i] != asks[i - 1]), len(keys)]
            rows: list[tuple[int, int, int, int]] = []
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if keys[a] != now:
                    now, held, tree = keys[a], [], None
                points, ids, labels = _matrix(part.column(6), dims), part.column(4).to_numpy(), part.column(5).to_numpy()
                if not asks[a]:
                    held.append((points, ids, labels))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = CoverTree(*(np.concatenate(x) for x in zip(*held, strict=True)), norm)
                    held = []
                lows, highs = part.column(7).to_pylist(), part.column(8).to_pylist()
                for i in range(len(ids)):
                    found, _ = tree.best(points[i], int(ids[i]), int(labels[i]), same, list(zip(lows[i], highs[i], strict=True)), k)
                    rows += [(int(ids[i]), w, score, other) for w, best in enumerate(found) for score, other in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)], ["anchor_id", "window", "score", "other_id"])

    return search


def scaled(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, label and vector (floor of scale times each component) of the rows that take part: no null or non-finite value, of rows that repeat a vec_id the least."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: odd(x.cast("double"))))
    ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    taken = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("vector"))
    return taken.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS, anchors_a_task: int = ANCHORS_A_TASK) -> DataFrame:
    """For each anchor and each of its best `positives` rows of the same label, the best `negatives` rows of other labels whose score is low to high percent of the positive's.

    rows: (vec_id, label, vector of integers), as `scaled` makes them, vec_id once each; anchors: a condition on
    them. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are integer
    inner products; higher ones come first, ties by smaller vec_id. An anchor without positives, or a window without
    rows, gives none, nor does a negative positive_score (its window is empty). Vectors of several lengths
    count as ending in zeros; a squared norm of 2^50 or more raises ValueError; an empty table gives no rows.
    """
    spark = rows.sparkSession
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = checkpointed(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")))
    norm, dims, many = rows.agg(F.max(length), F.max(F.size("vector")), F.count(F.when(F.col("asks"), 1))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not many:
        return spark.createDataFrame([], result)
    if norm >= MOST_NORM:
        raise ValueError(f"the largest squared norm is {norm:.3g}: scores must stay below 2^50")
    norm, dims = norm + 1, max(dims, 1)

    sample = rows.select("vector").orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).toArrow()["vector"].combine_chunks()
    space = Space(_matrix(sample, dims), norm)
    centers = space.at(np.array(net(space, 0, 0.0, min(CELLS, len(space)))[0]))
    placed = checkpointed(rows.mapInArrow(_placing(centers, dims, norm), "vec_id long, label long, vector array<long>, asks boolean, cell int, gap double"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect()  # CELLS rows at most
    cells = {r["cell"]: (-(-r["n"] // block_rows), r["r"]) for r in sizes}
    groups = -(-many // anchors_a_task)
    parts = F.element_at(F.create_map(*(F.lit(x) for c, (n, _) in cells.items() for x in (c, n))), F.col("cell"))
    none = F.lit(None).cast("array<long>")
    shared = ["vec_id", "label", "vector"]
    blocks = placed.select("cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("asks"), *shared, none.alias("lows"), none.alias("highs"))

    def searched(queries: DataFrame, same: bool, k: int) -> DataFrame:
        """queries (vec_id, label, vector, lows, highs) to (anchor_id, window, score, other_id), the first k of each window."""
        routed = queries.mapInArrow(_routing(centers, cells, dims, norm), "cell int, part int, vec_id long, label long, vector array<long>, lows array<long>, highs array<long>")
        asked = routed.select("cell", "part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("asks"), *shared, "lows", "highs")
        key = ["cell", "part", "group"]
        both = blocks.unionByName(asked).repartition(default_partitions(spark), *key).sortWithinPartitions(*key, "asks")
        best = both.mapInArrow(_searching(dims, norm, same, k), "anchor_id long, window long, score long, other_id long")
        w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    anchored = placed.where("asks").select(*shared)
    wide = [F.array(F.lit(x).cast("long")).alias(n) for x, n in zip(_ANY, ("lows", "highs"), strict=True)]
    chosen = checkpointed(searched(anchored.select("*", *wide), True, positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0"))
    scores = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # `positives` values at most
    lows = F.transform("scores", lambda s: F.call_function("div", s * low + 99, F.lit(100)))
    highs = F.transform("scores", lambda s: F.call_function("div", s * high, F.lit(100)))
    asked = scores.join(anchored, scores["anchor_id"] == anchored["vec_id"]).select(*shared, lows.alias("lows"), highs.alias("highs"))
    mined = searched(asked, False, negatives).join(scores, "anchor_id").withColumn("positive_score", F.element_at("scores", (F.col("window") + 1).cast("int")))
    return chosen.join(mined, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
