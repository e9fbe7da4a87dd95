"""Line dedup: lines that many documents hold stay in one of them.

Two Bloom filters find the suspects. Each task notes the hashed line keys of its
documents in a once-seen filter, and those it meets again in a twice-seen filter.
The tasks' set bits are merged region by region (a bit that two tasks set counts
as seen twice), and the merged twice-seen filter is broadcast: it has
BITS_A_KEY bits a line up to MOST_BITS, so its size is bounded; when it is fuller
than planned it lets more lines through, never fewer. Only the lines whose
key is in it are shuffled, as 128-bit digests, to be counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, byte_view, ids_and_texts, kept_on_disk, until_result_ends

LEAST_CHARS = 20
LEAST_DOCS = 3
BITS_A_KEY = 16
MOST_BITS = 1 << 29
HASHES = 3
REGION = 1 << 16
REGIONS_A_BATCH = 256
#: Keys with at least one of so many suspect rows are joined by broadcast: no more than this many can have that.
HOT_KEYS = 4096


def line_keys(text: bytes, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """Of each line: stripped of ASCII white space and A-Z lower-cased, or None where under least_chars code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(b" \t\n\v\f\r").lower()
        out.append(key if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars) else None)
    return out


def _texts(block: pa.RecordBatch) -> list[bytes]:
    data, offsets = byte_view(block.column(block.schema.get_field_index("text")))
    data, at = data.tobytes(), offsets.tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


def _hashes(texts: list[bytes], least_chars: int) -> np.ndarray:
    """64-bit hashes of the keys, each once a document."""
    return np.array([xxhash.xxh3_64_intdigest(k) for t in texts for k in {x for x in line_keys(t, least_chars) if x is not None}], np.uint64)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bit numbers of each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)


def _note(size: int, least_chars: int):
    """Tasks' own filters, as the set bits of each region."""

    def note(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        get = lambda f, b: f[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1
        put = lambda f, b: np.bitwise_or.at(f, b >> np.uint64(3), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))
        for block in blocks(batches, 4 << 20):
            found, count = np.unique(_hashes(_texts(block), least_chars), return_counts=True)
            bits = _bits(found, size)
            again = (count > 1) | get(once, bits).all(axis=1)
            put(twice, bits[again].ravel())
            put(once, bits.ravel())
        # Region by region: all set bits together may take many times the filters' memory.
        for low in range(0, size // REGION, REGIONS_A_BATCH):
            rows = []
            for region in range(low, min(low + REGIONS_A_BATCH, size // REGION)):
                part = slice(region * (REGION // 8), (region + 1) * (REGION // 8))
                if once[part].any():
                    rows.append((region, *(np.flatnonzero(np.unpackbits(f[part], bitorder="little")).astype(np.uint16).tobytes() for f in (once, twice))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["region", "once", "twice"])

    return note


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region to the twice-seen bits of each region."""
    now, once, twice = None, np.zeros(REGION, bool), np.zeros(REGION, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["region", "bits"])

    for batch in batches:
        for region, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if region != now:
                if now is not None:
                    yield done()
                now = region
                once[:], twice[:] = False, False
            one = np.frombuffer(one, np.uint16)
            twice[one[once[one]]] = True
            once[one] = True
            twice[np.frombuffer(two, np.uint16)] = True
    if now is not None:
        yield done()


def _suspects(filter_, size: int, least_chars: int):
    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_.value, np.uint8)
        for block in blocks(batches, 4 << 20):
            ids, keys, hashes = [], [], []
            for doc_id, text in zip(block.column(0).to_pylist(), _texts(block), strict=True):
                own = {x for x in line_keys(text, least_chars) if x is not None}
                ids += [doc_id] * len(own)
                keys += own
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            at = _bits(hashes, size)
            hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)) if len(keys) else []
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()), pa.array([_digest(keys[i]) for i in hit], pa.binary())], ["doc_id", "key"])

    return suspects


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _drop(names: list[str], least_chars: int, with_text: bool):
    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            counts, dropped, digests, texts = [], [], [], []
            for text, gone in zip(_texts(block), block.column(block.schema.get_field_index("gone")).to_pylist(), strict=True):
                lines = text.split(b"\n")
                counts.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [line for line, key in zip(lines, line_keys(text, least_chars), strict=True) if key is None or _digest(key) not in gone]
                    text = b"\n".join(lines)
                dropped.append(counts[-1] - len(lines))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            out = [*(block.column(block.schema.get_field_index(x)) for x in names), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)]
            labels = [*names, "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                out.append(pa.array(texts, pa.binary()).cast(pa.string()))
                labels.append("kept")
            yield pa.RecordBatch.from_arrays(out, labels)

    return drop


@until_result_ends
def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep: tuple[str, ...] = (), with_text: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """Drop lines whose key at least `least_docs` documents hold, except in the largest doc_id that holds it.

    Returns doc_id, the columns of `keep`, n_lines (before), n_dropped, kept_sha256 and, with_text,
    kept. A null or empty text is one empty line. Keys under least_chars code points always stay.
    Rows that repeat a doc_id are one document. A row with null doc_id keeps all its lines and does
    not count as a document. An empty table gives no rows; other columns are ignored.
    """
    texts = ids_and_texts(docs)
    placed = texts.where("doc_id is not null")
    lines = placed.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = REGION
    while size < min(lines * BITS_A_KEY, most_bits):
        size *= 2
    noted = placed.mapInArrow(_note(size, least_chars), "region int, once binary, twice binary")
    merged = noted.repartition(F.col("region")).sortWithinPartitions("region").mapInArrow(_merge, "region int, bits binary")
    bits = bytearray(size // 8)
    for row in merged.toLocalIterator():  # as many bytes as the filter has
        bits[row["region"] * (REGION // 8) : (row["region"] + 1) * (REGION // 8)] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))
    suspects = kept_on_disk(placed.mapInArrow(_suspects(shared, size, least_chars), "doc_id long, key binary"))
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("owner"))
    frequent = kept_on_disk(counted.where(F.col("n") >= least_docs))
    hot = F.col("rows") * HOT_KEYS >= suspects.count()
    own = lambda keys: keys.select("key", "owner")
    # A hot key's rows stay where they are; the others' meet by key.
    hot_keys = F.broadcast(own(frequent.where(hot)))
    at_once = suspects.join(hot_keys, "key").where("doc_id < owner")
    others = suspects.join(hot_keys, "key", "left_anti").join(own(frequent.where(~hot)), "key").where("doc_id < owner")
    gone = at_once.unionByName(others).groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
    names = ["doc_id", *keep]
    kinds = dict(docs.dtypes) | {"doc_id": "long"}
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in names), "n_lines long, n_dropped long, kept_sha256 string", *["kept string"] * with_text])
    return carried.join(gone, "doc_id", "left").select(*names, "text", "gone").mapInArrow(_drop(names, least_chars, with_text), schema)
