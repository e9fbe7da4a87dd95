"""Media columns: FLAC streams of one channel, encoded and decoded a block of rows at a time.

The decoder finds frames by their sync codes and header checksums, verifies each
frame's CRC-16, decodes the Rice-coded residuals of all frames of a block in
lockstep (one code of every frame per numpy step), restores samples by the linear
predictor and gives PCM blocks with their sample and byte offsets, so that a reader
can seek. The encoder writes constant, verbatim and fixed-predictor subframes.
The format is that of RFC 9639.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, byte_view, ids_and_texts

FRAME_SAMPLES = 4096
SAMPLE_RATE = 8000
PAYLOAD_UNIT = 64
#: Rice parameters that the encoder chooses from; with these a code has at most 36 bits.
RICE = range(4, 9)
BLOCK_BYTES = 4 << 20
#: Frames that are encoded together, at most.
PIECE_FRAMES = 1024


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << bits - 1, (1 << bits) - 1
    out = []
    for byte in range(256):
        x = byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & mask
        out.append(x)
    return np.array(out, np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
#: Of two bytes at once.
_CRC16_PAIR = (_CRC16[np.arange(65536) >> 8].astype(np.uint32) << 8 & 0xFFFF).astype(np.uint16)
_CRC16_PAIR ^= _CRC16[(_CRC16[np.arange(65536) >> 8] >> 8).astype(np.uint16) ^ (np.arange(65536) & 255).astype(np.uint16)]


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8[x ^ b]
    return x


def crc16(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:stop], all in lockstep."""
    order = np.argsort(start - stop, kind="stable")
    at, size = start[order], (stop - start)[order]
    crc = np.zeros(len(at), np.uint16)
    odd = size % 2 == 1
    crc[odd] = _CRC16[data[at[odd]]]
    at, pairs = at + odd, size // 2
    live = np.searchsorted(-pairs, -np.arange(pairs[0] if len(pairs) else 0), side="left")
    for step, n in enumerate(live.tolist()):
        i = at[:n] + 2 * step
        crc[:n] = _CRC16_PAIR[crc[:n] ^ (data[i].astype(np.uint16) << 8 | data[i + 1])]
    out = np.zeros(len(crc), np.uint16)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's variable-length form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >> 5 * size + 1:
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([0xFF << 8 - size & 0xFF | n, *reversed(tail)])


def encode(payload: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A FLAC stream of each payload[bounds[i]:bounds[i + 1]], bytes as unsigned 8-bit samples; none is empty.

    Frames are independent: a long payload goes through in pieces of PIECE_FRAMES frames.
    """
    out: list[list[bytes]] = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = high - low
        most = min(FRAME_SAMPLES, size).to_bytes(2, "big")
        fields = SAMPLE_RATE << 44 | 7 << 36 | size
        out.append([b"fLaC\x80\0\0\x22", most, most, bytes(6), fields.to_bytes(8, "big"), hashlib.md5((payload[low:high] ^ 0x80).tobytes()).digest()])
    step = PIECE_FRAMES * FRAME_SAMPLES
    i = 0
    while i < len(out):
        # As many whole payloads as a piece may have, or the pieces of one that has more.
        j = max(int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1, i + 1)
        if j > i + 1 or bounds[j] - bounds[i] <= step:
            _add_frames(out[i:j], payload[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], 0)
        else:
            for low in range(int(bounds[i]), int(bounds[j]), step):
                part = payload[low : min(low + step, int(bounds[j]))]
                _add_frames(out[i:j], part, np.array([0, len(part)]), (low - int(bounds[i])) // FRAME_SAMPLES)
        i = j
    return [b"".join(x) for x in out]


def _add_frames(out: list[list[bytes]], payload: np.ndarray, bounds: np.ndarray, first_number: int) -> None:
    """Frames of each payload[bounds[i]:bounds[i + 1]], to the end of out[i]."""
    samples = payload.astype(np.int32) - 128
    sizes = np.diff(bounds)
    frames = -(-sizes // FRAME_SAMPLES)
    stream = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    first = bounds[:-1][stream] + number * FRAME_SAMPLES
    count = np.minimum(bounds[1:][stream] - first, FRAME_SAMPLES)
    step = np.zeros(len(samples), np.int32)
    step[1:] = samples[1:] - samples[:-1]
    constant = np.add.reduceat(step != 0, first) - (step[first] != 0) == 0
    folded = [np.where(x < 0, -2 * x - 1, 2 * x) for x in (samples, step)]
    folded[1][first] = 0
    costs = np.stack([np.add.reduceat(f >> k, first) + (count - order) * (k + 1) for order, f in enumerate(folded) for k in RICE])
    best = costs.argmin(axis=0)
    order, k = best // len(RICE), best % len(RICE) + RICE[0]
    raw = ~constant & (costs.min(axis=0) + 8 * order + 10 >= 8 * count)
    code_order, code_k = np.repeat(order, count), np.repeat(k, count)
    value = np.where(code_order == 1, folded[1], folded[0]).astype(np.uint64)
    shift = code_k.astype(np.uint64)
    bits = (value >> shift).astype(np.int64) + 1 + code_k
    value = (value & ((np.uint64(1) << shift) - np.uint64(1))) | np.uint64(1) << shift
    # The first code of a frame also has the subframe header, the warm-up sample and the residual's header.
    head = (16 + 2 * order).astype(np.uint64) << np.uint64(8)
    head |= (samples[first] & 0xFF).astype(np.uint64)
    head = np.where(order == 1, head, head >> np.uint64(8)) << np.uint64(10) | k.astype(np.uint64)
    lead = np.where(order == 1, 26, 18)
    own = np.where(order == 1, 0, bits[first])
    value[first] = head << own.astype(np.uint64) | np.where(order == 1, np.uint64(0), value[first])
    bits[first] = lead + own
    plain = np.repeat(raw | constant, count)
    bits[plain] = 8
    value[plain] = (samples[plain] & 0xFF).astype(np.uint64)
    bits[np.repeat(constant, count)] = 0
    value[np.repeat(constant, count)] = 0
    some = raw | constant
    value[first[some]] = np.where(raw[some], 2, 0).astype(np.uint64) << np.uint64(8) | (samples[first[some]] & 0xFF).astype(np.uint64)
    bits[first[some]] = 16
    body = -(-np.add.reduceat(bits, first) // 8)
    ends = np.cumsum(body)
    inside = np.cumsum(bits) - bits
    place = inside + np.repeat((ends - body) * 8 - inside[first], count)
    packed = _packed(place, bits, value, int(ends[-1]))
    pieces: list[bytes] = []
    lengths = np.zeros(len(stream), np.int64)
    data = packed.tobytes()
    for i, (n, size, a, b) in enumerate(zip((number + first_number).tolist(), count.tolist(), (ends - body).tolist(), ends.tolist(), strict=True)):
        header = b"\xff\xf8\x70\x02" + _coded_number(n) + (size - 1).to_bytes(2, "big")
        pieces.append(header + bytes([crc8(header)]) + data[a:b])
        lengths[i] = len(pieces[-1])
    stops = np.cumsum(lengths)
    check = crc16(np.frombuffer(b"".join(pieces), np.uint8), stops - lengths, stops).tolist()
    for i, piece, crc in zip(stream.tolist(), pieces, check, strict=True):
        out[i] += [piece, crc.to_bytes(2, "big")]


def _packed(place: np.ndarray, bits: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Bytes with each value's lowest bits at its place; places ascend."""
    some = bits > 0
    place, bits, value = place[some], bits[some], value[some]
    words = np.zeros(size // 8 + 2, np.uint64)
    word, room = place >> 6, 64 - (place & 63) - bits
    whole = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    opens = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[opens]] = np.add.reduceat(whole, opens)
    over = room < 0
    words[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[:size]


class MediaError(ValueError):
    """A stream that isn't valid, or has a feature that isn't supported."""


@dataclass
class _Frame:
    stream: int
    at: int
    stop: int
    offset: int
    samples: int
    body: int


_BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + i: 256 << i for i in range(8)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _frame_header(data: bytes, at: int, stop: int, depth: int) -> tuple[int, int, int] | None:
    """(number, samples, where the subframe starts) if a valid frame header is at `at`."""
    if stop - at < 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    bits = data[at + 3] >> 1 & 7
    if data[at + 3] >> 4 or size == 0 or rate == 15 or bits and _DEPTHS.get(bits) != depth:
        return None
    lead = data[at + 4]
    more = 0
    while lead << more & 0x80:
        more += 1
    if more == 1 or more > 7 or at + 5 + more > stop:
        return None
    number = lead & (0x7F >> more) if more else lead
    more = max(more - 1, 0)
    for b in data[at + 5 : at + 5 + more]:
        if b >> 6 != 2:
            return None
        number = number << 6 | b & 0x3F
    p = at + 5 + more
    if size in (6, 7):
        samples = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        samples = _BLOCK_SIZES[size]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= stop or crc8(data[at:p]) != data[p]:
        return None
    return number, samples, p + 1


def decode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[_Frame]]:
    """Samples of all streams data[bounds[i]:bounds[i + 1]] back to back, their offsets, and the frames.

    Raises MediaError for a stream that fails a checksum, isn't mono, or has wasted bits.
    """
    raw = data.tobytes()
    frames: list[_Frame] = []
    depths, totals, sums = [], [], []
    sync = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8)) if len(data) else np.zeros(0, np.int64)
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if raw[low : low + 4] != b"fLaC":
            raise MediaError("no stream marker")
        p, last, info = low + 4, False, b""
        while not last:
            last, kind, size = bool(raw[p] & 0x80), raw[p] & 0x7F, int.from_bytes(raw[p + 1 : p + 4], "big")
            if kind == 0:
                info = raw[p + 4 : p + 4 + size]
            p += 4 + size
            if p > high:
                raise MediaError("metadata beyond the stream")
        fields = int.from_bytes(info[10:18], "big")
        if fields >> 41 & 7:
            raise MediaError("more than one channel")
        depth = (fields >> 36 & 31) + 1
        most = int.from_bytes(info[2:4], "big")
        depths.append(depth)
        totals.append(fields & (1 << 36) - 1)
        sums.append(info[18:34])
        own = sync[np.searchsorted(sync, p) : np.searchsorted(sync, high)].tolist()
        found = [(a, h) for a in own if (h := _frame_header(raw, a, high, depth))]
        if totals[-1] and (not found or found[0][0] != p):
            raise MediaError("no frame where the first should be")
        for (at, (number, samples, body)), nxt in zip(found, [*(a for a, _ in found[1:]), high], strict=True):
            frames.append(_Frame(i, at, nxt, (number if raw[at + 1] & 1 else number * most), samples, body))
    if frames:
        frames = _checked(data, frames)
    # A header may claim any number of samples: only those of the frames found are believed.
    held = np.bincount([f.stream for f in frames], [f.samples for f in frames], len(totals)).astype(np.int64)
    if any(total and total != n for total, n in zip(totals, held.tolist(), strict=True)):
        raise MediaError("the frames don't have the stream's number of samples")
    offsets = np.concatenate(([0], np.cumsum(held)))
    out = np.zeros(offsets[-1], np.int32)
    _fill(data, raw, frames, depths, offsets, out)
    for i, digest in enumerate(sums):
        samples = out[offsets[i] : offsets[i + 1]]
        width = -(-depths[i] // 8)
        pcm = samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if any(digest) and hashlib.md5(pcm).digest() != digest:
            raise MediaError("the samples' MD5 differs")
    return out, offsets, frames


def _checked(data: np.ndarray, frames: list[_Frame]) -> list[_Frame]:
    """Frames whose CRC-16 holds; a chance header inside a frame is joined to the frame it lies in."""
    at, stop = (np.array([getattr(f, x) for f in frames]) for x in ("at", "stop"))
    good = crc16(data, at, stop) == 0  # over a frame with its checksum
    if good.all():
        return frames
    out, i = [], 0
    while i < len(frames):
        f, j = frames[i], i + 1
        while not (good[i] if j == i + 1 else crc16(data, np.array([f.at]), np.array([frames[j - 1].stop]))[0] == 0):
            if j == len(frames) or frames[j].stream != f.stream:
                raise MediaError(f"the checksum of the frame at byte {f.at} differs")
            j += 1
        f.stop = frames[j - 1].stop
        out.append(f)
        i = j
    return out


def _fill(data: np.ndarray, raw: bytes, frames: list[_Frame], depths: list[int], offsets: np.ndarray, out: np.ndarray) -> None:
    """Decode the subframes into out."""
    coded: dict[int, list] = {}
    for f in frames:
        depth, kind = depths[f.stream], raw[f.body] >> 1 & 63
        if raw[f.body] & 0x81:
            raise MediaError("wasted bits or a set padding bit")
        to = int(offsets[f.stream]) + f.offset
        if to + f.samples > offsets[f.stream + 1]:
            raise MediaError("a frame beyond the stream's samples")
        bits = lambda p, n: int.from_bytes(raw[p >> 3 : (p + n + 7) >> 3], "big") >> (-(p + n) & 7) & (1 << n) - 1
        signed = lambda p, n, bits=bits: (v := bits(p, n)) - (v >> n - 1 << n)
        p = (f.body + 1) * 8
        if kind == 0:
            out[to : to + f.samples] = signed(p, depth)
        elif kind == 1:
            if depth == 8:
                out[to : to + f.samples] = data[f.body + 1 : f.body + 1 + f.samples].view(np.int8)
            else:
                out[to : to + f.samples] = [signed(p + i * depth, depth) for i in range(f.samples)]
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind <= 12 else kind - 31
            warm = [signed(p + i * depth, depth) for i in range(order)]
            p += order * depth
            shift, factors = 0, None
            if kind >= 32:
                precision, shift = bits(p, 4) + 1, signed(p + 4, 5)
                factors = [signed(p + 9 + i * precision, precision) for i in range(order)]
                p += 9 + order * precision
            method, parts = bits(p, 2), bits(p + 2, 4)
            if method > 1 or f.samples >> parts << parts != f.samples:
                raise MediaError("an unknown residual coding")
            coded.setdefault(order if factors is None else -1, []).append((f, to, warm, factors, shift, 4 + method, parts, p + 6, order))
        else:
            raise MediaError("a reserved subframe type")
    for order, items in coded.items():
        items.sort(key=lambda x: x[8] - x[0].samples)
        residual = _residuals(data, items)
        for j, (f, to, warm, factors, shift, *_, own) in enumerate(items if order < 0 else ()):
            line = list(warm)
            for r in residual[: f.samples - own, j].tolist():
                line.append(r + (sum(a * b for a, b in zip(factors, reversed(line[-own:]), strict=True)) >> shift))
            out[to : to + f.samples] = line
        if order < 0:
            continue
        warm = np.array([x[2] for x in items], np.int64).reshape(len(items), order).T
        for i in reversed(range(order)):
            start = np.diff(warm[: i + 1], n=i, axis=0)
            residual = np.cumsum(np.concatenate((start, residual)), axis=0)
        lines = np.ascontiguousarray(residual.T)
        for j, x in enumerate(items):
            out[x[1] : x[1] + x[0].samples] = lines[j, : x[0].samples]


_ZEROS = np.full(65536, 16, np.uint8)
for _bit in range(16):
    _ZEROS[1 << _bit : 2 << _bit] = 15 - _bit


def _residuals(data: np.ndarray, items: list) -> np.ndarray:
    """Residuals of the frames as columns; frames with more residuals come first."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    peek = lambda p: words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)  # noqa: E731  57 bits or more
    width = np.array([x[5] for x in items], np.uint64)
    place = np.array([x[7] for x in items], np.int64)
    order = np.array([x[8] for x in items])
    samples = np.array([x[0].samples for x in items])
    part = samples >> np.array([x[6] for x in items])
    counts = samples - order
    rice, escape = np.zeros(len(items), np.uint64), np.zeros(len(items), bool)
    out = np.zeros((int(counts[0]), len(items)), np.int32)
    switch: dict[int, list[int]] = {}
    for j, (size, own, all_) in enumerate(zip(part.tolist(), order.tolist(), samples.tolist(), strict=True)):
        for edge in range(0, all_, size):
            switch.setdefault(max(edge - own, 0), []).append(j)
    live = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left").tolist()
    one = np.uint64(1)
    for t, n in enumerate(live):
        for j in (np.array(sorted(switch[t])),) if t in switch else ():
            j = j[j < n]
            value = peek(place[j]) >> (np.uint64(64) - width[j])
            place[j] += width[j].astype(np.int64)
            escape[j] = value == (one << width[j]) - one
            raw_bits = peek(place[j]) >> np.uint64(59)
            place[j] += np.where(escape[j], 5, 0)
            rice[j] = np.where(escape[j], raw_bits, value)
        at, k = place[:n], rice[:n]
        word = peek(at)
        zeros = _ZEROS[word >> np.uint64(48)].astype(np.int64)
        if (zeros == 16).any():
            far = np.flatnonzero(zeros == 16)
            total, p = zeros[far] * 0, at[far].copy()
            going = np.arange(len(far))
            while len(going):
                z = _ZEROS[peek(p[going]) >> np.uint64(48)].astype(np.int64)
                total[going] += z
                p[going] += z
                going = going[(z == 16) & (p[going] < 8 * len(data))]
            zeros[far] = total
        after = at + zeros + 1
        low = peek(after) >> one >> (np.uint64(63) - k)
        value = (zeros.astype(np.uint64) << k | low).astype(np.int64)
        value = (value >> 1) ^ -(value & 1)
        if (e := escape[:n]).any():
            fixed = peek(at[e]) >> one >> (np.uint64(63) - k[e])
            half = np.where(k[e] > 0, one << np.maximum(k[e], one) - one, one)
            value[e] = fixed.astype(np.int64) - np.where((fixed & half) > 0, (half * np.uint64(2)).astype(np.int64), 0)
            after[e] = at[e]
        out[t, :n] = value
        place[:n] = after + k.astype(np.int64)
    return out


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes with zeros up to a positive multiple of PAYLOAD_UNIT, back to back."""
    sizes = np.diff(offsets)
    padded = np.maximum(-(-sizes // PAYLOAD_UNIT), 1) * PAYLOAD_UNIT
    bounds = np.concatenate(([0], np.cumsum(padded)))
    out = np.zeros(bounds[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(bounds[:-1] - offsets[:-1], sizes)] = data
    return out, bounds


def feature(samples: np.ndarray) -> str:
    """Sample count, peak, mean magnitude in thousandths, energy a sample, and zero crossings."""
    size, n = np.abs(samples.astype(np.int64)), max(len(samples), 1)
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"n={len(samples)};peak={int(size.max(initial=0))};mean={int(size.sum()) * 1000 // n};energy={int((size * size).sum()) // n};crossings={crossings}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's padded payload as a FLAC stream. A null text counts as empty."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            media = encode(*payloads(*byte_view(block.column(1))))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return ids_and_texts(docs).mapInArrow(make, "doc_id long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The PCM blocks of (doc_id, media) rows, one a frame, each with where it starts.

    Returns doc_id, sample_offset, byte_offset (of the frame in its stream), n_samples, pcm
    (little-endian signed samples of 8 or 16 bits, else 32) and problem. A stream that is null or
    fails a check gives one row with the problem and no pcm. Rows are independent of each other.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if stream is None:
                        raise MediaError("null")
                    samples, _, frames = decode(np.frombuffer(stream, np.uint8), np.array([0, len(stream)]))
                except (ValueError, IndexError, OverflowError) as error:
                    rows.append((doc_id, None, None, None, None, str(error) or "cut short"))
                    continue
                depth = (int.from_bytes(stream[18:26], "big") >> 36 & 31) + 1
                kind = "<i1" if depth <= 8 else "<i2" if depth <= 16 else "<i4"
                rows += [(doc_id, f.offset, f.at, f.samples, samples[f.offset : f.offset + f.samples].astype(kind).tobytes(), None) for f in frames]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "sample_offset", "byte_offset", "n_samples", "pcm", "problem"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(read, "doc_id long, sample_offset long, byte_offset long, n_samples long, pcm binary, problem string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as FLAC, read the stored bytes back, and describe what was read.

    Returns doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the
    payload as read back, the last 64 bytes for the latter), media_bytes, media_sha256 and feature.
    A null or empty text has a payload of 64 zero bytes. Null doc_ids and repeated rows stay, other
    columns are ignored, an empty table gives no rows. A task holds about BLOCK_BYTES of text, or
    one longer text, at a time.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            data, offsets = byte_view(block.column(1))
            media = encode(*payloads(data, offsets))
            ends = np.concatenate(([0], np.cumsum([len(m) for m in media])))
            samples, at, _ = decode(np.frombuffer(b"".join(media), np.uint8), ends)
            back = (samples + 128).astype(np.uint8).tobytes()
            rows = []
            for i, stream in enumerate(media):
                payload = back[at[i] : at[i + 1]]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples[at[i] : at[i + 1]])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), *columns], names)

    return ids_and_texts(docs).mapInArrow(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
