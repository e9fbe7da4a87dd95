import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import flac
from palimpsest.llm.fingerprints import anchors, edited_likeness, likeness, links, placed_anchors
from palimpsest.llm.language_model import score_texts
from palimpsest.llm.packing import differencing, pack_block, pack_documents, word_ids
from palimpsest.llm.piece_encoding import PieceModel, decode_ids, encode_digests, encode_texts
from palimpsest.llm.textblocks import tokenizer_file
from palimpsest.llm.toxicity import CLASSES, REACH, TRACKS, Grammar, compose, fit_grammar, grammar_machines, machine, score_toxicity, toxicity
from palimpsest.llm.url_rules import judge_urls

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
MODEL, LIBRARY = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.text(alphabet="abcdehinrst  \n▁éß.,中😀\t", max_size=60))
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_librarys(text):
    ids = MODEL.encode(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)
    joined, decoded = MODEL.digest_parts(text)
    assert joined == ",".join(map(str, ids)).encode() and decoded.decode() == LIBRARY.decode(ids)


def test_piece_queries(docs, rows, empty):
    wanted = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert Counter(tuple(r) for r in encode_digests(docs, PIECES).collect()) == Counter(wanted)
    back = decode_ids(encode_texts(docs, PIECES), PIECES)
    assert Counter(r["text"] for r in back.collect()) == Counter((t or "").replace("▁", " ") for _, t in rows)
    assert encode_digests(empty, PIECES).count() == 0


@given(st.text(alphabet="abcIT's ll12.,é\u0301Σς中\n\x1c<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_librarys(text):
    library = test_word_ids_are_the_librarys.library = getattr(test_word_ids_are_the_librarys, "library", None) or Tokenizer.from_file(WORDS)
    encode = test_word_ids_are_the_librarys.encode = getattr(test_word_ids_are_the_librarys, "encode", None) or word_ids(WORDS)
    assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_differencing_is_even():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    groups = differencing(sizes, 20)
    assert sorted(i for g in groups for i in g) == list(range(400))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 50


@given(st.lists(st.integers(1, 300), max_size=60))
@settings(max_examples=100, deadline=None)
def test_pack_block_holds_each_token_once(lengths):
    sequences = pack_block(lengths, capacity=64, piece=16, slack=1)
    seen = Counter((d, p) for s in sequences for d, at, n in s for p in range(at, at + n))
    assert seen == Counter((d, p) for d, n in enumerate(lengths) for p in range(n))
    assert all(sum(x[2] for x in s) <= 64 for s in sequences)


def test_packing_query(docs, rows, empty):
    library = Tokenizer.from_file(WORDS)
    pieces = pack_documents(docs, WORDS, block_docs=8).collect()
    assert pack_documents(empty, WORDS).count() == 0
    wanted = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted[i, len(ids)] += len(ids)
    got = Counter()
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert got == wanted
    texts = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i not in (20, 21)}
    for p in pieces:
        if p["doc_id"] in texts:
            part = texts[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_fingerprints(docs, rows, empty, spark):
    assert edited_likeness(empty).count() == 0
    plain = [(i, t) for i, t in rows if i not in (None, 20, 21)]
    got = {r["doc_id"]: r for r in edited_likeness(spark.createDataFrame(plain, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(plain)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1
    assert got[0]["fingerprint"] != got[14]["fingerprint"]
    assert edited_likeness(docs).count() == len(rows)


def _murmur(seed, *values):
    """Spark's hash of longs (8 bytes) or ints (4 bytes): 32-bit Murmur3."""
    mask = 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> 32 - n) & mask
    for size, value in values:
        h = seed & mask
        words = [value & mask] + [value >> 32 & mask] * (size == 8)
        for w in words:
            w = turn(w * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
            h = (turn(h ^ w, 13) * 5 + 0xE6546B64) & mask
        h ^= size
        for n, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> n) * m & mask
        seed = h ^ h >> 16
    return seed - (1 << 32) if seed >> 31 else seed


def _plain_anchors(text):
    """Closed syncmers one k-mer at a time."""
    consonant = lambda c: "!" <= c <= "~" and c not in "aeiouAEIOU0123456789"
    tokens, now = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            tokens += [now] * bool(now)
            now = ""
            continue
        now += c
        if not consonant(c):
            tokens.append(now)
            now = ""
    tokens += [now] * bool(now)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in tokens]
    smers = [_murmur(42, (8, a), (8, b)) for a, b in zip(h, h[1:])]
    kmers = [smers[i : i + 4] for i in range(len(smers) - 3)]
    found = [k for k in kmers if min(k) in (k[0], k[-1])]
    if kmers and not found:
        found = [min(kmers, key=min)]
    if kmers:
        return [_murmur(42, *((4, k[j]) for j in (0, 2, 3))) for k in found]
    return smers


def test_anchors_are_the_closed_syncmers(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstu-9é") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (1, 2, 3, 5, 9, 40, 300) for _ in range(6)]
    texts += ["b" * 50, "中文字很多" * 30, "x" * 5 + "a" * 5, "abc\tdef\u00a0ghi\x85 j"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", anchors(F.col("t")).alias("a"), F.expr("hash(t)")).collect()
    for r in got:
        t = texts[r["k"]]
        assert r["a"], t
        if len(r["a"]) > 1 or _plain_anchors(t):
            assert r["a"] == _plain_anchors(t)


def test_unrelated_short_texts_are_not_alike(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    texts = [(k, " ".join(word() for _ in range(10))) for k in range(400)] + [(400 + k, " " * k) for k in range(3)]
    got = {r["doc_id"]: r for r in edited_likeness(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(r["near_next"] < 0.2 for r in got.values()) and all(r["fingerprint"] for k, r in got.items() if k < 400)
    # Half of each text is kept.
    assert sum(got[k]["near_edited"] > 0 for k in range(399)) > 390


def _plain_likeness(a, b):
    """Of two lists of (place, anchor): links one at a time, the text's start before the first anchor."""
    made = [{(x, y, q - p) for (p, x), (q, y) in zip([(0, 0), *t], t)} for t in (a, b)]
    return len(made[0] & made[1]) / len(made[0] | made[1])


def test_likeness_matches_anchors_by_position(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    words = [word() for _ in range(400)]
    inserted = [*words[:150], "inserted", "words", *words[150:]]
    pieces = [words[i : i + 4] for i in range(0, 400, 4)]
    rng.shuffle(pieces)
    shuffled = [w for p in pieces for w in p]
    repeats = words[:30] * 5
    texts = [" ".join(x) for x in (words, inserted, shuffled, words[:200] + [word() for _ in range(200)], repeats, repeats[7:], ["a"], ["one", "two"], [])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", placed_anchors(F.col("t")).alias("a"))
    both = docs.crossJoin(docs.select(F.col("k").alias("l"), F.col("a").alias("b")))
    got = {(r["k"], r["l"]): r for r in both.withColumn("like", likeness(links(F.col("a")), links(F.col("b")), F.col("k") == F.col("l"))).collect()}
    for (k, l), r in got.items():
        placed = [[(x & 0xFFFFFFFF, x >> 32) for x in r[side]] for side in "ab"]
        assert all(p == sorted(p) for p in placed)
        want = _plain_likeness(*placed) if r["a"] or r["b"] else float(k == l)
        assert r["like"] == pytest.approx(want), (k, l)
    assert all(got[k, k]["like"] == 1 for k in range(len(texts)))
    # Half of the words are shared: a third of those of both.
    assert got[0, 1]["like"] > 0.95 and 0.25 < got[0, 3]["like"] < 0.4
    sets = [set(x >> 32 for x in got[0, 2][side]) for side in "ab"]
    assert got[0, 2]["like"] < 0.8 * len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_anchors_do_not_depend_on_their_surroundings(spark):
    middle = " ".join(f"m{k * k % 97}" for k in range(60))
    rng = random.Random(2)
    unbroken = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    han = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(2000))
    texts = [middle, f"some other words before {middle} and after", unbroken, "q" + unbroken, han, "字" + han]
    found = [set(r["a"]) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", anchors(F.col("t")).alias("a")).orderBy("k").collect()]
    assert found[0] <= found[1] and found[0]
    assert all(len(a & b) >= 0.9 * len(a) for a, b in (found[2:4], found[4:6]))


@pytest.mark.parametrize("values", [[0] * 64, list(range(256)), [255, 0] * 32, [7] * 5000 + [9] * 120, list(np.random.default_rng(1).integers(0, 256, 9000))])
def test_flac_round_trip(values):
    payload = np.array(values, np.uint8)
    (stream,) = flac.encode(payload, np.array([0, len(payload)]))
    samples, _, frames = flac.decode(np.frombuffer(stream, np.uint8), np.array([0, len(stream)]))
    assert (samples + 128 == payload).all()
    assert [f.offset for f in frames] == list(range(0, len(payload), flac.FRAME_SAMPLES))


def test_flac_damage_is_found():
    payload = np.random.default_rng(2).integers(90, 120, 9000).astype(np.uint8)
    (stream,) = flac.encode(payload, np.array([0, len(payload)]))
    for at in (50, 60, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(flac.MediaError):
            flac.decode(np.frombuffer(bytes(bad), np.uint8), np.array([0, len(bad)]))


def _bits(fields):
    text = "".join(f"{v & (1 << n) - 1:0{n}b}" for v, n in fields)
    return int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big")


def test_flac_linear_prediction_partitions_and_escapes():
    """A frame by hand: order 2 prediction, two partitions, the second one escaped."""
    samples = [10, 12, 15, 17, 20, 21, 25, 30, 33, 31, 28, 26, 20, 16, 11, 5]
    residual = [x - ((2 * a - b) >> 0) for b, a, x in zip(samples, samples[1:], samples[2:])]
    rice = [(v, n) for r in residual[:6] for u in [2 * r if r >= 0 else -2 * r - 1] for v, n in ((1, (u >> 2) + 1), (u & 3, 2))]
    body = _bits([(0, 1), (32 + 1, 6), (0, 1), (10, 8), (12, 8), (3, 4), (0, 5), (2, 4), (-1, 4), (0, 2), (1, 4), (2, 4), *rice, (15, 4), (6, 5), *((r, 6) for r in residual[6:])])
    head = b"\xff\xf8\x60\x02\x00\x0f"
    frame = head + bytes([flac.crc8(head)]) + body
    data = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
    pcm = np.array(samples, np.int8).tobytes()
    info = b"\0\x10\0\x10" + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    stream = b"fLaC\x80\0\0\x22" + info + frame
    assert flac.decode(np.frombuffer(stream, np.uint8), np.array([0, len(stream)]))[0].tolist() == samples


def test_media_query(docs, rows, empty):
    got = flac.media_digests(docs).collect()
    wanted = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(max(-(-len(b) // 64), 1) * 64 - len(b))
        wanted[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == wanted
    assert flac.media_digests(empty).count() == 0
    back = flac.pcm_blocks(flac.media_column(docs.where("doc_id = 14"))).orderBy("sample_offset").collect()
    text = next(t for i, t in rows if i == 14).encode()
    assert bytes(b ^ 0x80 for r in back for b in r["pcm"])[: len(text)] == text


def test_long_payloads_are_encoded_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    payload = rng.integers(90, 120, 64 * 700).astype(np.uint8)
    bounds = np.array([0, 64 * 500, 64 * 501, 64 * 700])
    whole = flac.encode(payload, bounds)
    monkeypatch.setattr(flac, "PIECE_FRAMES", 2)
    assert flac.encode(payload, bounds) == whole


def test_headers_that_claim_too_much_are_problems():
    (stream,) = flac.encode(np.arange(256).astype(np.uint8), np.array([0, 256]))
    claims = bytearray(stream)
    claims[21] |= 15
    claims[22] = 255
    with pytest.raises(flac.MediaError):
        flac.decode(np.frombuffer(bytes(claims), np.uint8), np.array([0, len(claims)]))


def test_pcm_blocks_report_problems(spark):
    rows = flac.pcm_blocks(spark.createDataFrame([(1, None), (2, bytearray(b"fLaC"))], "doc_id long, media binary")).collect()
    assert all(r["problem"] and r["pcm"] is None for r in rows)


def test_language_model_base_and_probabilities(spark, docs, rows, empty):
    got = score_texts(docs).collect()
    assert len(got) == len(rows) and score_texts(empty).count() == 0
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    wanted = Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), round(float(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)), 4)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == wanted
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)


def test_language_model_has_an_expert_for_every_training_text(spark):
    table, names = [], [*(f"l{k}" for k in range(8)), None]
    for k, lang in enumerate(names):
        # No word comes twice in a document; the last languages have fewer documents.
        table += [(100 * k + j, " ".join(f"{lang}{(7 * j + i) % 60}" for i in range(40)), lang) for j in range(24 - k)]
    got = score_texts(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(table) and all(r["score"] > r["base_score"] for r in got)


def test_spellings_are_probabilities():
    from palimpsest.llm.language_model import SpellingModel, grams

    model = SpellingModel()
    found, times = np.unique(grams([b"these", b"are", b"words", b"of", b"thee"] * 40), return_counts=True)
    model.count(found, times)
    model.learn(found, times)
    # A word of one byte and its blank: all first bytes that aren't the end.
    assert np.isclose(model.log10([b"these"])[0], model.log10([b"of", b"these", b"x"])[1])
    first = 10 ** model.log10([b""])[0]
    assert 0 < first < 1 and sum(10 ** model.log10([bytes([b]) for b in range(256) if b != 32])) < 1 - first + 1e-6


def test_spellings_are_learned_from_many_millions_of_words():
    from palimpsest.llm.language_model import SpellingModel, grams

    model = SpellingModel()
    words = [b"these", b"are", b"words", b"of", b"thee"]
    found, times = np.unique(grams(words * 40), return_counts=True)
    model.count(found, times * 10**6)
    model.learn(found, times * 10**6)
    assert np.isfinite(model.weights).all() and np.isfinite(model.refined).all()
    scores = model.log10([*words, b"q", "\u00df".encode()])
    assert np.isfinite(scores).all() and min(scores[:5]) > max(scores[5:])
    zeros, ones = (model.tables[0, k, :].astype(np.float64) for k in (0, 1))
    x, _ = model.inputs([np.arange(zeros.size)] * 4)
    assert np.allclose(x[:, 0], np.log((ones + 0.2) / (zeros + 0.2)), atol=1e-4)


def test_spellings_do_not_depend_on_partitions(spark):
    from palimpsest.llm.language_model import learn_spellings

    rng = random.Random(8)
    words = spark.createDataFrame([("".join(rng.choice(["an", "the", "ber", "q", "on"]) for _ in range(rng.randrange(1, 6))).encode(),) for _ in range(300)], "word binary").cache()
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        models = []
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            models.append(learn_spellings(words))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
        words.unpersist()
    one, other = models
    assert np.array_equal(one.tables, other.tables) and np.allclose(one.weights, other.weights, rtol=1e-12) and np.allclose(one.refined, other.refined, rtol=1e-12)


def test_rows_of_tables_are_small():
    import pyarrow as pa

    from palimpsest.llm import language_model, word_contexts

    found, times = np.unique(language_model.grams([b"these", b"are", b"words"]), return_counts=True)
    spellings = language_model._count_spellings([pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["gram", "n"])])
    votes = word_contexts._vote(1 << 20)([pa.RecordBatch.from_arrays([pa.array(["these are words"])], ["text"])])
    # Spark sends 10,000 rows at once, and there are as many rows of a part as tasks.
    for rows in (list(spellings), list(votes)):
        assert rows and all(10_000 * row.nbytes < 1 << 27 for row in rows)


def _plain_bit(weights, cells, x, gate, bit, taught):
    """One bit's probability as it came, and what it teaches: added up in `cells` of the chunk."""
    z = sum(w[gate] * v for w, v in zip(weights, [*x, 1.0]))
    z = min(max(z, -12), 12)
    one = 1 / (1 + math.exp(-z))
    k = min(max(round(z * 2), -16), 16) + 16
    p = min(max((one + cells["map"].setdefault((gate, k), 1 / (1 + math.exp(8 - k / 2)))) / 2, 1e-5), 1 - 1e-5)
    if taught:
        cells["gate"].setdefault(gate, []).append([(bit - one) * v for v in [*x, 1.0]])
        cells["cell"].setdefault((gate, k), []).append(bit)
    return p if bit else 1 - p


def _plain_teach(weights, cells):
    for gate, errors in cells["gate"].items():
        for k in range(len(weights)):
            weights[k][gate] += 0.02 * min(len(errors) ** 0.5, 16) / len(errors) * sum(e[k] for e in errors)
    for cell, bits in cells["cell"].items():
        cells["map"][cell] += (sum(bits) / len(bits) - cells["map"][cell]) * (1 - 0.98 ** len(bits))
    cells["gate"], cells["cell"] = {}, {}


def _plain_scores(texts, code_of, count_of, below, spelled, escape, chunk):
    """log10 of each text's probability, token by token in plain Python; texts are (words, train)."""
    places = [(d, i) for d, (ws, _) in enumerate(texts) for i in range(len(ws))]
    logs = [0.0] * len(texts)
    # Escapes.
    for d, (ws, _) in enumerate(texts):
        met, again, n = Counter(), 0, 0
        for i, w in enumerate(ws):
            p = (n + escape * 20) / (i + 20)
            logs[d] += math.log10(1 - p if w in code_of else p)
            if w not in code_of:
                b = (again + 0.5) / (n + 2) if n else 0
                logs[d] += math.log10((1 - b) * 10 ** spelled[w] + (b * met[w] / n if n else 0))
                again += met[w] > 0
                met[w] += 1
                n += 1
    # The word each context predicts, and its state.
    says = []
    for order in (1, 2, 3):
        where = {}
        for d, i in places:
            ws = texts[d][0]
            where.setdefault(tuple(ws[i - k] if i >= k else None for k in range(1, order + 1)), []).append((d, i))
        runs, found = {}, {}
        for d, i in places:
            ws = texts[d][0]
            same = where[tuple(ws[i - k] if i >= k else None for k in range(1, order + 1))]
            own = [x for x in same if x[0] == d and x[1] < i]
            before = [x for x in same if x[0] < d and texts[x[0]][1]]
            after = [x for x in same if x[0] > d and texts[x[0]][1]]
            at = own[-1] if own else before[-1] if before else after[0] if after else None
            word = texts[at[0]][0][at[1]] if at else None
            length = runs.get((d, i - 1), 0)
            runs[d, i] = length + 1 if word == ws[i] and word is not None else 0
            state = sum(length >= x for x in (1, 2, 3, 5, 9, 17, 33)) + 8 * bool(own)
            found[d, i] = (word if word in code_of and ws[i] in code_of else None, state)
        says.append(found)
    weights, cells = [[w] * 48 for w in (0.3, 0.4, 0.5, 0.0)], {"map": {}, "gate": {}, "cell": {}}
    every = [[4.0] * 16 for _ in range(3)]
    right = [[4.0 * (0.1 + 0.88 * (s % 8) / 7) for s in range(16)] for _ in range(3)]
    asked = [p for p in places if any(says[k][p][0] is not None for k in range(3))]
    told = set()
    for low in range(0, len(asked), chunk):
        for d, i in asked[low : low + chunk]:
            mine = [says[k][d, i] for k in range(3)]
            chosen, gate = next((mine[k][0], 16 * k + mine[k][1]) for k in (2, 1, 0) if mine[k][0] is not None)
            x = []
            for k in range(3):
                sure = math.log((right[k][mine[k][1]] + 0.02) / (every[k][mine[k][1]] - right[k][mine[k][1]] + 0.02))
                x.append(0.0 if mine[k][0] is None else sure if mine[k][0] == chosen else -abs(sure))
            came = chosen == texts[d][0][i]
            logs[d] += math.log10(_plain_bit(weights, cells, x, gate, int(came), texts[d][1]))
            if came:
                told.add((d, i))
        _plain_teach(weights, cells)
        for d, i in asked[low : low + chunk]:
            for k in range(3):
                word, state = says[k][d, i]
                if word is not None and texts[d][1]:
                    every[k][state] += 1
                    right[k][state] += word == texts[d][0][i]
    # Codes, level by level: weights of a level are its own.
    sums = {}
    for code, n in below.items():
        for level in range(20):
            sums[level, code >> (19 - level)] = sums.get((level, code >> (19 - level)), 0) + n
    left = [(d, i) for d, i in places if texts[d][0][i] in code_of and (d, i) not in told]
    for level in range(19):
        weights, cells = [[w] * 7 for w in (0.7, 0.3, 0.0)], {"map": {}, "gate": {}, "cell": {}}
        met, asked = {}, 0
        for d, i in left:
            code = code_of[texts[d][0][i]]
            node, bit = code >> (19 - level), code >> (18 - level) & 1
            n = [met.get((d, node, b), 0) for b in (0, 1)]
            met[d, node, bit] = n[bit] + 1
            zero, one = (sums.get((level + 1, 2 * node + b), 0) for b in (0, 1))
            if zero and one:
                gate = sum(n[0] + n[1] >= x for x in (1, 2, 3, 5, 9, 33))
                logs[d] += math.log10(_plain_bit(weights, cells, [math.log(one) - math.log(zero), math.log(n[1] + 0.4) - math.log(n[0] + 0.4)], gate, bit, texts[d][1]))
                asked += 1
                if asked % chunk == 0:
                    _plain_teach(weights, cells)
    for d, i in left:
        w = texts[d][0][i]
        logs[d] += math.log10(count_of[w] / below[code_of[w]])
    return logs


def test_scores_equal_plain_mixing(spark, monkeypatch):
    from palimpsest.llm import context_mixing, language_model

    rng = random.Random(8)
    known = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    passage = " ".join(rng.choice(known) for _ in range(40))
    texts = [" ".join(rng.choice(known) for _ in range(rng.randint(0, 60))) + (" " + passage if k % 3 == 0 else "") + (" new%d odd new%d" % (k, k) if k % 4 == 0 else "") for k in range(45)]
    table = spark.createDataFrame([(k, t, "x" if k % 2 else "y") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    words = language_model.count_words(table.where(~language_model.held_out(F.col("doc_id"))))
    shared = language_model.share_model(words)
    code_of = {bytes(r["word"]): r["code"] for r in words.collect()}
    count_of = {bytes(r["word"]): r["c"] for r in words.collect()}
    below = Counter()
    for w, code in code_of.items():
        below[code] += count_of[w]
    assert all(c & 4095 == xxhash.xxh64_intdigest(w, seed=42) & 4095 and c >> 12 & 15 == (count_of[w].bit_length() - 1) // 2 for w, c in code_of.items())
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(45)]
    for chunk in (context_mixing.CHUNK, 50):
        monkeypatch.setattr(context_mixing, "CHUNK", chunk)
        scorer = language_model.BlockScorer(shared)
        for k, t in enumerate(texts):
            scorer.add(k, held[k], t)
        got = [r["score"] for batch in scorer.rows() for r in batch.to_pylist()]
        plain = [([*t.encode().split(), b""], not held[k]) for k, t in enumerate(texts)]
        new = sorted({w for ws, _ in plain for w in ws if w not in code_of})
        spelled = dict(zip(new, shared.spelling.log10(new)))
        assert new and np.allclose(got, _plain_scores(plain, code_of, count_of, below, spelled, shared.escape, chunk), rtol=2e-3)
    table_scores = {r["doc_id"]: r["score"] for r in score_texts(table).collect()}
    base = {r["doc_id"]: r["base_score"] for r in score_texts(table).collect()}
    assert sum(table_scores.values()) > sum(base.values())


def test_placement_splits_hot_content():
    from palimpsest.llm.language_model import Placement, content_key

    copy = np.frombuffer(b"the same content in very many documents of the table", np.uint8)
    key = content_key(copy)
    assert content_key(np.concatenate([copy, copy[:3]])) >= -(2**63) and content_key(copy[:5]) != content_key(copy[:6])
    blocks = Placement(4, {key: (4, 3)}).of(np.array([key] * 300 + [key + 1]), [*range(299), None, 5])
    assert set(blocks[:300].tolist()) == {4, 5, 6} and blocks[300] < 4


def test_long_texts_go_in_pieces():
    from palimpsest.llm import language_model

    text = "word Other\n" * 400_000
    parts = list(language_model.pieces(text))
    assert len(parts) == 3 and sum(map(len, parts)) == 800_000 and {w for p in parts for w in p} == {b"word", b"other"}


def test_toxicity_grammar():
    g = Grammar({"moron$": 5.0, "scum": 5.0})
    found = g.automaton()
    plain, negated, reported = (g.tracks(t, found) for t in ("You moron. Fine day.", "You are not a moron", "He said what a moron"))
    assert plain[0] == 5 and plain[3] == 5 and negated[:2] == [0, 5] and reported[2] == 5
    assert g.tracks("I will kill you tomorrow", found)[4] == 1 and g.tracks("I will not kill you", found)[4] < 1
    assert g.tracks("scumfeld and morons, moronic", found)[0] == 5
    assert g.score(plain) > g.score(reported) > g.score(g.tracks("", found))


MACHINES = grammar_machines()
WHOLE = functools.reduce(compose, MACHINES)


def by_hand(kinds):
    """What a clause writes, by one loop with counters: [(track, constant, share)] for each word."""
    out, negated, said, parts, since = [], 0, False, 0, 0
    for kind in kinds:
        negated = REACH if kind == "negation" else max(negated - 1, 0)
        said = said or kind == "report"
        scope = "negated" if negated else "reported" if said else "plain"
        since += 1
        wrote = []
        step = {"speaker": 0, "will": 1, "harm": 2, "harmful insult": 2, "target": 3}.get(kind, -1)
        if step == 0:
            parts, since = 1, 0
        elif step == parts and since <= REACH:
            parts, since = parts + 1, 0
        elif since > REACH:
            parts = 0
        if parts == 4:
            wrote.append((TRACKS.index("threats"), 1.0 if scope == "plain" else 0.3, 0.0))
            parts = 0
        if "insult" in kind:
            wrote.append((TRACKS.index(scope), 0.0, 1.0))
            if "target" in kinds and scope == "plain":
                wrote.append((TRACKS.index("targeted"), 0.0, 1.0))
        out.append(tuple(wrote))
    return tuple(out)


@given(st.lists(st.sampled_from(CLASSES) | st.sampled_from(["speaker", "will", "harm", "target"]), max_size=25))
@settings(max_examples=500, deadline=None)
def test_the_composed_machine_is_its_parts_one_after_another(kinds):
    one_by_one = [tuple(kinds)]
    for m in MACHINES:
        one_by_one = [w for path in one_by_one for w in m.read(list(path))]
    assert WHOLE.read(kinds) == one_by_one == [by_hand(kinds)]
    names = {c: w for c, w in zip(CLASSES, ("fine", "moron", "kill", "hurt", "you", "i", "will", "not", "said"))}
    tracks, wanted = [0.0] * len(TRACKS), [0.0] * len(TRACKS)
    Grammar({"moron$": 5.0, "hurt$": 2.0}).clause([names[k] for k in kinds], tracks)
    for kind, wrote in zip(kinds, by_hand(kinds)):
        for track, constant, share in wrote:
            wanted[track] += constant + share * {"insult": 5.0, "harmful insult": 2.0}.get(kind, 0.0)
    wanted[5] = wanted[0] + wanted[3] + wanted[4]
    assert tracks == pytest.approx(wanted)


def test_composition_drops_paths_without_an_arc():
    half = machine((0, 1), "ab", lambda s, x: (s, x.upper()) if s or x == "a" else None)
    last = machine((0,), "AB", lambda s, x: (1, x * 2), lambda s: s == 1)
    assert compose(half, last).read(list("ab")) == [("AA", "BB")] and compose(half, last).read([]) == []
    assert compose(half, last).read(["a"]) == [("AA",), ("AA",)]


def test_toxicity_query(spark, docs, rows, empty):
    text = lambda k: f"some words here {k} and {'you idiotazo ' if k % 3 == 0 else ''}more {k % 7}"
    table = spark.createDataFrame([(k, text(k)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    out = toxicity(table, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] == 7] == [zlib.crc32(b"7") % 5 == 0]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(docs, none).count() == len(rows) and toxicity(empty, none).count() == 0
    assert score_toxicity(docs, fit_grammar(docs, none), ("text", "lang")).columns == ["doc_id", "text", "lang", "tracks", "score"]


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://EXAMPLE.net/en/1?x#y", "https://example.net/de", "ftp://b.net", "http://x.a.example.net/en/", "http://notnet/", "http://example.net#/en/", "a://b://c.net/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(3, urls[3], "again")], "page_id long, url string, rule string")
    got = Counter((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect())
    wanted = [(0, "", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "example.net", "example.net/en/", "allow"), (4, "example.net", "net/", "block"), (5, "b.net", None, "allow"),
              (6, "x.a.example.net", "example.net/en/", "allow"), (7, "notnet", None, "allow"), (8, "example.net", None, "allow"), (9, "b:", None, "allow"), (3, "example.net", "example.net/en/", "allow")]
    assert got == Counter(wanted)
    assert judge_urls(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == 11


@pytest.mark.parametrize("what", ["op2", "op5"])
def test_memory_for_a_word_without_an_end(what):
    """A word of 3 MB in a process of its own: what it adds to the process is bounded, and grows by less than 100 bytes a character."""
    import subprocess
    import sys

    code = f"""
import random, resource
rng = random.Random(1)
text = "".join(rng.choice(["an", "the", "ber", "q", "xx", "on", "ich", "z"]) for _ in range(2_000_000))[:3_000_000]
import public_tokenizers
from palimpsest.llm.language_model import SpellingModel
from palimpsest.llm.piece_encoding import PieceModel
model = SpellingModel() if {what == "op2"} else PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {what == "op2"}:
    assert model.log10([text.encode()])[0] < 0
else:
    assert model.digest_parts(text)[1].decode() == text
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()[-1])
    assert grown < 300_000


def test_long_words_are_encoded_as_the_library_does(monkeypatch):
    import public_tokenizers
    import sentencepiece

    from palimpsest.llm import piece_encoding

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = piece_encoding.PieceModel(path)
    monkeypatch.setattr(piece_encoding, "STRETCH", 16)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["an", "the", "ber", "aa", "aaa", "q", "é", "ß", "on", "ich", "tion", "ing", "1", "00"]) for _ in range(rng.randrange(1, 120)))
        assert model.encode(text) == library.encode(text), text


def test_spellings_do_not_depend_on_slices():
    from palimpsest.llm.language_model import gram_slices

    words = [b"these", b"", b"are", b"w" * 50, b"of"]
    whole, of = next(gram_slices(words))
    for size in (1, 3, 7):
        parts = list(gram_slices(words, size))
        assert np.array_equal(np.concatenate([p for p, _ in parts]), whole) and np.array_equal(np.concatenate([w for _, w in parts]), of)


def test_contexts_are_learned_from_texts_of_all_blocks(spark, monkeypatch):
    from palimpsest.llm import language_model

    monkeypatch.setattr(language_model, "BLOCK_BYTES", 64)  # about a block for each text
    rng = random.Random(4)
    known = [f"{a}{b}" for a in "bcdfghklmn" for b in ("a", "ee", "oo", "ust", "ine", "orm")]
    passage = rng.sample(known, 30)
    train, held = ([k for k in range(400) if (zlib.crc32(str(k).encode()) % 7 == 2) is x] for x in (False, True))
    table = [(k, " ".join([f"first{k}", *rng.choices(known, k=5), *passage, *rng.choices(known, k=5)])) for k in train[:120]]
    table += [(held[0], " ".join(passage)), (held[1], " ".join(rng.sample(passage, len(passage))))]
    scores = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()}
    assert scores[held[0]] > scores[held[1]] + 5


def test_votes_merge_in_any_order_and_keep_majorities():
    from palimpsest.llm.word_contexts import CONTEXT_ORDERS, Contexts, Votes, hash_words, voted

    rng = random.Random(6)
    texts = [[b"after", b"this" if k % 3 else b"that%d" % k, b"x%d" % rng.randint(0, 9)] for k in range(60)] + [[b"twice", b"here"] * 9]
    for parts in (1, 4, 7):
        total = Votes()
        for part in range(parts):
            own = Votes()
            mine = texts[part::parts]
            own.add(hash_words([w for t in mine for w in t]), np.cumsum([0, *map(len, mine[:-1])]))
            for k in range(len(CONTEXT_ORDERS)):
                total.pairs[k], total.counts[k] = voted(total.pairs[k], total.counts[k], own.pairs[k], own.counts[k])
        word, number = next(Contexts(total.pairs, total.counts).said(hash_words([b"after", b"?", b"twice", b"?"]), np.array([0, 2])))
        this, here = hash_words([b"this", b"here"]) >> np.uint64(24)
        assert word[1] == this and 20 <= number[1] <= 40  # 40 votes of 60
        assert word[3] == here and number[3] == 1  # once for each text


def test_words_are_counted_and_cut_as_plain_ones(spark):
    import pyarrow as pa

    from palimpsest.llm.textblocks import byte_view
    from palimpsest.llm.word_contexts import LONG, Votes, _add_texts, distinct_words, hash_words, token_hashes

    texts = ["", "One two\x1cX ONE", "x" * (LONG + 1), "\x0b a", "b", " c \n", "", "Éa éA " + "y" * 8 + " " + "z" * 9, "w " * 300]
    tokens = [w for t in texts for w in [*t.encode().lower().split(), b""]]
    hashes, starts = token_hashes(*byte_view(pa.array(texts)))
    assert hashes.tolist() == hash_words(tokens).tolist() and starts.tolist() == np.cumsum([0, *(len(t.encode().split()) + 1 for t in texts[:-1])]).tolist()
    assert len({*tokens}) == len({*hashes.tolist()})
    got = Counter()
    for words, groups, number, _ in distinct_words(pa.array(texts), np.arange(len(texts)) % 2, 1 << 20):
        for w, g, n in zip(words.to_pylist(), groups.tolist(), number.tolist(), strict=True):
            got[w, g] += n
    assert got == Counter((w, k % 2) for k, t in enumerate(texts) for w in t.encode().lower().split())
    votes = Votes()
    _add_texts(votes, pa.array(["p q " * 400_000, "p q"]), 1 << 20)  # two pieces of the first text
    assert votes.counts.max() == 3


def test_new_words_of_several_texts_go_to_the_tokenizer_together(monkeypatch):
    from palimpsest.llm import packing

    library = Tokenizer.from_file(WORDS)
    encode = packing.WordIds(WORDS)
    calls = []
    inner = encode.tokenizer
    encode.tokenizer = type("Counting", (), {"encode_batch_fast": lambda _, x, **named: calls.append(x) or inner.encode_batch_fast(x, **named)})()
    monkeypatch.setattr(packing, "WORDS_KEPT", 8)
    long = "longword" * 10
    texts = ["", "it's one of these", "these it's 12 " + long, "中文 it's Σς", long, "one other", "it's 中文 <|x|>"]
    for turn in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(calls) == 2 * (turn + 1) and all(long not in known for known in encode.known.values())


def test_words_of_long_texts_are_counted_in_slices(monkeypatch):
    import pyarrow as pa

    from palimpsest.llm import word_contexts

    monkeypatch.setattr(word_contexts, "COUNT_BYTES", 50)
    monkeypatch.setattr(word_contexts, "COUNT_WORDS", 3)
    texts = ["a b a c a a " * 20, "", "unbroken" * 9000 + " end", "short one", "a"]
    got = Counter()
    for words, groups, number, _ in word_contexts.distinct_words(pa.array(texts), np.arange(5), 40):
        for w, g, n in zip(words.to_pylist(), groups.tolist(), number.tolist(), strict=True):
            got[w, g] += n
    assert got == Counter((w, k) for k, t in enumerate(texts) for w in t.encode().split())


def test_scores_of_texts_together_equal_those_of_single_ones(monkeypatch):
    import pyarrow as pa

    from palimpsest.llm import language_model

    rng = random.Random(5)
    words = [f"w{k}".encode() for k in range(300)]
    counts = np.array([rng.randint(1, 40) for _ in words] + [90], np.float64)
    codes = np.array([rng.randrange(1 << 19) for _ in range(301)], np.int64)
    cells = {}
    for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
        cells[code] = cells.get(code, 0.0) + n
    shared = language_model.Shared(int(counts.sum()), 301, 20, np.array(list(cells)), np.array(list(cells.values())), [b"", *words[:200]], np.append(counts[-1], counts[:200]), np.append(codes[-1], codes[:200]), language_model.SpellingModel())
    texts = ["", " W1 w2\x1cw3 \n", "\x0b", *(" ".join(rng.choice(["w%d", "W%d", "new%d"]) % rng.randrange(320) for _ in range(rng.randrange(90))) for _ in range(60)), "w5 " * 500]
    held = [k % 7 == 2 for k in range(len(texts))]
    monkeypatch.setattr(language_model, "TOKENS", 700)
    for piece in (language_model.PIECE_BYTES, 1000):  # some texts together, the last in pieces
        monkeypatch.setattr(language_model, "PIECE_BYTES", piece)
        one, together = language_model.BlockScorer(shared), language_model.BlockScorer(shared)
        for scorer in (one, together):
            scorer.tell(words[190:], counts[190:300], codes[190:300])
        for k, text in enumerate(texts):
            one.add(k, held[k], text)
        for low in range(0, len(texts), 9):
            part = slice(low, low + 9)
            together.add_texts([*range(len(texts))][part], held[part], pa.array(texts)[low : low + 9].cast(pa.binary()))
        got, wanted = ([r for batch in scorer.rows() for r in batch.to_pylist()] for scorer in (together, one))
        if piece > 1000:
            assert got == wanted
        else:
            assert [r["n_tokens"] for r in got] == [r["n_tokens"] for r in wanted] and np.allclose([r["score"] for r in got], [r["score"] for r in wanted])


def test_word_tables_keep_the_first_of_a_slot():
    from palimpsest.llm.word_contexts import SLOT_BITS, WordTable

    top = np.uint64(5) << np.uint64(64 - SLOT_BITS)
    table = WordTable()
    assert table.find(np.array([0, top], np.uint64)).tolist() == [-1, -1]
    table.put(np.array([top, top + np.uint64(1)], np.uint64), np.array([7, 8]))
    more = table.copy()
    more.put(np.array([top + np.uint64(2), 0], np.uint64), np.array([9, 10]))
    asked = np.array([0, top, top + np.uint64(1), top + np.uint64(2)], np.uint64)
    assert more.find(asked).tolist() == [10, -1, 8, -1] and table.find(asked).tolist() == [-1, -1, 8, -1]


def test_votes_of_a_slot_are_the_most_less_the_next(monkeypatch):
    from palimpsest.llm import word_contexts

    rng = np.random.default_rng(3)
    starts, text = np.arange(0, 6000, 30), np.arange(6000) // 30
    hashes = rng.integers(0, 40, 6000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    real = word_contexts._slot_and_pair
    for slots in (50, word_contexts.SLOTS):  # few slots have several pairs each
        monkeypatch.setattr(word_contexts, "_slot_and_pair", lambda c, h, slots=slots: (real(c, h)[0] % slots, real(c, h)[1]))
        votes = word_contexts.Votes()
        votes.add(hashes, starts)
        for k, context in enumerate(word_contexts.context_hashes(hashes, starts)):
            found = {}
            for slot, pair, _ in set(zip(*(x.tolist() for x in word_contexts._slot_and_pair(context, hashes)), text.tolist(), strict=True)):
                found.setdefault(slot, Counter())[pair] += 1
            for slot, pairs in found.items():
                (best, n), (_, following) = [*pairs.most_common(2), (0, 0)][:2]
                assert votes.counts[k, slot] == n - following and (n == following or votes.pairs[k, slot] == best)
            assert np.count_nonzero(votes.counts[k]) <= len(found)
