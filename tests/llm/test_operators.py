"""Each operator against brute force, an exact round trip or held-out accuracy; nulls, empty tables, repeats, odd columns."""

import hashlib
import json
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import bpe, decontaminate, flac, lm, ngrams, quality, queries, setjoin, sharding, tokenfiles, toxicity, urls
from loam.llm.common import crc_mod, fresh_path, scope, written
from tests.oracle import same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [n for n in queries.queries() if n.startswith("op")]


def frame(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "The quick brown fox jumps over the lazy dog. It was a day."),
    (6, "The quick brown fox jumps over the lazy dog. It was a day."),
    (7, "é" * 3000 + " 中文 😀\x00 <|endoftext|> tail"),
    (8, "word " * 5000),
    (9, "a" * 20000),
    (10, "loser trash. " * 3),
]
ODD_ROWS = [*ODD, (5, "The quick brown fox jumps over the lazy dog. It was a day."), (4, "another text of the same id"), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of odd tables, one of empty ones; columns with clashing names added."""
    out = {}
    for name, rows in (("odd", ODD_ROWS), ("empty", [])):
        path = tmp_path_factory.mktemp(name)
        docs = frame(spark, rows)
        for c in ("row", "s", "score", "ids", "part", "h", "n", "token", "key", "words", "toxic", "host", "shard", "media"):
            docs = docs.withColumn(c, F.lit("x"))
        docs.write.parquet(f"{path}/documents.parquet")
        labels = [(10, 1, 1), (5, 1, 0), (5, 1, 0), (8, 0, 0), (None, 1, 1), (4, None, None)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        items = [(1, "quick brown fox jumps over the lazy dog it was a day"), (2, None), (3, "!!"), (None, "lazy dog")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        pages = [(1, "http://A.Example.com/en/7x?q#f"), (2, None), (3, "no scheme"), (4, "https://x.net/de/1"), (4, "https://x.net/de/1"), (5, "://"), (6, "http://com/en/")] if rows else []
        spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{path}/pages.parquet")
        out[name] = str(path)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_odd_and_empty_tables(spark, folder, name):
    query = queries.queries()[name]
    key = "page_id" if name.startswith("op6") else "doc_id"
    got = query(spark, folder["odd"]).collect()
    want = Counter(r[0] for r in spark.read.parquet(f"{folder['odd']}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key).collect())
    assert Counter(r[key] for r in got) == want
    assert query(spark, folder["empty"]).collect() == []


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf, folder, name):
    same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
    same(spark, folder["odd"], queries.queries()[name], queries.oracle_sql()[name])


def read(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1 toxicity


def test_toxicity_held_out(spark, sf):
    base = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.queries()["op1_toxicity"](spark, base).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = [(r.toxic, got[r.doc_id]) for r in read(spark, base, "labels").collect()]
    held = [(y, r) for y, r in labels if r.held_out]
    assert sum(y == r.predicted for y, r in held) >= 0.9 * len(held)


def test_toxicity_locates_sentences():
    texts = [f"Fine words here number {i}. You are scum today. More fine words." for i in range(20)] + [f"Fine words here number {i}. You are well today." for i in range(20)]
    scorer = toxicity.Scorer(*toxicity.train(texts, np.array([1] * 20 + [0] * 20)))
    text = "Good day.\nWhat scum it is! Bye."
    score, spans = scorer.score(text)
    assert score >= 0.5 and [text[s["start"] : s["end"]].strip() for s in spans] == ["What scum it is!"]
    assert scorer.score("Good day.")[0] < 0.5 and scorer.score("") == (scorer.leak, [])


def noisy_or(text, weights, b, leak):
    """A document's score by the formula, from sentences cut anew."""
    sigma = lambda z: 1 / (1 + math.exp(-z))
    clean, z = 1 - leak, 0.0
    for chunk in [*re.split(r"( |\n)", text), "\n"]:
        words = re.findall(r"[^\W_]+", chunk.lower())
        names = [f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6, 7, 8) if len(w) > n))]
        z += min(100.0, sum(weights.get(f, 0.0) for f in names))
        if chunk == "\n" or re.search(r"[.!?][\"')\]»]*$", chunk):
            clean *= 1 - min(1 - 1e-12, (sigma(b + z) - sigma(b)) / (1 - sigma(b)))
            z = 0.0
    return 1 - clean


def test_toxicity_query_is_the_noisy_or(spark, sf, folder):
    for path in (sf, folder["odd"]):
        docs = read(spark, path)
        scorer = toxicity.fit(docs, read(spark, path, "labels"), crc_mod("doc_id", 5) != 0)
        got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in queries.queries()["op1_toxicity"](spark, path).collect()]
        want = []
        for r in docs.collect():
            score = noisy_or(r.text or "", scorer.weights, scorer.b, scorer.leak)
            held = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0
            want.append((r.doc_id, held, round(score, 9), int(score >= 0.5)))
        assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 2 media


def test_flac_round_trip_and_damage():
    random.seed(1)
    payloads = [flac.payload_of(t) for t in ["", None, "x", "é" * 5000, "ab" * 40, "".join(map(chr, random.choices(range(1, 255), k=9000)))]]
    media = flac.encode_streams(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_streams(media)] == payloads
    for at in (len(media[3]) - 1, len(media[3]) // 2, 30, 70, 79):  # frames, the MD5, a seek point's sample and offset
        bad = bytearray(media[3])
        bad[at] ^= 4
        if at == 70:  # a seek table that names not every frame is not needed
            assert (flac.decode_streams([bytes(bad)])[0] + 128).astype(np.uint8).tobytes() == payloads[3]
            continue
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(bad)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def unary(self, q):
        self.bits += "0" * q + "1"

    def data(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, width):
    x = 0
    for b in data:
        x ^= b << (width - 8)
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> (width - 1) & 1 else 0)) & (1 << width) - 1
    return x


def by_hand(samples, kind, depth=8):
    """A one-frame stream, written bit by bit: a linear predictor of order 2 with two partitions, the second escaped; or
    verbatim; or wasted bits."""
    n = len(samples)
    head = b"\xff\xf8" + bytes([0x70, {8: 0x02, 16: 0x08}[depth]]) + b"\x00" + struct.pack(">H", n - 1)
    w = Writer()
    for b in head:
        w.put(b, 8)
    w.put(crc(head, 0x07, 8), 8)
    if kind == "verbatim":
        w.put(1 << 1, 8)
        for x in samples:
            w.put(x, depth)
    elif kind == "wasted":
        w.put(1 << 1 | 1, 8)
        w.unary(1)
        for x in samples:
            w.put(x >> 2, depth - 2)
    else:
        w.put((31 + 2) << 1, 8)
        for x in samples[:2]:
            w.put(x, depth)
        w.put(5, 4)  # precision 6
        w.put(3, 5)  # shift 3
        for c in (14, -6):
            w.put(c, 6)
        w.put(1, 2)  # five-bit parameters
        w.put(1, 4)  # two partitions
        guess = lambda t: (14 * samples[t - 1] - 6 * samples[t - 2]) >> 3
        res = [samples[t] - guess(t) for t in range(2, n)]
        w.put(3, 5)
        for r in res[: n // 2 - 2]:
            u = 2 * r if r >= 0 else -2 * r - 1
            w.unary(u >> 3)
            w.put(u, 3)
        w.put(31, 5)
        w.put(depth + 4, 5)
        for r in res[n // 2 - 2 :]:
            w.put(r, depth + 4)
    frame_bytes = w.data()
    frame_bytes += struct.pack(">H", crc(frame_bytes, 0x8005, 16))
    raw = np.array(samples, dtype=np.int8 if depth == 8 else "<i2").tobytes()
    info = struct.pack(">HH", n, n) + bytes(6) + (8000 << 44 | (depth - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    points = struct.pack(">QQH", 0, 0, n)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + frame_bytes


@pytest.mark.parametrize(("kind", "depth"), [("verbatim", 8), ("wasted", 8), ("linear", 8), ("linear", 16), ("verbatim", 16)])
def test_flac_decodes_other_writers(kind, depth):
    random.seed(2)
    samples = [4 * int(20 * math.sin(i / 5)) + (0 if kind == "wasted" else random.randint(-3, 3)) for i in range(64)]
    assert flac.decode_streams([by_hand(samples, kind, depth)])[0].tolist() == samples


def without_seek_table(stream):
    return stream[:4] + b"\x80" + stream[5:42] + stream[flac.Stream(stream).frames :]


def test_flac_finds_frames_without_seek_points():
    random.seed(5)
    payloads = [flac.payload_of("".join(map(chr, random.choices([*range(97, 123), 32, 255], k=k)))) for k in (0, 63, 5000, 200_000)]
    payloads.append(bytes(random.choices([0xFF, 0xF8, 0xF9, 0x70, 0], k=6400)))  # looks like headers
    bare = [without_seek_table(m) for m in flac.encode_streams(payloads)]
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_streams(bare)] == payloads
    blocks = flac.stream_blocks(bare)[3]
    assert [b.sample_offset for b in blocks] == list(range(0, len(payloads[3]), flac.BLOCK)) and len(blocks) > 128
    for b in blocks[:-1]:
        assert bare[3][b.byte_offset : b.byte_offset + 2] == b"\xff\xf8"
    unknown = bytearray(bare[3])
    unknown[21] &= 0xF0  # no total, no MD5
    unknown[22:42] = bytes(20)
    assert len(flac.decode_streams([bytes(unknown)])[0]) == len(payloads[3])
    info = flac.Stream(bare[3])
    first, second = (blocks[i].byte_offset for i in (1, 2))
    for bad in (bare[3][: info.frames] + bare[3][first:], bare[3][:first] + bare[3][second:], bare[3][:-700], bare[3] + b"tail"):
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bad])


@pytest.mark.parametrize("code", [1, 8, 9, 10])
@pytest.mark.parametrize("depth", [8, 24])
def test_flac_decodes_stereo(code, depth):
    random.seed(code)
    left, right = ([random.randint(-(1 << depth - 1), (1 << depth - 1) - 1) for _ in range(32)] for _ in range(2))
    side = [a - b for a, b in zip(left, right, strict=True)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([a + b >> 1 for a, b in zip(left, right, strict=True)], side)}[code]
    head = b"\xff\xf8" + bytes([0x60, code << 4 | {8: 2, 24: 12}[depth]]) + b"\x00" + bytes([31])
    w = Writer()
    for b in (*head, crc(head, 0x07, 8)):
        w.put(b, 8)
    for values, extra in ((first, code == 9), (second, code in (8, 10))):
        w.put(1 << 1, 8)
        for x in values:
            w.put(x, depth + extra)
    body = w.data()
    body += struct.pack(">H", crc(body, 0x8005, 16))
    raw = b"".join(x.to_bytes(depth // 8, "little", signed=True) for pair in zip(left, right, strict=True) for x in pair)
    info = struct.pack(">HH", 32, 32) + bytes(6) + (8000 << 44 | 1 << 41 | (depth - 1) << 36 | 32).to_bytes(8, "big") + hashlib.md5(raw).digest()
    got = flac.decode_streams([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body])[0]
    assert got.tolist() == [list(pair) for pair in zip(left, right, strict=True)]


def test_flac_encoder_uses_predictors_and_partitions():
    x = np.concatenate([np.round(100 * np.sin(np.arange(1024) / 9)), np.random.default_rng(1).integers(-3, 3, 512), np.random.default_rng(2).integers(-100, 100, 512)])
    stream = flac.encode_streams([(x.astype(np.int64) + 128).astype(np.uint8).tobytes()])[0]
    assert flac.decode_streams([stream])[0].tolist() == x.tolist()
    at = [b.byte_offset for b in flac.stream_blocks([stream])[0]]
    assert stream[at[0] + 8] >> 1 == 31 + flac.ORDER  # a linear predictor
    kind = stream[at[1] + 8] >> 1
    bits = int.from_bytes(stream[at[1] + 9 : at[1] + 29], "big")
    warm = 8 * (kind - 8) if kind < 32 else 8 * flac.ORDER + 9 + flac.ORDER * flac.PRECISION
    assert bits >> (160 - warm - 6) & 63 == flac.PARTS  # eight partitions


def test_flac_query(spark, sf, folder):
    """Every column against hashes of the payload made here and a reading of the stored stream."""
    for path in (sf, folder["odd"]):
        texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
        media = {r.text: r.media for r in flac.store_texts(spark.read.parquet(f"{path}/documents.parquet")).select("text", "media").collect()}
        want = []
        for r in texts:
            raw = (r.text or "").encode()
            payload = raw + bytes((-len(raw)) % 64) if raw else bytes(64)
            x = np.frombuffer(payload, np.uint8).astype(int) - 128
            m = media[r.text]
            feature = {"samples": len(x), "mean": round(float(x.mean()), 6), "rms": round(math.sqrt((x * x).mean()), 6), "peak": int(abs(x).max()), "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum())}
            blocks = -(-len(payload) // flac.BLOCK)
            sums = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest())
            want.append((r.doc_id, len(raw), len(payload), *sums, feature, blocks))
            assert flac.Stream(m).md5 == hashlib.md5((x.astype(np.int8)).tobytes()).digest()
        got = [(*r[:7], json.loads(r.feature), r.n_blocks) for r in queries.queries()["op2_flac"](spark, path).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flac_of_a_text_of_many_megabytes():
    payload = flac.payload_of("All work and no play. " * 300_000)
    (stream,) = flac.encode_streams([payload])
    assert (flac.decode_streams([stream])[0] + 128).astype(np.uint8).tobytes() == payload


def test_pcm_blocks(spark):
    text = "The quick brown fox. " * 300
    df = flac.store_texts(frame(spark, [(1, text), (2, None)]))
    blocks = flac.pcm_blocks(df.select("doc_id", "media")).orderBy("doc_id", "block").collect()
    whole = b"".join(bytes((x + 128) % 256 for x in np.frombuffer(b.pcm, np.int8).astype(int)) for b in blocks if b.doc_id == 1)
    assert whole == flac.payload_of(text)
    assert [b.sample_offset for b in blocks if b.doc_id == 1] == [i * flac.BLOCK for i in range(len(blocks) - 1)]


@pytest.mark.parametrize("hot", [0, 1])
def test_a_repeated_key_leaves_the_others_in_the_sample(spark, monkeypatch, hot):
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    labels = [(i, (i + hot) % 2) for i in range(20)]
    say = lambda i, y: f"{'you loser' if y else 'a fine day'} number {i}."
    rows = [(i, say(i, y)) for i, y in labels] + [(0, say(0, hot) + f" {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((texts, y)) or train(texts, y))
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    texts, y = seen[0]
    assert len(texts) == 20 and y.sum() == 10
    assert scorer.score("You loser.")[0] > 0.5 > scorer.score("A fine day.")[0]


@pytest.mark.parametrize("many", [40, 299, 300, 600])
def test_words_of_few_toxic_documents_have_weight_at_any_size(many):
    texts = ["Zorble."] * 3 + [f"You loser {i}." for i in range(many - 3)] + [f"A fine day {i}." for i in range(many)]
    scorer = toxicity.Scorer(*toxicity.train(texts, np.array([1] * many + [0] * many)))
    assert scorer.score("Oh zorble.")[0] > 0.5 > scorer.score("A fine day.")[0]


# --- 3 set join


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(rng, n_docs=120):
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=40))
    texts = {}
    for i in range(n_docs):
        kind = rng.random()
        if kind < 0.55 and texts:
            w = rng.choice(list(texts.values())).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choices(words, k=rng.randint(1, 120)))
        if kind > 0.9:
            texts[i] += " " + line
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(setjoin, "STAR", 3)
    texts = near_copies(random.Random(seed))
    got = setjoin.near_duplicates(frame(spark, texts.items())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_near_duplicates_of_templates(spark, monkeypatch):
    """Many documents of one template share n-grams that cannot make them similar; some that can are among them."""
    monkeypatch.setattr(setjoin, "STAR", 3)
    monkeypatch.setattr(setjoin, "HOT", 5)
    monkeypatch.setattr(setjoin, "COMMON_LEAST", 2)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join([*words[:11], f"u{i}"]) for i in range(60)}
    texts |= {100 + i: " ".join([*words[5:25], f"v{i}"]) for i in range(20)}
    texts |= {200 + i: " ".join([f"x{i}", *words[5 : 17 + i % 9], f"y{i}"]) for i in range(60)}
    texts |= {300 + i: " ".join(words[i : i + 11 + i % 3]) for i in range(9)}
    got = setjoin.near_duplicates(frame(spark, texts.items())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


@pytest.mark.parametrize("bits", [1, 4])
def test_sets_of_one_hash_are_told_apart(spark, monkeypatch, bits):
    monkeypatch.setattr(setjoin, "SET_BITS", bits)
    texts = near_copies(random.Random(9), 60)
    texts |= {1000 + i: t for i, t in texts.items() if i % 2}
    got = setjoin.near_duplicates(frame(spark, texts.items())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    stay = {r.doc_id for r in got if r.stays}
    assert stay == {i for i, (n, c) in brute_components(texts).items() if c == i or not n}


def test_scope_deletes_what_is_not_kept(spark, tmp_path):
    with scope():
        gone = written(spark.range(3).toDF("id"), "gone")
        kept = written(gone, "kept", keep=True)
        paths = [f.removeprefix("file://").removeprefix("file:") for df in (gone, kept) for f in df.inputFiles()[:1]]
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 3


def test_near_duplicates_documents(spark, sf):
    texts = {r.doc_id: r.text for r in read(spark, sf).collect()}
    got = queries.queries()["op3_ngram_jaccard"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.v: r.root for r in setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v in got:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        assert got[v] == min(seen)


# --- 4 quality


def test_quality(spark, sf):
    base = sf.replace("0.001", "0.01")
    found = {r.doc_id: r for r in queries.queries()["op4_quality"](spark, base).collect()}
    held = [(r.quality, found[r.doc_id].selected) for r in read(spark, base, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_query_by_hand(spark, sf, folder):
    """Models, bound, Gumbel noise and draw in plain Python; only the cutting into n-grams is the operator's."""
    for path in (sf, folder["odd"]):
        rows = read(spark, path).select("doc_id", "text").collect()
        labels = defaultdict(int)
        for r in read(spark, path, "labels").collect():
            if r.quality in (0, 1) and r.doc_id is not None:
                labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
        training = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows]
        y = [labels.get(r.doc_id) if t else None for r, t in zip(rows, training, strict=True)]
        where, owner = quality.buckets(pa.record_batch({"text": [r.text for r in rows]}), 0)
        counts = np.zeros((2, quality.SIZE))
        np.add.at(counts[0], where, 1)
        np.add.at(counts[1], where[np.array([v == 1 for v in y])[owner]], 1)
        weight = np.bincount(owner, quality.log_ratios(counts)[where], minlength=len(rows))
        good, bad = ([w for w, v in zip(weight, y, strict=True) if v == c] for c in (1, 0))
        pick = lambda x, share: sorted(x)[max(0, math.ceil(share * len(x)) - 1)]
        k = len(rows)
        if good and bad:
            low, high = pick(good, 0.005), pick(bad, 0.98)
            k = sum(w >= ((low + high) / 2 if high < low else low) for w in weight)
        keys = []
        for r, w in zip(rows, weight, strict=True):
            h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
            u = ((xxhash.xxh64_intdigest(struct.pack("<i", 7), h) >> 11) + 0.5) / (1 << 53)
            keys.append(w - math.log(-math.log(u)))
        got = queries.queries()["op4_quality"](spark, path).collect()
        want = sorted(zip([str(r.doc_id) for r in rows], weight, keys, strict=True))
        for (i, w, g), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.log_weight)), strict=True):
            assert (i, r.log_weight, r.gumbel_key) == (str(r.doc_id), pytest.approx(w, abs=1e-5), pytest.approx(g, abs=1e-5))
        chosen = sorted(r.gumbel_key for r in got if r.selected)
        ties = sum(abs(r.gumbel_key - chosen[0]) < 1e-6 for r in got)
        assert k - 1 <= len(chosen) <= k + ties  # one for a weight at the very bound
        assert chosen[0] >= max((r.gumbel_key for r in got if not r.selected), default=-math.inf)


def test_quality_beyond_a_broadcast(spark, sf, monkeypatch):
    query = queries.queries()["op4_quality"]
    want = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, query(spark, sf).collect())) == want


def test_log_importance_is_the_models_ratio(spark):
    texts = [(1, "a b a"), (2, "a c ***"), (3, None)]
    docs = frame(spark, texts)
    batch = pa.record_batch({"text": [t for _, t in texts]})
    where, rows = quality.buckets(batch, 0)
    counts = np.zeros((2, quality.SIZE))
    np.add.at(counts[0], where, 1)
    np.add.at(counts[1], where[rows == 0], 1)
    got = quality.count_buckets(docs.withColumn("w", F.col("doc_id") == 1), "text", "w")
    assert (got == counts).all()
    ratios = quality.log_ratios(counts)
    scored = {r.doc_id: r for r in quality.log_importance(docs, ratios).collect()}
    for i, (k, _) in enumerate(texts):
        assert math.isclose(scored[k].log_weight, ratios[where[rows == i]].sum(), abs_tol=1e-9)
        assert scored[k].n_grams == (rows == i).sum()


@pytest.mark.parametrize("k", [0, 1, 37, 150, 199, 200])
def test_top_k(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice([5, 7, -(10**15), 10**15, rng.randrange(10**9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v long")
    got = {r.i for r in quality.top_k(df, "v", F.col("i"), k).where("selected").collect()}
    assert got == {i for i, v in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:k]}


# --- 5 sharding


def test_shards(spark, sf):
    rows = sorted(read(spark, sf).collect(), key=lambda r: r.doc_id)
    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    got = sorted(queries.queries()["op5_sharding"](spark, sf).collect(), key=lambda r: r.doc_id)
    start, slots = 0, Counter()
    for r, doc, size in zip(got, rows, sizes, strict=True):
        shard = min(7, (2 * start + size) * 8 // (2 * sum(sizes)))
        want = (doc.doc_id, size, zlib.crc32((doc.text or "").encode()), "bytes", shard, slots[shard], None)
        assert (r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == want
        slots[shard] += 1
        start += size


def test_shards_of_repeats(spark):
    docs = frame(spark, [(1, "x" * 10)] * 50 + [(None, "y")] * 20)
    got = sharding.byte_balanced_shards(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert len(got) == 70 and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    totals = [sum(x.size for x in v) for v in by.values()]
    assert max(totals) - min(totals) <= 22


# --- 6 urls


def test_filter_passes_all_rules(spark):
    rules = spark.createDataFrame([(f"h{i}.org", f"/p{i}", "block") for i in range(500)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://a.h{i}.org/p{i}/x") for i in range(700)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, rules).collect()}
    # p1 is a prefix of p12: the rule of the page's own host decides
    assert got == {i: "block" if i < 500 else "allow" for i in range(700)}


def test_filter_drops_most_keys(spark):
    rules = spark.createDataFrame([(f"{i}", 1, 1, "x") for i in range(2000)], "key string, host_length int, path_length int, rule_verdict string")
    words = urls.build_filter(rules.select(F.xxhash64("key").alias("h")), 2000)
    block, bits = urls.block_words(np.array([urls.key_hash(f"k{i}") for i in range(20000)], dtype=np.uint64), len(words))
    assert ((words[block] & bits) == bits).all(axis=1).mean() < 0.02
    block, bits = urls.block_words(np.array([urls.key_hash(f"{i}") for i in range(2000)], dtype=np.uint64), len(words))
    assert ((words[block] & bits) == bits).all()


# --- 7, 9 tokens

BITS = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "1", "!", "'s", "'", "\x85", "\xa0", " ", "\x1c", "\x1f", "<|endoftext|>", "<|", "😀", "́", "\r\n", "the", " the", "ing", "\x00", "٣", "İ", "Σ", "<|startoftext|>"]


def random_texts(n=1500):
    rng = random.Random(6)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "", "a" * 3000, "ab" * 2000, "x " * 50, "!" * 300, "the" * 1500 + " " + "\n" * 70]


def test_byte_pairs_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, library = bpe.BytePairs(path), Tokenizer.from_file(path)
    texts = random_texts()
    for text, ids in zip(texts, model.encode_texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_trees_agree():
    model = bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 16))).encode() for _ in range(500)]
    together = model.encode_level(words, 16)
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == [model.encode_wide(w) for w in words]


def test_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, library = tokenfiles.Words(path, 4), Tokenizer.from_file(path)
    texts = random_texts()
    for text, ids in zip(texts, model.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in read(spark, sf).collect()}
    for r in queries.queries()["op7_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files_query(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenfiles, "DOCS_A_FILE", 30)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: r for r in queries.queries()["op9_token_files"](spark, sf).collect()}
    for doc in sorted(read(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(doc.text or "", add_special_tokens=False).ids, 1]
        r = got.pop(doc.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("hot", [3, None])
def test_token_files_of_a_hot_key(spark, monkeypatch, hot):
    """Files stay in order of keys, hold near as many documents each, and lose none."""
    monkeypatch.setattr(tokenfiles, "DOCS_A_FILE", 20)
    rows = [(hot, f"text {i % 50} of it") for i in range(400)] + [(i, f"some text {i}") for i in range(100)] + [(None, "none")]
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    files = tokenfiles.write_token_files(frame(spark, rows).repartition(8), vocabulary, fresh_path(spark, "hot"))
    got = tokenfiles.read_token_files(files).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and Counter(keys) == Counter(k for k, _ in rows)
    library = Tokenizer.from_file(vocabulary)
    bodies = lambda pairs: Counter((k, tuple(x)) for k, x in pairs)
    assert bodies((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == bodies((k, [*library.encode(t, add_special_tokens=False).ids, 1]) for k, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert max(r.n_docs for r in files.collect()) <= 60


def test_token_file_random_access(tmp_path):
    uri = f"file://{tmp_path}/x.ltf"
    docs = [(k, np.arange(k * 10, dtype="<u2").tobytes()) for k in (3, 5, 8)] + [(None, b"")]
    assert tokenfiles.write_file(uri, docs, 2) == (4, 160)
    f = tokenfiles.TokenFile(uri)
    assert f.find(5) == [1] and f.ids(1).tolist() == list(range(50)) and f.ids(3).tolist() == []
    raw = bytearray((tmp_path / "x.ltf").read_bytes())
    raw[int(f.entries[2]["offset"]) + 9] ^= 255
    (tmp_path / "y.ltf").write_bytes(raw)
    bad = tokenfiles.TokenFile(f"file://{tmp_path}/y.ltf")
    assert bad.ids(0).tolist() == list(range(30))
    with pytest.raises(tokenfiles.TokenFileError):
        bad.ids(2)
    (tmp_path / "z.ltf").write_bytes(raw[:-3])
    with pytest.raises(tokenfiles.TokenFileError):
        tokenfiles.TokenFile(f"file://{tmp_path}/z.ltf")
    import io

    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "x.ltf").read_bytes()), read_across_frames=True).read()
    assert plain == b"".join(x for _, x in docs)


# --- 8 decontamination


def brute_windows(docs, items, size=13):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_contamination(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "x-y", "Q"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 12, 13, 14, 30])))) for i in range(40)] + [(99, None), (98, "...")]
    docs = []
    for d in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(4)]
        docs.append((d, ", ".join(parts).upper() if d % 3 else " ".join(parts)))
    docs.append((60, None))
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == brute_windows(docs, items)


# --- 10 language model


def brute_lm(docs, weights):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in docs}
    single, pair = Counter(), Counter()
    context = Counter()
    for i, _, part in docs:
        if part:
            single.update(tokens[i])
            for h, w in zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True):
                pair[h, w] += 1
                context[h] += 1
    n, v = sum(single.values()), len(single)
    out = {}
    for i in tokens:
        base = score = 0.0
        for h, w in zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True):
            p = (single[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            if context[h]:
                x = weights[min(math.frexp(context[h])[1], lm.BUCKETS - 1)]
                p = x * pair[h, w] / context[h] + (1 - x) * p
            score += math.log10(p)
        out[i] = (len(tokens[i]), sum(single[w] > 0 for w in tokens[i]), n, base, score)
    return out


def test_language_model(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 40_000)
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = [(r.doc_id, r.text, min(2, r.doc_id % 10)) for r in read(spark, sf).collect()] + [(1000, None, 2), (1001, "", 0)]
    got = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string, part int")).collect()
    want = brute_lm(docs, seen["w"])
    assert ((seen["w"] > 0) & (seen["w"] < 1)).all()
    for r in got:
        tokens, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in got if r.doc_id % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_equal_a_plain_em(spark, sf, monkeypatch):
    """The table of cells gives nearly the weights that EM over the single events gives."""
    monkeypatch.setattr(lm, "BLOCK", 40_000)
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = [(r.doc_id, r.text, min(2, r.doc_id % 10)) for r in read(spark, sf).collect()]
    lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string, part int")).collect()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in docs}
    grams = lambda i: list(zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True))
    single, pair, context = Counter(), Counter(), Counter()
    for i, _, part in docs:
        if part == 2:
            single.update(tokens[i])
            pair.update(grams(i))
            context.update(h for h, _ in grams(i))
    known = len({t for i, _, part in docs if part for t in tokens[i]})
    n = sum(single.values())
    events = defaultdict(list)
    for i, _, part in docs:
        for h, w in grams(i) if part == 1 else []:
            if context[h]:
                events[math.frexp(context[h])[1]].append((pair[h, w] / context[h], (single[w] + 0.1) / (n + 0.1 * (known + 1))))
    assert len(events) > 3
    for bucket, own in events.items():
        x = 0.5
        for _ in range(lm.STEPS):
            x = (sum(x * p / (x * p + (1 - x) * q) for p, q in own) + 0.5) / (len(own) + 1)
        assert abs(x - seen["w"][bucket]) < 0.02, bucket


def test_language_model_query(spark, sf, folder, monkeypatch):
    for path in (sf, folder["odd"]):
        seen = {}
        learn = lm.learn_weights
        with monkeypatch.context() as m:
            m.setattr(lm, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))  # noqa: B023
            got = queries.queries()["op10_lm"](spark, path).collect()
        rows = read(spark, path).select("doc_id", "text").collect()
        rest = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 for r in rows]
        want = brute_lm([(k, r.text, min(2, x)) for k, (r, x) in enumerate(zip(rows, rest, strict=True))], seen["w"])
        flat = [(rows[k].doc_id, rest[k] == 0, *want[k][:3], round(want[k][3], 6), round(want[k][4], 6)) for k in want]
        assert sorted([(*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got], key=repr) == sorted(flat, key=repr)


# --- hashes


def test_hashes_tell_words_apart():
    texts = ["a b", "A\tb", "ab", "b a", "a  b\n", "", "a b c d e f", None, "c d e f"]
    raw, ends = ngrams.text_bytes(pa.array(texts))
    words, bounds = ngrams.word_hashes(raw, ends)
    own = [words[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert own[0] == own[1] == own[4] and own[0] != own[3] and len(own[2]) == 1 and own[5] == own[7] == []
    grams, at = ngrams.shingles(words, bounds, 5)
    assert np.diff(at).tolist() == [1, 1, 1, 1, 1, 0, 2, 0, 1]
    assert grams[0] == grams[1] != grams[3]


def test_sliced_columns():
    column = pa.array(["x", "a b", None, "c"]).slice(1)
    raw, ends = ngrams.text_bytes(column)
    assert raw.tobytes() == b"a bc" and ends.tolist() == [0, 3, 3, 4]


def test_fresh_paths(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
