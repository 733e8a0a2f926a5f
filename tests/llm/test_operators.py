"""Operators of the llm subpackage against brute force on a small table of odd rows: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papertide.llm import ann_forest, bpe_codec, flac, hmm_lm, ngram_jaccard, packing, quality, sharding, suffix_dedup, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASHING = ", ".join(f"{c} string" for c in ("row", "size", "node", "shard", "slot", "score", "n_tokens", "kept", "piece", "component"))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    words = ["the", "of", "Étude", "ciudad", "x", "naïve", "don't", "it's", "12", "3.5%", "中文", "😀", "Straße", "ΣΑΣ", "áb", "Ᲊ"]
    say = lambda n: " ".join(rng.choice(words) + ("" if rng.random() < 0.7 else str(rng.randint(0, 99))) for _ in range(n))
    base, long = say(80), say(9000)
    near = base.split()
    near[40] = "changed"
    rows = [(i, say(rng.randint(1, 60))) for i in range(40)]
    rows += [(100, base), (101, base), (102, " ".join(near)), (103, say(30) + " " + base[50:250] + " " + say(10)), (104, None), (105, ""), (106, " \n\t "), (107, "word"), (108, "word"), (109, long), (110, "z" * 70000)]
    rows += [(111, "tell <|endoftext|> me"), (112, "<|startoftext|>"), (113, "\x00\x00" * 60), (None, base), (None, "alone"), (7, rows[7][1]), (101, base), (114, "a\r\n b \x1c c")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["?"] * 10) for i, t in rows], f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="module")
def none(documents):
    return documents.where("false")


def keyed(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_token_counts(documents, none, rows):
    t = Tokenizer.from_file(BYTE)
    got = keyed(token_counts.token_counts(documents, BYTE, limit=20), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = Counter()
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[(i, len((x or "").encode()), n, n > 20)] += 1
    assert got == want
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_token_counts_of_a_very_long_pretoken(spark):
    run = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    n = len(Tokenizer.from_file(BYTE).encode(run, add_special_tokens=False).ids)
    assert n > 0xFFFF
    frame = spark.createDataFrame([(1, run), (2, "a " + run)], "doc_id long, text string")
    assert keyed(token_counts.token_counts(frame, BYTE), "doc_id", "n_bytes", "n_tokens") == Counter([(1, 300_000, n), (2, 300_002, len(Tokenizer.from_file(BYTE).encode("a " + run, add_special_tokens=False).ids))])


def test_encode_decode(documents, none, rows):
    t = Tokenizer.from_file(WORD)
    got = keyed(bpe_codec.encode_decode(documents, WORD), "doc_id", "n_tokens", "ids", "decoded")
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), bytearray(np.array(ids, "<u4").tobytes()).hex(), t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((i, n, bytes(b).hex(), d) for i, n, b, d in ((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe_codec.encode_decode(documents, WORD).collect())) == want
    assert sum(got.values()) == len(rows)
    assert bpe_codec.encode_decode(none, WORD).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_transducer_in_parts(path):
    merges, t, rng = bpe_codec.MergeList(path), Tokenizer.from_file(path), random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("abcdeinrsté") for _ in range(rng.choice([1, 9, 700, 1500])))
        encoder, data, got = bpe_codec.WordEncoder(merges), word.encode(), []
        while data:
            n = rng.randint(1, 250)
            got += encoder.feed(data[:n])
            assert len(encoder.held) <= encoder.window
            data = data[n:]
        got += encoder.finish()
        assert got == t.encode(word, add_special_tokens=False).ids
        decoder = bpe_codec.TextDecoder(merges)
        assert "".join(decoder.feed([x]) for x in got) + decoder.feed([], True) == t.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_all_words_pass_the_encoder_and_all_ids_the_decoder(rows, path, monkeypatch):
    fed, read = [], [0]

    class Encoder(bpe_codec.WordEncoder):
        def feed(self, data):
            assert len(data) <= bpe_codec.BYTES
            fed.append(bytes(data))
            return super().feed(data)

    class Decoder(bpe_codec.TextDecoder):
        def feed(self, ids, final=False):
            read[0] += len(ids)
            return super().feed(ids, final)

    monkeypatch.setattr(bpe_codec, "WordEncoder", Encoder)
    monkeypatch.setattr(bpe_codec, "TextDecoder", Decoder)
    monkeypatch.setattr(bpe_codec, "IDS", 700)
    odd = ["\U0001fae9 new <|endoftext|><|endoftext|> x \u1c89\u1c8a \U0001fae9x", "<|endoftext|>", "Ab<|startoftext|>Cd's"]
    given = [x or "" for _, x in rows] + odd
    out = pa.concat_tables(bpe_codec.coded(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(given))), "text": given})]), path))
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in given]
    assert [np.frombuffer(b, "<u4").tolist() for b in out["ids"].to_pylist()] == want
    assert out["decoded"].to_pylist() == [t.decode(x, skip_special_tokens=False) for x in want]
    assert read[0] == sum(map(len, want))
    met = {"".join(w) for x in given if "<|" not in x for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(x) if t.normalizer else x)}
    letters = bpe_codec.byte_alphabet()
    assert {w for w in met if len(w) <= 100} <= {"".join(letters[b] for b in data) for data in fed} and len(b"z" * 70000) <= sum(len(d) for d in fed)


@pytest.mark.parametrize("shards", [3, 40, 100])
def test_sharding(documents, none, rows, shards):
    out = sharding.shard_rows(documents, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x in rows)
    slots: dict[int, list[int]] = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(none, shards).count() == 0


def test_sharding_is_uniform(spark):
    """Where a document goes, over many seeds, is even over the slots."""
    frame, hits = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).cache(), Counter()
    for seed in range(40):
        hits.update((r.shard, r.slot) for r in sharding.shard_rows(frame, 3, seed=seed).where("doc_id < 4").collect())
    assert len(hits) == 12 and sum((n - 160 / 12) ** 2 / (160 / 12) for n in hits.values()) < 31.3  # chi-square, 11 degrees, 0.1 %


def test_hypergeometric_counts():
    m = sharding.hypergeometric([5, 0, 7, 3], [4, 4, 4, 3], 1)
    assert m.sum(axis=0).tolist() == [4, 4, 4, 3] and m.sum(axis=1).tolist() == [5, 0, 7, 3]


def test_hypergeometric_counts_of_billions_of_rows():
    counts = [5_000_000_000 // 64 + (b < 5) for b in range(64)]
    sizes = [sum(counts) // 40 + (s < sum(counts) % 40) for s in range(40)]
    m = sharding.hypergeometric(counts, sizes, 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and m.min() >= 0
    # Each entry is near its mean, and all together are as far from it as chance has them: chi-square with 63 * 39 degrees, within 5 deviations.
    mean = np.outer(counts, sizes) / sum(counts)
    chi = (np.square(m - mean) / mean).sum()
    assert abs(chi - 63 * 39) < 5 * (2 * 63 * 39) ** 0.5


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(8)
    got = Counter(sharding._drawn(7, 5, 6, rng) for _ in range(20_000))
    want = {k: math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6) for k in range(1, 7)}
    assert set(got) <= set(want) and sum((got[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in want.items()) < 20.5  # chi-square, 5 degrees, 0.1 %
    for good, bad, n in ((0, 5, 3), (5, 0, 3), (4, 4, 8), (3, 9, 0)):
        assert sharding._drawn(good, bad, n, rng) == min(good, n) if bad == 0 or good == 0 or n in (0, good + bad) else True


def test_sharding_in_cells_and_of_equal_rows(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 4)
    monkeypatch.setattr(sharding, "HOT", 50)
    frame = documents.select("doc_id", "text").union(spark.range(400).select(F.lit(9).cast("long"), F.lit("same")))
    out = sharding.shard_rows(frame, 3).collect()
    slots: dict[int, list[int]] = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[s]) for s in range(3)]
    assert len(out) == len(rows) + 400 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    same = Counter(r.shard for r in out if r.doc_id == 9 and r.size == 20)
    assert sum(same.values()) == 400 and min(same.values()) > 90


def test_packing(documents, none, rows):
    t, room = Tokenizer.from_file(WORD), 64
    out = packing.pack(documents, WORD, room=room, end=1).collect()
    want = Counter()
    total = 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p in range(0, len(ids), room):
            want[(i, p // room, p, len(ids[p : p + room]), zlib.crc32(np.array(ids[p : p + room], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins: dict[int, list] = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= room
    assert len(bins) <= 1.02 * -(-total // room) + 1
    assert packing.pack(none, WORD).count() == 0


def test_packing_in_parts(documents, monkeypatch):
    whole = keyed(packing.pack(documents, WORD, room=64), "doc_id", "piece", "length", "ids_crc32")
    monkeypatch.setattr(packing, "PIECES", 50)
    out = packing.pack(documents, WORD, room=64).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == whole
    places = Counter((r.sequence_id, r.offset) for r in out)
    assert max(places.values()) == 1


def test_token_counts_from_a_sample(documents):
    whole = keyed(token_counts.token_counts(documents, BYTE), "doc_id", "n_tokens")
    assert keyed(token_counts.token_counts(documents, BYTE, sample_docs=5, size=3), "doc_id", "n_tokens") == whole


def test_best_two_fit_improves_the_greedy_bin():
    # Greedy takes 6 and 3 (gap 1); 2 and 2 fit the gap that 3 leaves exactly.
    assert packing._fill([2, 3, 6], {2: 2, 3: 1, 6: 1}, 10) == {6: 1, 2: 2}


def test_flac_round_trip(documents, none, rows):
    out = flac.media(documents).collect()
    want = Counter()
    for i, x in rows:
        b = (x or "").encode()
        want[(i, len(b), b.ljust(max(192, -(-len(b) // 192) * 192)))] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in out) == want
    by_text = {}
    for r in out:
        assert by_text.setdefault(bytes(r.payload), (bytes(r.stream), r.feature)) == (bytes(r.stream), r.feature)
        assert sum(b.samples for b in r.blocks) == len(r.payload)
    assert flac.media(none).count() == 0


def scalar_decode(stream: bytes, kinds: set[int]) -> bytes:
    """A plain bit-by-bit reader of the frames of a stream, for comparison. kinds: takes those of the predicted subframes."""
    info = flac.metadata(stream)
    bits, at = "".join(f"{b:08b}" for b in stream), info.begin * 8

    def take(n):
        nonlocal at
        v = int(bits[at : at + n] or "0", 2) if n else 0
        at += n
        return v

    signed = lambda v, n: v - (1 << n) if n and v >> (n - 1) else v
    out = []
    while len(out) < info.samples:
        begin = at
        assert take(15) == 0b111111111111100 and not take(1)
        size_code, _ = take(4), take(4)
        assert take(4) == 0 and take(3) == 1 and not take(1)
        lead = take(8)
        for _ in range(0 if lead < 0x80 else f"{lead:08b}".index("0") - 1):
            assert take(2) == 2
            take(6)
        n = take(16) + 1 if size_code == 7 else {1: 192, 3: 1152}[size_code]
        take(8)
        assert not take(1)
        kind = take(6)
        assert not take(1)
        if kind == 0:
            got = [signed(take(8), 8)] * n
        elif kind == 1:
            got = [signed(take(8), 8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            got = [signed(take(8), 8) for _ in range(order)]
            weights, shift = (flac.COEFFICIENTS[order], 0) if kind < 32 else ([], 0)
            if kind >= 32:
                precision, shift = take(4) + 1, signed(take(5), 5)
                weights = [signed(take(precision), precision) for _ in range(order)]
            kinds.add(kind)
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            while len(got) < n:
                q = 0
                while not take(1):
                    q += 1
                f = q << k | take(k)
                guess = sum(c * got[-1 - j] for j, c in enumerate(weights)) >> shift
                got.append(guess + (f >> 1 ^ -(f & 1)))
        at = -(-at // 8) * 8
        crc = 0
        for b in stream[begin // 8 : at // 8]:
            crc = (crc << 8 & 0xFFFF) ^ int(flac.CRC16[crc >> 8 ^ b])
        assert take(16) == crc
        out += got
    assert at == len(bits)
    return bytes(s + 128 & 255 for s in out)


def test_flac_is_read_by_a_plain_reader_and_damage_is_found():
    rng, kinds = np.random.default_rng(1), set()
    prose = ("Some prose, with words of many lengths and a full stop. " * 99)[:4032].encode()
    ramp = np.cumsum(rng.integers(-2, 3, 4000)).astype(np.int64) % 200
    for payload in (b" " * 192, prose, bytes(rng.integers(0, 256, 2304, dtype=np.uint8)), b"some text " * 576, bytes(ramp[:3840].astype(np.uint8))):
        (stream,) = flac.encode(np.frombuffer(payload, np.uint8), np.array([len(payload)]))
        assert scalar_decode(stream, kinds) == payload
        info = flac.metadata(stream)
        assert [s[0] for s in info.seek] == list(range(0, -(-len(payload) // 1152) * 1152, 1152 * flac.SEEK))
        bad = bytearray(stream)
        bad[-5] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    assert 31 + flac.LINEAR in kinds and len(kinds) > 1


def test_flac_features(spark):
    lines = ["Some prose.", "", "x" * 500, "\u00e9" * 100]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for r in flac.media(frame).collect():
        body = lines[r.doc_id].encode()
        s = [b - 128 for b in body.ljust(max(192, -(-len(body) // 192) * 192))]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(s[:-1], s[1:], strict=True))
        assert r.feature == f"rms={math.sqrt(sum(x * x for x in s) / len(s)):.4f};crossings={crossings};peak={max(map(abs, s))}"


def test_flac_linear_predictor_of_order_two():
    """A stream written by hand with a quantised predictor, two partitions and an escaped one."""
    samples = [10, 12]
    residual = [1, 0, -1, 2, 0, 0, 1, -3, 0, 1, 0, 0, -1, 0]
    for r in residual:
        samples.append(((4 * samples[-1] - 2 * samples[-2]) >> 1) + r)
    samples = [max(-128, min(127, s)) for s in samples]
    residual = [samples[i] - ((4 * samples[i - 1] - 2 * samples[i - 2]) >> 1) for i in range(2, 16)]
    b = lambda v, n: f"{v & ((1 << n) - 1):0{n}b}"
    rice = lambda r, k: "0" * (((r << 1) ^ (r >> 63)) >> k) + "1" + (b((r << 1) ^ (r >> 63), k) if k else "")
    body = b(0, 1) + b(33, 6) + b(0, 1) + b(samples[0], 8) + b(samples[1], 8) + b(3, 4) + b(1, 5) + b(4, 4) + b(-2, 4)
    body += b(0, 2) + b(1, 4) + b(1, 4) + "".join(rice(r, 1) for r in residual[:6]) + b(15, 4) + b(9, 5) + "".join(b(r, 9) for r in residual[6:])
    body += "0" * (-len(body) % 8)
    head = bytes([0xFF, 0xF8, 0b01110100, 0b00000010, 0]) + (15).to_bytes(2, "big")
    frame = head + bytes([flac.crc8(head)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    md5 = hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + md5
    if all(-128 < s < 127 for s in samples):
        got, _, _ = flac.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame])
        assert got.tolist() == samples


def shingle_sets(rows, n=5):
    out = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_classes(rows):
    sets, ids = shingle_sets(rows), [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return Counter((i, find(i) if i is not None else None, links[k]) for k, i in enumerate(ids))


def test_jaccard_classes(documents, none, rows):
    assert keyed(ngram_jaccard.jaccard_classes(documents), "doc_id", "class_id", "n_links") == brute_classes(rows)
    assert ngram_jaccard.jaccard_classes(none).count() == 0


def test_jaccard_pairs_within_a_large_group():
    rng, rows = random.Random(9), []
    base = [str(rng.randint(0, 999)) for _ in range(120)]
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = str(rng.randint(1000, 9999))
        rows.append((i, " ".join(w)))
    sets = shingle_sets(rows)
    numbers = {s: np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k, s in enumerate(sorted(set().union(*sets)))}
    gram = np.concatenate([np.sort(np.array([numbers[s] for s in x], np.uint64)) for x in sets])
    every = np.arange(150)
    i, j = ngram_jaccard.similar_pairs(gram, np.array([len(s) for s in sets]), every, every, 0.8, 1e-7)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for b in range(150) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("tile", [ngram_jaccard.TILE, 4])
def test_jaccard_classes_of_groups_and_chains(spark, tile):
    """Near copies of one text, and a chain of texts each of which is near to its neighbours only; keys split in tiles give the same."""
    rng = random.Random(10)
    rows, base, stream = [], [str(rng.randint(0, 999)) for _ in range(100)], [str(rng.randint(0, 99999)) for _ in range(700)]
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = str(rng.randint(1000, 9999))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(stream[4 * i : 4 * i + 100])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert keyed(ngram_jaccard.jaccard_classes(frame, tile=tile), "doc_id", "class_id", "n_links") == brute_classes(rows)


def test_pairs_compared_in_a_chain_stay_linear(spark):
    stream = [str(x) for x in random.Random(11).choices(range(100_000), k=5000)]
    compared = []
    for size in (200, 400):
        chain = spark.createDataFrame([(i, " ".join(stream[6 * i : 6 * i + 100])) for i in range(size)], "id long, text string")
        met = ngram_jaccard.tiles(ngram_jaccard._nodes(chain, 5).select("node", "bands").coalesce(2))
        compared.append(sum(r["count"] ** 2 for r in met.groupBy("tile").count().collect()))
    assert compared[1] < 2.5 * compared[0] and compared[1] < 400 * 400 / 8


def brute_repeats(rows, width=50):
    last = (1 << 63) - 1
    low: dict[bytes, int] = {}
    for i, x in rows:
        b = (x or "").encode()
        for k in range(len(b) - width + 1):
            low[b[k : k + width]] = min(low.get(b[k : k + width], last), last if i is None else i)
    out = Counter()
    for i, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if low[b[k : k + width]] < (last if i is None else i):
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("size", [(8 << 20, 1_500_000), (20_000, 2_000)])
def test_repeats(documents, none, rows, size):
    got = suffix_dedup.repeats(documents, block_bytes=size[0], part_anchors=size[1]).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows)
    assert suffix_dedup.repeats(none).count() == 0


def test_deep_shallow_orders_as_sorted_does():
    rng = random.Random(3)
    pool = [bytes(rng.choice(b"ab\x00") for _ in range(50)) for _ in range(4)]
    strings = [(bucket, rng.choice(pool)[: rng.randint(20, 50)] + bytes(rng.choice(b"ab") for _ in range(50))) for bucket in (1, 1, 5) for _ in range(120)]
    strings = [(b, s[:50]) for b, s in strings]
    matrix = np.array([list(s) for _, s in strings], np.uint8)
    order, common = suffix_dedup.deep_shallow(suffix_dedup.big_endian(matrix), np.array([b for b, _ in strings], np.uint64))
    ordered = [strings[k] for k in order.tolist()]
    assert ordered == sorted(strings)
    for (b1, x), (b2, y), n in zip(ordered[:-1], ordered[1:], common[1:].tolist(), strict=True):
        same = next((k for k in range(50) if x[k] != y[k]), 50)
        assert n == -1 if b1 != b2 else min(n, 50) == same


def test_quality(spark, documents, none, rows):
    good, bad = ["calm prose about trees", "rivers run to the sea"], ["BUY!! NOW!! NOW!!", "### win %%% win ###"]
    known = spark.createDataFrame([(i, (good if i % 2 else bad)[i // 2 % 2] + f" {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(None, 1, None), (3, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    weights = quality.train(known, labels)
    out = quality.score(known, weights).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all((r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in out if r.held)
    scored = quality.score(documents, weights).collect()
    assert len(scored) == len(rows) and all(0 <= r.quality_score <= 1 and r.quality_predicted == int(r.quality_score >= 0.3) for r in scored)
    assert len({r.quality_score for r in scored if not (r.text or "").strip(" \n\t")}) == 1
    assert quality.score(none, weights).count() == 0
    assert {r.quality_score for r in quality.score(known, quality.train(none.select("doc_id", "text"), labels)).collect()} == {0.5}


def test_language_model(documents, none, rows, monkeypatch):
    token = lambda x: [*(x or "").encode().lower().split(), "end"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, x in rows if not held(i) for w in token(x))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(token(x)), sum(count[w] > 0 for w in token(x)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token(x)), 6)) for i, x in rows)
    out = hmm_lm.score(documents).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert hmm_lm.score(none).count() == 0
    monkeypatch.setattr(hmm_lm, "GATHERED", 1)  # how many sequences are gathered decides only what runs together
    again = {(r.doc_id, r.n_tokens): r.score for r in hmm_lm.score(documents).collect()}
    assert all(math.isclose(again[r.doc_id, r.n_tokens], r.score, rel_tol=1e-3) for r in out)


def test_language_model_passes_cover_all_documents(spark, monkeypatch):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 7, F.col("id") % 11).alias("text"))
    read, one_pass = [], hmm_lm._pass
    monkeypatch.setattr(hmm_lm, "_pass", lambda frame, model: (read.append(frame.count()), one_pass(frame, model))[1])
    out = hmm_lm.score(many)
    assert read == [out.where("not held_out").count()] * 14


def test_training_raises_the_likelihood_of_held_out_texts(spark, monkeypatch):
    """Texts that stay with one of two sets of words, which single counts cannot tell."""
    rng, lines = random.Random(5), []
    for i in range(600):
        lines.append((i, " ".join(rng.choice(("red", "blue", "green") if i % 2 else ("one", "two", "three")) for _ in range(rng.randint(10, 30)))))
    frame, total = spark.createDataFrame(lines, "doc_id long, text string"), []
    for passes in (0, 14):
        monkeypatch.setattr(hmm_lm, "PASSES", passes)
        total.append(hmm_lm.score(frame).where("held_out").agg(F.sum("score"), F.sum("base_score")).first())
    assert total[1][0] > total[0][0] + 10 and total[1][0] > total[1][1] + 10


def test_symbols_of_texts_reach_the_passes(spark):
    texts = ["b a b", None, "", "c xyz  b", "zzz"]
    key, _, _ = hmm_lm.tokens(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))
    model = hmm_lm.Model(key, *[np.zeros(3, np.int32)] * 2, 3, np.zeros(0), np.zeros(0), 0, 0, 0, *[np.zeros(0)] * 3)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [np.frombuffer(r.symbols, "<u2").tolist() for r in hmm_lm._symbol_rows(frame, model).collect()]
    kind = lambda w: 3 + int(hmm_lm.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0])
    end = 3 + hmm_lm.SUFFIXES
    assert got == [[1, 0, 1, end], [end], [end], [2, kind(b"xyz"), 1, end], [kind(b"zzz"), end]]


def test_forward_recursion_is_exact_and_sums_to_one():
    rng = np.random.default_rng(0)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    s = hmm_lm.STATES
    model = hmm_lm.Model(*[np.zeros(0)] * 3, 0, np.zeros(0), np.zeros(0), 0, 0, 0, norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((5, s)), 0))
    total = 0.0
    sequences = [(a, b, c) for a in range(5) for b in range(5) for c in range(5)]
    got = hmm_lm.log_likelihood(np.array([x for q in sequences for x in q] + [2]), np.array([3] * len(sequences) + [1]), model)
    for q, g in zip(sequences, got, strict=False):
        alpha = model.start * model.emit[q[0]]
        for x in q[1:]:
            alpha = (alpha @ model.move) * model.emit[x]
        assert math.isclose(10**g, alpha.sum(), rel_tol=1e-9)
        total += 10**g
    assert math.isclose(total, 1)
    first, moves, counts = hmm_lm.expected(np.array([0, 1, 2, 3, 4, 4]), np.array([4, 2]), model)
    assert math.isclose(first.sum(), 2, rel_tol=1e-5) and math.isclose(moves.sum(), 4, rel_tol=1e-5) and math.isclose(counts.sum(), 6, rel_tol=1e-5)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)).round(3)
    x[:900] = x[0]  # one vector holds a third of the rows
    rows = [(i, v.tolist(), "?") for i, v in enumerate(x)]
    rows += [(5000, None, "?"), (5100, [0.0] * 8, "?"), (5200, [float("nan")] * 8, "?"), (5300, [None] * 8, "?"), (5400, [1.0], "?"), (None, [1.0] * 8, "?"), (5500, [float("inf")] * 8, "?")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    out: dict[int, list] = {}
    for r in ann_forest.nearest(frame, k=10, every=100).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(out) == set(range(0, 3000, 100))
    recall = 0.0
    for q, found in out.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        true = np.lexsort((np.arange(len(x)), far))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(math.isclose(far[v], s, rel_tol=1e-12) for _, v, s in found) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        recall += len(set(true.tolist()) & {v for _, v, _ in found}) / 10 / len(out)
    assert recall >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])] + [(2, [2.0, 1.0])] * 3, "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann_forest.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann_forest.nearest(few.where("false")).count() == 0


def surface(rows: int, seed: int = 6) -> np.ndarray:
    """Vectors of 32 dimensions on a curved surface of 5."""
    rng = np.random.default_rng(seed)
    return np.tanh(rng.normal(size=(rows, 5)) @ rng.normal(size=(5, 64)) * 0.5) @ rng.normal(size=(64, 32))


def exact(x: np.ndarray, asked: np.ndarray, k: int = 10) -> list[np.ndarray]:
    out = []
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        out.append(np.lexsort((np.arange(len(x)), far))[:k])
    return out


@pytest.mark.parametrize("group", [ann_forest.GROUP, 60])
def test_forest_compares_few_rows_and_finds_most_neighbours(group):
    x = surface(20_000)
    forest = ann_forest.grow(x[::4], len(x))
    size = np.bincount(forest.leaf_of(x.astype(np.float32)).ravel(), minlength=forest.leaves)
    splits = np.where(size > group, np.minimum(ann_forest.CELLS, 2 * (size // group + 1)), 1)
    assert (splits.max() > 1) == (group == 60)
    probed, asked = np.arange(50, len(x), 200), np.arange(0, len(x), 100)
    enough = ann_forest.budget(forest, size, splits, x[probed], [x[t] for t in exact(x, probed)])
    cell = forest.cells(x.astype(np.float32), splits)
    assert group > 60 or np.unique(cell[:, 0], return_counts=True)[1].max() < size.max()
    recall, compared = [], []
    for q, true in zip(asked, exact(x, asked), strict=True):
        met = np.isin(cell, forest.search(x[q], size, splits, enough)[0]).any(axis=1)
        recall.append(met[true].mean())
        compared.append(met.mean())
    assert np.mean(recall) >= 0.9 and np.mean(compared) < 0.15


def test_nearest_splits_large_leaves(spark):
    x = surface(4000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found: dict[int, set[int]] = {}
    for r in ann_forest.nearest(frame, sample=1000, group=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 4000, 100)
    assert np.mean([len(found[q] & set(t.tolist())) / 10 for q, t in zip(asked.tolist(), exact(x, asked), strict=True)]) >= 0.9


def test_opening_order_of_the_shared_queue():
    """Leaves come by what the query owes on the way to them, whatever their tree, and none is left out."""
    x = surface(3000)
    forest = ann_forest.grow(x, len(x), trees=3)
    size = np.bincount(forest.leaf_of(x.astype(np.float32)).ravel(), minlength=forest.leaves)
    what, upto = forest.search(x[0], size, np.ones(forest.leaves, np.int64), float("inf"))
    assert sorted(what.tolist()) == list(range(forest.leaves)) and upto[-1] == 3 * len(x)
    assert set(forest.leaf_of(x[:1].astype(np.float32))[0].tolist()) <= set(what[:3].tolist())


def test_rows_of_one_id_enter_a_tile_once(spark):
    """An id that many rows bear brings one text for each of its nodes into a tile."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(1, " ".join(words))] * 300 + [(1, f"quite another text number {k} of this id") for k in range(50)] + [(2, near)]
    documents = spark.createDataFrame(rows, "id long, text string")
    nodes = ngram_jaccard._nodes(documents, 5).cache()
    sets = nodes.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    placed = ngram_jaccard.tiles(sets).join(sets.select("node", "id", "copies"), "node")
    met = ngram_jaccard._with_texts(placed, nodes, documents, 5).collect()
    assert len(met) == placed.count() and {r.text for r in met} >= {near, " ".join(words)}
    got = {r.n_links for r in ngram_jaccard.jaccard_classes(documents.withColumnRenamed("id", "doc_id")).where("doc_id = 2").collect()}
    assert got == {300}


def test_a_labelled_id_with_many_rows_trains_once(spark):
    documents = spark.createDataFrame([(i % 40, "good text here" if i % 2 else "bad words there") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.train(documents.dropDuplicates(), labels)
    assert np.allclose(quality.train(documents, labels), once)


def test_ids_of_other_types(spark, documents):
    few = documents.where("doc_id < 40").select(F.col("doc_id").cast("int").alias("doc_id"), "text")
    ids = sorted(r.doc_id for r in few.collect())
    for found in (token_counts.token_counts(few, BYTE), hmm_lm.score(few), suffix_dedup.repeats(few), bpe_codec.encode_decode(few, WORD), sharding.shard_rows(few, 4), ngram_jaccard.jaccard_classes(few), flac.media(few)):
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == ids
    assert {r.doc_id for r in packing.pack(few, WORD).collect()} == set(ids)


def test_distances_of_very_large_and_very_small_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e200, 2.0]), (2, [1e308, -1e308]), (3, [-1e308, 1e308]), (4, [1e-200, 0.0]), (5, [2e-200, 0.0])]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4).collect()
    want = {}
    for q, x in rows:
        if q % 4 == 0:
            near = sorted((math.hypot(*(a / 4 - b / 4 for a, b in zip(x, y, strict=True))) * 4, i) for i, y in rows if i != q)
            want |= {(q, k): (i, d) for k, (d, i) in enumerate(near, 1)}
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {k: i for k, (i, _) in want.items()}
    assert all(r.score == pytest.approx(want[r.query_id, r.rank][1], rel=1e-12) for r in got)
