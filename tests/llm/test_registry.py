"""The registered queries' own digest columns, on the smallest tables, against the libraries and plain arithmetic."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from papertide.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in registry.op1_token_counts(spark, FOLDER).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_codec(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = registry.op5_bpe_codec(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_repeats(spark, texts):
    """Bytes covered by a 50-byte string that also starts in an earlier document, and what is left of them."""
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        data = texts[i].encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for r in registry.op3_suffix_dedup(spark, FOLDER).collect():
        data = texts[r.doc_id].encode()
        cover = np.zeros(len(data) + 1, np.int64)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < r.doc_id:
                cover[k] += 1
                cover[k + 50] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_media(spark, texts):
    for r in registry.op8_flac(spark, FOLDER).collect():
        data = texts[r.doc_id].encode()
        payload = data + b" " * ((-len(data)) % 192 or (192 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64


def test_sharding(spark, texts):
    rows = registry.op6_sharding(spark, FOLDER).collect()
    assert len(rows) == len(texts) and len({r.law for r in rows}) == 1
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    shards: dict[int, list[int]] = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_packing(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    bins: dict[int, list[tuple[int, int]]] = {}
    seen = 0
    for r in registry.op10_packing(spark, FOLDER).collect():
        assert (r.start, r.length) == (4096 * r.piece, min(4096, len(ids[r.doc_id]) - 4096 * r.piece))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen += r.length
    assert seen == sum(map(len, ids.values()))
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces[:-1], pieces[1:], strict=True)) and sum(pieces[-1]) <= 4096


def test_held_out_and_predictions(spark, texts):
    scored = registry.op2_hmm_score(spark, FOLDER).collect()
    assert len(scored) == len(texts) and all(r.held_out == (remainder(r.doc_id, 7) == 2) and r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in scored)
    for query, n, k, threshold in ((registry.op4_quality, 5, 0, 0.3), (registry.op12_toxicity, 3, 1, 0.7)):
        rows = query(spark, FOLDER).collect()
        assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == (remainder(r.doc_id, n) == k) and r.predicted == (r.score >= threshold) and 0 <= r.score <= 1 for r in rows)


def test_nearest(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r.embedding is not None}
    rows, hit = registry.op9_ann_forest(spark, FOLDER).collect(), 0
    names = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in names])
    for q in [i for i in names.tolist() if i % 100 == 0]:
        far = np.sqrt(np.square(matrix - vectors[q]).sum(axis=1))
        near = [i for i in names[np.lexsort((names, far))].tolist() if i != q][:10]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - np.sqrt(np.square(vectors[q] - vectors[r.vec_id]).sum())) < 1e-12 for r in own)
        hit += len({r.vec_id for r in own} & set(near))
    assert hit >= 0.9 * len(rows)
