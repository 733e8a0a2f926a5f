"""The corpus pipeline: each stage against brute force on the table of odd rows, and the whole run against its stages."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import CLASHING, brute_classes, brute_repeats, texts
from tokenizers import Tokenizer

import corpus_pipeline
from papertide.llm import quality
from papertide.llm.spans import utf8

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = f"doc_id long, text string, n_chars int, {CLASHING}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), *["?"] * 10) for i, t in rows], SCHEMA).repartition(3)


def kept(out):
    return Counter((r.doc_id, r.text) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The odd rows with labelled ones beside them, good and junk, as a folder of tables."""
    path = str(tmp_path_factory.mktemp("sf"))
    good, junk = ["calm prose about trees and rivers", "rivers run down to the sea"], ["BUY!! NOW!! NOW!! 99%", "### win %%% win ###"]
    more = [(1000 + i, (good if i % 2 else junk)[i // 2 % 2] + f" {i}") for i in range(200)]
    frame(spark, rows + more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_junk_goes_and_prose_stays(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["quality classifier"](spark, docs, folder)
    assert out.columns == docs.columns
    weights = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def passes(text):
        (place, value, _), = quality.chunks(*utf8(pa.array([text or ""], pa.string()))) if text else [(np.zeros(0, int), np.zeros(0), 0)]
        return 1 / (1 + np.exp(-(weights[place] @ value + weights[-1]))) >= 0.3

    every = docs.select("doc_id", "text").collect()
    assert kept(out) == Counter((r.doc_id, r.text) for r in every if passes(r.text))
    stay = {r.doc_id for r in out.where("doc_id >= 1000").collect()}
    assert stay == {1000 + i for i in range(200) if i % 2}


def test_one_of_each_group_of_near_copies_stays(spark, rows):
    out = STAGE["n-gram Jaccard join"](spark, frame(spark, rows), "")
    group = {i: c for i, c, _ in brute_classes(rows)}
    assert kept(out) == Counter((i, t) for i, t in rows if i is None or group[i] == i)
    assert out.columns == frame(spark, rows).columns


def test_repeated_passages_are_cut(spark, rows):
    out = STAGE["suffix-array dedup"](spark, frame(spark, rows), "")
    want = Counter()
    for i, t in rows:
        (found,) = brute_of(i, t, rows)
        want[(i, None if t is None else found.decode("utf-8", "ignore"))] += 1
    assert kept(out) == want
    assert out.columns == frame(spark, rows).columns and dict(out.dtypes) == dict(frame(spark, rows).dtypes)
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())


def brute_of(doc_id, text, rows):
    """What brute force keeps of one document's bytes."""
    size = len((text or "").encode())
    return {b for i, n, _, b in cut_once(rows) if i == doc_id and n == size and is_part(b, (text or "").encode())}


def is_part(some: bytes, whole: bytes) -> bool:
    it = iter(whole)
    return all(c in it for c in some)


_cut: dict[int, Counter] = {}


def cut_once(rows):
    return _cut.setdefault(id(rows), brute_repeats(rows))


def test_packing_takes_all_documents(spark, rows):
    out = STAGE["best-fit packing"](spark, frame(spark, rows), "").collect()
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            want[(i, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, rows, folder, stage):
    assert STAGE[stage](spark, frame(spark, rows).where("false"), folder).count() == 0


def test_run_is_its_stages_one_after_the_other(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    count = lambda f: Counter(tuple(r) for r in f.select(*columns).collect())
    assert count(corpus_pipeline.run(spark, folder)) == count(docs)
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert not ids & {1000 + i for i in range(0, 200, 2)} and docs.where(F.col("length") < 1).count() == 0
