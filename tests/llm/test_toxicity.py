"""The string kernel against its definition, the table of weights against kernels with landmarks, and the classifier on odd rows and held-out documents."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papertide.llm import registry, toxicity
from papertide.llm.spans import utf8

FOLDER = "/root/testdata/sf0.1"
CLASHING = "score string, toxic string, id string, word string, start string"


def letters(text: str) -> str:
    return "_" + re.sub(r"[^a-z]+", "_", text.lower()) + "_"


def kernel(window: str, word: str) -> float:
    """By definition: all common sequences at all places, those of the window beginning in its first WIDTH characters."""

    def held(text: str, begins: int) -> dict[str, float]:
        out: dict[str, float] = {}
        for a in range(min(begins, len(text))):
            for rest in itertools.combinations(range(a + 1, min(len(text), a + toxicity.SPAN)), toxicity.ORDER - 1):
                key = text[a] + "".join(text[k] for k in rest)
                out[key] = out.get(key, 0) + toxicity.FADE[rest[-1] - a + 1 - toxicity.ORDER] / 256
        return out

    x, z = held(window, toxicity.WIDTH), held(word, 99)
    return sum(v * z.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in z.values()))


def test_kernel_follows_its_definition():
    words, text = ["idiot", "worthless", "the"], "you are an idxiot w o r thless the"
    marks = toxicity.Landmarks(words)
    stream, place, _, _ = toxicity.symbols(*utf8(pa.array([text])))
    line = letters(text.replace("w o r", "wor"))
    a, b = place[0]
    assert b - a + 1 == len(line)
    windows = np.array([np.append(stream[k : min(k + toxicity.REACH, b + 1)], np.zeros(max(0, toxicity.REACH - (b + 1 - k)), np.uint8)) for k in range(a, b)])
    got = marks.features(windows)
    root = np.linalg.pinv(np.linalg.cholesky(marks.unit.T @ marks.unit)).T
    want = np.array([[kernel(line[k : k + toxicity.REACH], "_" + w + "_") for w in words] for k in range(b - a)]) @ root
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-4)


def test_decisions_are_the_machine_over_landmarks():
    rng = random.Random(3)
    marks = toxicity.Landmarks(["moron", "scum", "and", "éclat"])
    by_feature = np.array([rng.uniform(-1, 1) for _ in range(marks.root.shape[1])])
    table = marks.weights(by_feature)
    texts = ["", "A moron. And scum! Éclat?", "m o r o n", " ".join(rng.choices(["moron", "sc-um", "and", "the", "x", "1"], k=400))]
    stream, place, _, _ = toxicity.symbols(*utf8(pa.array(texts)))
    found = toxicity.decisions(stream, table) / toxicity.UNIT
    for a, b in place.tolist():
        for k in range(a, b, 5):
            window = np.append(stream[k : min(k + toxicity.REACH, b + 1)], np.zeros(max(0, toxicity.REACH - (b + 1 - k)), np.uint8))
            assert abs(marks.features(window[None])[0] @ by_feature - found[k]) < 0.02


def test_sentences_and_their_bytes():
    texts = ["One. Zwei!\nÉtude trois", "", "  ...  ", "i.d.i.o.t", "中文 and。more"]
    _, place, doc, told = toxicity.symbols(*utf8(pa.array(texts)))
    cut = [(d, texts[d].encode()[a:b].decode()) for d, (a, b) in zip(doc.tolist(), told.tolist(), strict=True)]
    assert cut == [(0, "One"), (0, "Zwei"), (0, "Étude trois"), (3, "i.d.i.o.t"), (4, "中文 and。more")]
    assert all(b > a for a, b in place)


def test_results_do_not_depend_on_neighbours(monkeypatch):
    rng = random.Random(5)
    marks = toxicity.Landmarks(["idiot", "trash"])
    table = marks.weights(np.ones(marks.root.shape[1]))
    texts = [" ".join(rng.choices(["idiot", "trash", "tr", "ash.", "no", "é", "\n"], k=rng.randint(0, 60))) for _ in range(40)]
    whole = toxicity.worst_windows(*utf8(pa.array(texts)), table, 3)
    for name, size in (("CHUNK", 50), ("STRETCH", 64)):
        monkeypatch.setattr(toxicity, name, size)
        for got, want in zip(toxicity.worst_windows(*utf8(pa.array(texts)), table, 3), whole, strict=True):
            assert (got == want).all()


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_odd_rows(spark, model):
    texts = [None, "", " \n ", "You idiot.", "YOU IDIOT.", "you are an i d i o t", "an id-iot and a lo.ser", "no worry", "z" * 70000, "idiot " * 9000, "you idiot."]
    frame = spark.createDataFrame([(i, t, *["?"] * 5) for i, t in enumerate(texts)] + [(3, texts[3], *["?"] * 5), (None, texts[3], *["?"] * 5)], f"doc_id int, text string, {CLASHING}").repartition(3)
    got = [(r.doc_id, r.toxic_score, r.toxic_predicted, r.toxic_sentence) for r in toxicity.score(frame, model).collect()]
    score = {i: s for i, s, *_ in got}
    assert len(got) == 13 and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p, _ in got)
    assert score[0] == score[1] == score[2] and score[3] == score[4] == score[None] == score[10]
    assert all(score[i] >= 0.7 for i in (3, 4, 5, 6, 9)) and all(score[i] < 0.7 for i in (0, 7, 8))
    assert {tuple(t) for i, _, _, t in got if i == 3} == {(0, 9)}
    assert toxicity.score(frame.where("false"), model).count() == 0


def test_labels_of_one_kind_and_repeated_labels(spark):
    documents = spark.createDataFrame([(i, f"word{i} and more") for i in range(30)], "doc_id int, text string")
    for labels in ([], [(i, 0) for i in range(30)], [(i, 1) for i in range(30)], [(1, None), (None, 1)]):
        found = toxicity.train(documents, spark.createDataFrame(labels, "doc_id int, toxic int"))
        assert len({r.toxic_score for r in toxicity.score(documents, found).collect()}) == 1
    # A hot id is one training document; empty texts have no words.
    many = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(8, None)], "doc_id int, text string")
    toxicity.train(many, spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id int, toxic int"))


def test_held_out_documents(spark):
    rows = registry.op12_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    # About a tenth of the toxic labels of this table stand at documents without any insult.
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic) and sum(r.predicted for r in clean) < 0.005 * len(clean)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    whole = registry.op12_toxicity(spark, FOLDER)
    assert whole.count() == 10_000 and whole.where(F.col("held_out") != held).count() == 0 and whole.where("predicted <> int(score >= 0.7)").count() == 0
