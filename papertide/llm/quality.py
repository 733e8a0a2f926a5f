"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (proximal) updates.

Features of a text are its words and pairs of neighbouring words, each as spelled (lower-cased) and as shaped (letters by case, digits and
signs, runs of letters or digits drawn together, a repeated word marked as such), hashed into 2^BITS places and weighted by the root of their
count, to unit length. A score is the sparse dot product with the weights.

Training takes a bounded sample of the labelled rows: about SAMPLE of them, dealt into SHARES groups by a hash; each group trains its own weights
and the driver averages SHARES vectors. Scores cover every whole text.

Defined results: a null or empty text has no features, so that its score is that of the intercept; a label row that is null counts as absent,
of several labels of a document the highest holds, and of several texts of a labelled id the first in order trains; a null id hashes as the empty text; repeated rows each get their row; other columns are
ignored; without labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.spans import CHUNK, LOWER, groups_of, keys, mix, release, utf8, words

BITS, SAMPLE, SHARES, EPOCHS = 18, 16_000, 8, 3
#: Of the updates: step, its smoothing, and the weight of the squares.
ALPHA, BETA, L2 = 2.0, 1.0, 1e-3
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97
DRAWN = np.zeros(256, bool)
DRAWN[[65, 97, 48]] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and bounds by document of texts laid end to end."""
    low, shape = LOWER[data], SHAPE[data]
    starts, ends, number = words(low, offsets)
    spelled = keys(low, starts, ends)
    keep = np.ones(len(shape), bool)
    keep[1:] = ~(DRAWN[shape[1:]] & (shape[1:] == shape[:-1]))
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shaped = keys(shape[keep], at[starts], at[ends])
    owner = np.repeat(np.arange(len(number)), number)
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    shaped[second[spelled[second] == spelled[second - 1]]] = np.uint64(1)
    hashed = [spelled, shaped, mix(spelled[second - 1] * np.uint64(3) + spelled[second]), mix(shaped[second - 1] * np.uint64(5) + shaped[second])]
    place = np.concatenate([(h >> np.uint64(64 - bits)).astype(np.int64) for h in hashed])
    found, count = np.unique(np.concatenate([owner, owner, owner[second], owner[second]]) << bits | place, return_counts=True)
    of = found >> bits
    value = np.sqrt(count / np.maximum(np.bincount(of, count, len(number)), 1)[of])
    return (found & ((1 << bits) - 1)).astype(np.int32), value.astype(np.float32), np.searchsorted(of, np.arange(len(number) + 1))


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """features() for runs of documents of bounded size together."""
    for lo, hi in groups_of(np.diff(offsets), CHUNK):
        yield features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def trained(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, and the intercept last, after the updates for these (places, values, label) in their order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    weigh = lambda z, n: -z / ((BETA + np.sqrt(n)) / ALPHA + L2)
    for _ in range(epochs):
        for place, value, label in examples:
            place, value = np.append(place, 1 << bits), np.append(value, np.float32(1))
            zz, nn = z[place], n[place]
            w = weigh(zz, nn)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[place] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * w
            n[place] = nn + g * g
    return weigh(z, n)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights learned from about `sample` of the labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.withColumn("order", F.xxhash64("id")).where(F.pmod(F.col("order"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About `sample` rows of three numbers: bounded by the parameter, so they can be broadcast.
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    # An id's rows become one before they are shuffled, so that a group holds a share of the sample however often an id occurs.
    rows = rows.groupBy("id", "label", "order").agg(F.min("text").alias("text")).withColumn("share", F.pmod(F.shiftright("order", 32), F.lit(SHARES)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id"], kind="stable")
        examples, at = [], 0
        for place, value, bound in chunks(*utf8(pa.array(group["text"], pa.string()))):
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                examples.append((place[a:b], value[a:b], int(group["label"].iloc[at])))
                at += 1
        weights = trained(examples, bits).astype("<f4").tobytes()
        examples.clear()
        release()
        return pd.DataFrame({"n": [len(group)], "weights": [weights]})

    parts = rows.groupBy("share").applyInPandas(fit, "n long, weights binary").collect()
    total = sum(p.n for p in parts)
    return sum((np.frombuffer(p.weights, "<f4") * (p.n / total) for p in parts), np.zeros((1 << bits) + 1, np.float32))


def score(documents: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of documents with a score in `quality_score` and, in `quality_predicted`, whether it reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for part in parts:
            out = [np.zeros(0)]
            for place, value, bound in chunks(*utf8(pa.array(part, pa.string()))):
                total = np.concatenate([[0.0], np.cumsum(w[place] * value)])
                out.append(1 / (1 + np.exp(-(total[bound[1:]] - total[bound[:-1]] + w[-1]))))
            yield pd.Series(np.concatenate(out))
        release()

    scored = documents.withColumn("quality_score", scores(F.col(text)))
    return scored.withColumn("quality_predicted", F.when(F.col("quality_score") >= threshold, 1).otherwise(0))
