"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

A sentence is read as symbols: letters without case, one for digits, three for bytes of other scripts, and one for each run of anything else. The kernel of two strings is the
sum, over all sequences of ORDER symbols that both hold in order, of DECAY to the power of the gaps in both places, where no place is longer than SPAN symbols; so strings with
characters left out, put in or spaced out stay similar; a gap between letters that stand alone is left out altogether. An instance is a window of WIDTH symbols and what a sequence that begins there may reach; windows do not cross the ends of sentences.
Windows have one length, so only landmarks are brought to unit length.

Landmarks are words: those that tell toxic sentences of the sample most, and frequent ones. Nystroem features are the kernels with the landmarks times the inverse root of the
landmarks' kernel matrix. A document's label holds for the sentence that the model finds worst in it (a clean document has clean sentences only), which is found anew each round, with the
first round by the words alone; a machine with squared hinge loss is fitted to these windows by Newton steps. Its decision is linear in the sequences that occur in landmarks, so all its
landmarks become one table of weights, in whole numbers, and the decision on any window is a sum of look-ups: exact, and the same in every chunk and task. The decision on a document's
worst window, how many of its windows are on the toxic side, and its length give its score by a logistic curve fitted on the sample.

The model is learned from about SAMPLE labelled documents that are not held out (all of them where they are fewer). Scores cover every whole text.

Defined results: null and empty texts have no sentence and get the curve's value at the machine's constant. A label that is null counts as absent, of several labels of a
document the highest holds, and of several texts of a labelled id the first in order trains; a null id hashes as the empty text; repeated rows each get their row; other
columns are ignored; with labels of one kind only, scores are one number; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import checkpoint
from papertide.llm.quality import held_out
from papertide.llm.spans import CHUNK, SEPARATES, groups_of, over_batches, ragged, release, utf8

ORDER, SPAN, WIDTH, DECAY = 4, 7, 12, 0.7
SAMPLE, ROUNDS, TELLING, FREQUENT, COST = 16_000, 3, 160, 32, 0.005
#: Letters are 1 to 26, digits 27, bytes of other scripts 28 to 30; 0 stands between sentences. A first byte of a character is left out.
GAP, LEFT_OUT, BITS = 31, 255, 5
KIND = np.full(256, GAP, np.uint8)
KIND[65:91] = KIND[97:123] = np.arange(1, 27)
KIND[48:58] = 27
KIND[128:192] = 28 + (np.arange(128, 192) & 31) % 3
KIND[192:] = LEFT_OUT
STOPS = np.zeros(256, bool)
STOPS[[33, 46, 63]] = True
#: Weights are multiples of 2^-FINE, powers of DECAY of 2^-8.
FINE, REACH = 12, WIDTH + SPAN - 1
UNIT = float(1 << (FINE + 8))
FADE = [round(256 * DECAY**k) for k in range(SPAN - ORDER + 1)]
STRETCH = 1 << 16


@dataclass
class Model:
    """weights: of each sequence; a window's decision is their sum plus `constant`, and a score the logistic curve of slopes * figures() + shift."""

    weights: np.ndarray
    constant: float = 0.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)
    shift: float = 0.0

    @property
    def level(self) -> int:
        """What a window's sum must exceed to be on the toxic side."""
        return round(-self.constant * UNIT)

    def figures(self, most: np.ndarray, hits: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each document: the decision on the worst window, and of the number of toxic windows and of all the logarithms."""
        return np.stack([most / UNIT + self.constant, np.log1p(hits / WIDTH), np.log1p(size / 100)], axis=1)

    def scores(self, *found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.figures(*found) @ np.array(self.slopes) + self.shift, -500, 500)))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: their symbols, WIDTH zeros between sentences; each sentence's first and last place in these, its document, and its first
    and last byte in that."""
    n, d = len(data), len(offsets) - 1
    full = np.full(n + d + 1, 10, np.uint8)
    own = np.repeat(np.arange(d), np.diff(offsets))
    full[np.arange(n) + own + 1] = data
    stop = (full == 10) | (STOPS[full] & np.append(SEPARATES[full[1:]], True))
    kind = KIND[full]
    at = np.flatnonzero(kind != LEFT_OUT)
    kind, stop = kind[at], stop[at]
    gap = kind == GAP
    first = np.flatnonzero(gap & ~np.concatenate([[False], gap[:-1]]))
    ends = first[np.logical_or.reduceat(stop, first)]
    stay = ~gap
    stay[first] = True
    place = np.cumsum(stay) - 1
    ends, at, kind = place[ends], at[stay], kind[stay]
    # Letters that stand alone are drawn together: "a b c" is read as "abc".
    gap = kind == GAP
    gap[ends] = False
    alone = np.zeros(len(kind), bool)
    alone[2:-2] = gap[2:-2] & (kind[:-4] == GAP) & (kind[4:] == GAP)
    place = np.cumsum(~alone) - 1
    ends, at, kind = place[ends], at[~alone], kind[~alone]
    times = np.ones(len(kind), np.int64)
    times[ends] = WIDTH + 2
    to = np.cumsum(times) - times
    out = np.repeat(kind, times)
    out[ragged(to[ends] + 1, np.full(len(ends), WIDTH))] = 0
    told = np.stack([at[ends[:-1] + 1], at[ends[1:]]], axis=1)
    doc = np.searchsorted(offsets + np.arange(d + 1), told[:, 0]) - 1
    told -= (doc + 1)[:, None] + offsets[doc][:, None]
    back = (data[np.minimum(told[:, 0] + offsets[doc], max(0, n - 1))] & 192) == 128 if n else np.zeros(0, bool)
    told[:, 0] -= back  # the first byte of that character was left out
    return out, np.stack([to[ends[:-1]] + WIDTH + 1, to[ends[1:]]], axis=1), doc, told


def look_ups(stream: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each way to choose ORDER symbols within SPAN: the gaps, and the sequences that begin at each of the first len(stream) - SPAN + 1 places."""
    n = len(stream) - SPAN + 1
    c = stream.astype(np.int32)
    pair = {k: c[: len(c) - k] << BITS | c[k:] for k in range(1, SPAN)}
    for last in range(ORDER - 1, SPAN):
        for a, b in itertools.combinations(range(1, last), 2):
            yield last - ORDER + 1, pair[a][:n] << (2 * BITS) | pair[last - b][b : b + n]


def decisions(stream: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights in the window that begins at each place, in units of 2^-(FINE + 8)."""
    given = np.zeros(len(stream) + WIDTH + 1, np.int64)
    padded = np.concatenate([stream, np.zeros(SPAN - 1, stream.dtype)])
    for lo in range(0, len(stream), STRETCH):
        part = padded[lo : lo + STRETCH + SPAN - 1]
        total, sums, before = np.zeros(len(part) - SPAN + 1, np.int64), None, -1
        for gaps, sequence in look_ups(part):
            if gaps != before:
                if sums is not None:
                    total += FADE[before] * sums
                sums, before = np.zeros(len(total), np.int64), gaps
            sums += weights.take(sequence)
        given[lo + 1 : lo + 1 + len(total)] = total + FADE[before] * sums
    running = np.cumsum(given)
    return running[WIDTH : WIDTH + len(stream)] - running[: len(stream)]


def worst_windows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the sum of its worst window (0 without a sentence), how many exceed the level, how many there are, the symbols of the worst, and the bytes
    of its sentence."""
    d = len(offsets) - 1
    most, hits, size, window, span = np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros((d, REACH), np.uint8), np.zeros((d, 2), np.int64)
    for lo, hi in groups_of(np.diff(offsets), CHUNK):
        stream, place, doc, told = symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(place):
            continue
        found = decisions(stream, weights)
        cuts = np.append(place.ravel(), len(found) - 1)
        best = np.maximum.reduceat(found, cuts)[: 2 * len(place) : 2]
        np.add.at(hits, lo + doc, np.add.reduceat((found > level).astype(np.int64), cuts)[: 2 * len(place) : 2])
        np.add.at(size, lo + doc, place[:, 1] - place[:, 0])
        order = np.lexsort((np.arange(len(doc)), -best, doc))
        pick = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        most[lo + doc[pick]], span[lo + doc[pick]] = best[pick], told[pick]
        for k in pick.tolist():
            a = place[k, 0] + int(found[place[k, 0] : place[k, 1]].argmax())
            x = stream[a : min(a + REACH, place[k, 1] + 1)]
            window[lo + doc[k], : len(x)] = x
    return most, hits, size, window, span


def sequences(word: bytes) -> dict[int, float]:
    """The kernel's features of a word that stands alone."""
    stream = symbols(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]
    stream, out = np.append(stream[WIDTH + 1 : len(stream) - WIDTH - 1], np.zeros(SPAN, np.uint8)), {}
    mask = (1 << BITS) - 1
    for gaps, found in look_ups(stream):
        for s in found.tolist():
            if all(s >> (BITS * k) & mask for k in range(ORDER)):
                out[s] = out.get(s, 0.0) + FADE[gaps] / 256
    return out


class Landmarks:
    """Words as unit vectors over the sequences that occur in them."""

    def __init__(self, words: list[str]) -> None:
        found = [(w, s) for w in words if (s := sequences(w.encode()))]
        self.words = [w for w, _ in found]
        self.sequences = np.unique(np.array([s for _, of in found for s in of], np.int64))
        self.unit = np.zeros((len(self.sequences), len(found)), np.float64)
        for k, (_, of) in enumerate(found):
            at = np.searchsorted(self.sequences, np.array(list(of)))
            self.unit[at, k] = np.array(list(of.values())) / np.sqrt(sum(v * v for v in of.values()))
        self.row = np.full(1 << (BITS * ORDER), -1, np.int32)
        self.row[self.sequences] = np.arange(len(self.sequences))
        value, vector = np.linalg.eigh(self.unit.T @ self.unit) if found else (np.zeros(0), np.zeros((0, 0)))
        good = value > 1e-6 * max(value.max(initial=0.0), 1e-300)
        self.root = vector[:, good] / np.sqrt(value[good])

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Nystroem features of windows (one in a row, REACH symbols)."""
        kernel = np.zeros((len(windows), self.unit.shape[1]))
        for lo in range(0, len(windows), 2048):
            part = windows[lo : lo + 2048]
            held = np.zeros((len(part), len(self.sequences)), np.float32)
            flat = np.concatenate([part, np.zeros((len(part), SPAN), np.uint8)], axis=1)
            for gaps, found in look_ups(np.append(flat.ravel(), np.zeros(SPAN - 1, np.uint8))):
                row = self.row[found.reshape(len(part), -1)[:, :WIDTH]]
                at = np.nonzero(row >= 0)
                np.add.at(held, (at[0], row[at]), FADE[gaps] / 256)
            kernel[lo : lo + 2048] = held @ self.unit
        return kernel @ self.root

    def weights(self, by_feature: np.ndarray) -> np.ndarray:
        """The table of weights of a machine that has these in feature space."""
        return self.table(self.unit @ (self.root @ by_feature))

    def table(self, by_sequence: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << (BITS * ORDER), np.int32)
        out[self.sequences] = np.round(np.clip(by_sequence, -128, 128) * (1 << FINE))
        return out


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and constant of the machine with squared hinge loss, both classes of the same weight, by Newton steps."""
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    sign, each = np.where(y, 1.0, -1.0), np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y) * cost
    keep = np.ones(x.shape[1])
    keep[-1] = 1e-3
    w, loss = np.zeros(x.shape[1]), lambda w: 0.5 * (keep * w * w).sum() + (each * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    for _ in range(60):
        short = 1 - sign * (x @ w)
        at = short > 0
        slope = keep * w - 2 * x[at].T @ (each[at] * sign[at] * short[at])
        if np.abs(slope).max() < 1e-8 * max(1.0, each.sum()):
            break
        step, size = np.linalg.solve(np.diag(keep) + 2 * (x[at] * each[at, None]).T @ x[at], slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of the logistic curve over the columns of x, its targets drawn in by one count of each class."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.append((x - middle) / spread, np.ones((len(x), 1)), axis=1), np.zeros(x.shape[1] + 1)
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    loss = lambda w: np.logaddexp(0, z @ w).sum() - target @ (z @ w) + 0.5 * keep @ (w * w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step, size = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - target) + keep * w), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return tuple(slopes.tolist()), float(w[-1] - slopes @ middle)


def _telling(sample: DataFrame, telling: int, frequent: int) -> list[tuple[str, float]]:
    """Words with how far they exceed their share of toxic documents, in units of its root: the most telling ones, and frequent ones that tell nothing."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))
    count = sample.select("toxic", word.alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where(F.length("word").between(2, 40))
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    due = F.col("n") * F.lit(float(share))
    count = count.withColumn("z", (F.col("toxic") - due) / F.sqrt(due + 1))
    found = count.where("z > 0").orderBy(F.desc("z"), "word").limit(telling).collect() + count.where("z <= 0").orderBy(F.desc("n"), "word").limit(frequent).collect()
    return [(r.word, r.z) for r in found]


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, folds: int = 3, fold: int = 1) -> Model:
    """The model learned from about `sample` of the labelled documents that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).dropna().where(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About `sample` rows of two numbers: bounded by the parameter, so they can be broadcast. The first text of an id is found before the shuffle.
    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    rows = checkpoint(rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    classes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nothing = np.zeros(1 << (BITS * ORDER), np.int32)
    if len(classes) < 2:
        return Model(nothing, shift=float(np.log((classes.get(1, 0) + 1) / (classes.get(0, 0) + 1))))
    words = _telling(rows, TELLING, FREQUENT)
    marks = Landmarks([w for w, _ in words])
    if not marks.words:
        return Model(nothing, shift=float(np.log((classes.get(1, 0) + 1) / (classes.get(0, 0) + 1))))
    z = dict(words)
    weights = marks.table(marks.unit @ np.maximum(0, [z[w] for w in marks.words]) / max(1e-9, max(z.values())))
    context, clean = documents.sparkSession.sparkContext, np.zeros((0, REACH), np.uint8)

    def worst(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, figures and window of each document of the sample."""
        shared = context.broadcast(model)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            for batch in batches:
                most, hits, size, window, _ = worst_windows(*utf8(batch.column(0)), shared.value.weights, shared.value.level)
                yield pa.table([batch.column(1), pa.array(most), pa.array(hits), pa.array(size), pa.array([w.tobytes() for w in window], pa.binary())], ["toxic", "most", "hits", "size", "window"])

        told = over_batches(rows, find, "toxic int, most long, hits long, size long, window binary").toArrow()
        window = np.frombuffer(b"".join(told["window"].to_pylist()), np.uint8).reshape(-1, REACH)
        toxic, *found = (told[c].to_numpy() for c in ("toxic", "most", "hits", "size"))
        order = np.lexsort((*window.T[::-1], *found, toxic))  # rows come in the order of tasks, and sums depend on their order
        return toxic[order] > 0, model.figures(*(f[order] for f in found)), window[order]

    model = Model(weights)
    for _ in range(ROUNDS):
        toxic, _, window = worst(model)
        clean = np.unique(np.concatenate([clean, window[~toxic]]), axis=0)
        x = marks.features(np.concatenate([window[toxic], clean]))
        by_feature, constant = machine(x, np.arange(len(x)) < toxic.sum())
        model = Model(marks.weights(by_feature), constant)
    toxic, figures, _ = worst(model)
    return Model(model.weights, model.constant, *curve(figures, toxic))


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of documents with `toxic_score`, `toxic_predicted` (1 from the threshold on) and `toxic_sentence`, the bytes from `start` to `end` of the worst sentence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, start long, end long")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            *found, _, span = worst_windows(*utf8(pa.array(part, pa.string())), shared.value.weights, shared.value.level)
            yield pd.DataFrame({"score": shared.value.scores(*found), "start": span[:, 0], "end": span[:, 1]})
        release()

    scored = documents.withColumn("toxic_sentence", scores(F.col(text)))
    scored = scored.withColumn("toxic_score", F.col("toxic_sentence.score")).withColumn("toxic_predicted", F.when(F.col("toxic_score") >= threshold, 1).otherwise(0))
    return scored.withColumn("toxic_sentence", F.struct("toxic_sentence.start", "toxic_sentence.end"))
