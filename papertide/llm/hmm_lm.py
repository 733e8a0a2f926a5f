"""A hidden Markov language model: Baum-Welch over all training documents, and exact sequence likelihood by the scaled forward recursion.

A token is a word (ASCII letters lowered, cut at the space and the control characters 9 to 13) or the end that closes each document. Latent states
emit symbols: each of the OWN most frequent words is one, each of SUFFIXES classes of word endings is one for the other words, and the end is one.
A word of a class has the probability (c + 1) / (C + T + 1) in its class, where c is its own count, C and T the tokens and types of the class, and
one further type stands for the words that training lacks. So probabilities sum to one, and the states' tables do not grow with the vocabulary.

Counts of all words, and expected counts of each Baum-Welch pass, are summed within tasks and then across partitions. Every pass and all counts cover
every training document; texts are turned into symbols once, which the passes read (2 bytes for each token). Counts of the HEAD most frequent
words are broadcast; counts of the others are joined, by word, to the documents' remaining words. Frequent words never meet in that join,
so that its groups are small whatever the skew.

Words are known by their 64-bit key (see `spans`), and documents' remaining words by a 64-bit hash of their text.

Defined results: a null or empty text is the end alone; a null id hashes as the empty text for the held-out rule; repeated rows each get their row and
each count in training; other columns are ignored; without training documents the tables are uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import checkpoint
from papertide.llm.quality import held_out
from papertide.llm.spans import LOWER, KeyTable, groups_of, keys, over_batches, utf8, words

STATES, OWN, SUFFIXES, HEAD = 8, 1 << 13, 1 << 10, 1 << 17
PASSES = 14
#: Tokens whose recursions run together (of scores and, with half the bytes, of passes), tokens that a task gathers to group sequences by length (of passes, with half the bytes, twice as many), tokens counted at
#: once, and entries that a task sums up before it passes them on.
TOGETHER, TOGETHER_PASS, GATHERED, AT_ONCE, SUMMED = 400_000, 1_000_000, 2_000_000, 1 << 17, 1_000_000
#: Characters of documents that are cut into words together: few enough that their arrays stay near the processor.
PIECE = 1 << 18


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and suffix classes of the words of texts laid end to end, and the number of words of each text."""
    low = LOWER[data]
    starts, ends, number = words(low, offsets)
    last = low[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, low[ends - 2], 0).astype(np.uint32)
    return keys(low, starts, ends), (((last * np.uint32(257) + before) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32) % SUFFIXES, number


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for lo, hi in groups_of(np.diff(offsets), PIECE):
        yield lo, hi, *tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their class and summed counts."""
    key, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, kind, n = key[order], kind[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], kind[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its key), kind (its suffix class) and n of the words of a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[tuple[np.ndarray, ...]] = []
        out = lambda p: pa.table([pa.array(p[0].view(np.int64)), pa.array(p[1]), pa.array(p[2])], ["word", "kind", "n"])
        for batch in batches:
            for _, _, key, kind, _ in _text_chunks(batch.column(0)):
                found, at, n = np.unique(key, return_index=True, return_counts=True)
                held.append((found, kind[at], n.astype(np.int64)))
                if sum(len(h[0]) for h in held) > SUMMED:
                    held = [_summed(held)]
                    if len(held[0][0]) > SUMMED // 2:
                        yield out(held.pop())
        if held:
            yield out(_summed(held))

    return over_batches(texts, count, "word long, kind int, n long").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Model:
    """What is broadcast: counts of the frequent words (the first `own` of them are symbols), class totals, and the states' tables."""

    key: np.ndarray
    kind: np.ndarray
    count: np.ndarray
    own: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int
    ends: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row for each symbol: words, classes, end

    @property
    def total(self) -> int:
        return self.tokens + self.types + 1

    def symbols(self, rows: np.ndarray, kind: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts with their end, and how many each has."""
        size = number + 1
        out = np.full(int(size.sum()), self.own + SUFFIXES, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(size) - 1] = False
        out[keep] = np.where((rows >= 0) & (rows < self.own), rows, self.own + kind)
        return out, size


def _by_time(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of sequences (the longest first; begin: where each starts) by step: those of all sequences that reach it; and how many do."""
    reach = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    sequence = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
    at = begin[sequence]
    at += np.repeat(np.arange(len(reach)), reach)
    return symbols[at].astype(np.intp), reach


def _alike(seen: list[np.ndarray], sizes: list[np.ndarray], together: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gathered sequences in groups of similar length, so that a step serves many: which they are, their symbols by step and how many reach each step."""
    symbols, size = np.concatenate(seen), np.concatenate(sizes)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    for lo, hi in groups_of(size[order], together):
        at = order[lo:hi]
        yield at, *_by_time(symbols, begin[at], size[at])


def log_likelihood(symbols: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """log10 of each sequence's probability, of sequences laid end to end."""
    out = np.empty(len(size))
    for at, seen, reach in _alike([symbols], [size], TOGETHER):
        out[at] = _log_likelihood(seen, reach, model)
    return out


def _log_likelihood(seen: np.ndarray, reach: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the probability of each sequence, the longest first: the forward recursion, scaled at each step."""
    emitted, scale, ones = np.take(model.emit, seen, axis=0), np.empty(len(seen)), np.ones((STATES, STATES))
    alpha, a = model.start, 0
    for t, n in enumerate(reach.tolist()):
        alpha = (alpha if not t else alpha[:n] @ model.move) * emitted[a : a + n]
        total = alpha @ ones  # of each row, beside each of its states
        alpha /= total
        scale[a : a + n] = total[:, 0]
        a += n
    np.log10(scale, out=scale)
    out, a = np.zeros(int(reach[0])), 0
    for n in reach.tolist():
        out[:n] += scale[a : a + n]
        a += n
    return out


def expected(symbols: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, of moves and of emissions, of sequences laid end to end."""
    parts = [_expected(seen, reach, model) for _, seen, reach in _alike([symbols], [size], TOGETHER_PASS)]
    return tuple(sum(x) for x in zip(*parts, strict=True))


def _expected(seen: np.ndarray, reach: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forward-backward pass. Steps write into arrays of all tokens, as many do little."""
    emitted = np.take(model.emit.astype(np.float32), seen, axis=0)
    state, move, ones = np.empty_like(emitted), model.move.astype(np.float32), np.ones((STATES, STATES), np.float32)
    now, later = np.empty((2, int(reach[0]), STATES), np.float32)
    before, a = None, 0
    for n in reach.tolist():
        here, alpha, total = emitted[a : a + n], state[a : a + n], now[:n]
        if before is None:
            np.multiply(model.start.astype(np.float32), here, out=alpha)
        else:
            np.matmul(before[:n], move, out=alpha)
            np.multiply(alpha, here, out=alpha)
        np.matmul(alpha, ones, out=total)  # of each row, beside each of its states
        np.divide(alpha, total, out=alpha)
        np.divide(here, total, out=here)
        before, a = alpha, a + n
    back, moves, m = np.ascontiguousarray(move.T), np.zeros((STATES, STATES)), 0
    for n in reach[::-1].tolist():
        begin = a - n
        if m:
            onward, alpha, beta = emitted[a : a + m], state[begin : begin + m], later[:m]
            np.multiply(onward, now[:m], out=onward)
            moves += alpha.T @ onward
            np.matmul(onward, back, out=beta)
            np.multiply(alpha, beta, out=alpha)
            now, later = later, now
        if n > m:
            now[m:n] = 1  # sequences that end here
        m, a = n, begin
    del emitted
    counts = np.zeros((len(model.emit), STATES))
    for lo in range(0, len(seen), AT_ONCE):
        part = seen[lo : lo + AT_ONCE]
        for s, weights in enumerate(np.ascontiguousarray(state[lo : lo + AT_ONCE].T, np.float64)):
            counts[:, s] += np.bincount(part, weights, len(counts))
    return state[: reach[0]].sum(axis=0, dtype=np.float64), moves * model.move, counts


def _symbol_rows(texts: DataFrame, model: Model) -> DataFrame:
    """The symbols of each text of a one-column table with its end: 16-bit unsigned, little-endian."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        m = shared.value
        table = KeyTable(m.key[: m.own])
        for batch in batches:
            for _, _, key, kind, number in _text_chunks(batch.column(0)):
                symbols, size = m.symbols(table.find(key), kind, number)
                offsets = np.concatenate([[0], np.cumsum(size)]) * 2
                packed = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(symbols.astype("<u2").tobytes())])
                yield pa.table([packed.cast(pa.binary())], ["symbols"])

    return over_batches(texts, work, "symbols binary")


def _pass(rows: DataFrame, model: Model) -> Model:
    """One Baum-Welch pass over _symbol_rows(). Tasks send a row for each symbol they met, and rows -1 and -2 - s for starts and moves."""
    none = np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast(Model(none, none, none, model.own, none, none, 0, 0, 0, model.start, model.move, model.emit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        m = shared.value
        first, moves, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(m.emit), STATES))
        seen, sizes = [], []

        def add() -> None:
            for _, found, reach in _alike(seen, sizes, TOGETHER_PASS) if seen else ():
                for total, part in zip((first, moves, counts), _expected(found, reach, m), strict=True):
                    total += part
            seen.clear()
            sizes.clear()

        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
            data, size = np.frombuffer(column.buffers()[2], "<u2", int(ends[-1])), np.diff(ends)
            for lo, hi in groups_of(size, 2 * GATHERED):
                seen.append(data[ends[lo] : ends[hi]])
                sizes.append(size[lo:hi])
                if sum(map(len, seen)) > 2 * GATHERED:
                    add()
        add()
        met = np.flatnonzero(counts.any(axis=1))
        rows = np.concatenate([first[None], moves, counts[met]])
        yield pa.table([pa.array(np.concatenate([[-1], -2 - np.arange(STATES), met]).astype(np.int32)), *(pa.array(rows[:, s]) for s in range(STATES))], ["symbol", *(f"s{s}" for s in range(STATES))])

    columns = [f"s{s}" for s in range(STATES)]
    sums = over_batches(rows, count, "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    symbol, values = sums["symbol"].to_numpy(), np.stack([sums[c].to_numpy() for c in columns], axis=1) if len(sums) else np.zeros((0, STATES))
    first, moves, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(model.emit), STATES))
    first[:] = values[symbol == -1].sum(axis=0)
    moves[-2 - symbol[symbol <= -2]] = values[symbol <= -2]
    counts[symbol[symbol >= 0]] = values[symbol >= 0]
    return _updated(model, first, moves, counts)


def _updated(model: Model, first: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> Model:
    base = counts.sum(axis=1) + 1
    counts = counts + 100 * (base / base.sum())[:, None]
    return Model(**(vars(model) | {"start": (first + 1) / (first + 1).sum(), "move": (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), "emit": counts / counts.sum(axis=0)}))


def train(documents: DataFrame, counts: DataFrame, doc_id: str, text: str, seed: int = 1) -> Model:
    """The model of the training documents. counts: their word_counts()."""
    n = documents.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    key, kind, count = head["word"].to_numpy().view(np.uint64), head["kind"].to_numpy(), head["n"].to_numpy()
    own = min(OWN, len(key))
    class_tokens, class_types = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        class_tokens[r.kind], class_types[r.kind] = r.n, r.types
    np.subtract.at(class_tokens, kind[:own], count[:own])
    np.subtract.at(class_types, kind[:own], 1)
    base = np.concatenate([count[:own], class_tokens, [n]]) + 1
    noise = np.random.default_rng(seed).random((len(base), STATES)) + 0.5
    emit = base[:, None] * noise
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = Model(key, kind, count, own, class_tokens, class_types, sums.n + n, sums.types + (n > 0), n, np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    if n:
        rows = checkpoint(_symbol_rows(documents.select(F.col(text).alias("text")), model))
        for _ in range(PASSES):
            model = _pass(rows, model)
    return model


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (this model) of each document, learned from those not held out."""
    spark = documents.sparkSession
    apart = held_out(F.col(doc_id), folds, fold)
    training = documents.where(~apart)
    counts = checkpoint(word_counts(training.select(F.col(text).alias("text"))))
    model = train(training, counts, doc_id, text)
    shared = spark.sparkContext.broadcast(model)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), apart.alias("held_out"), F.xxhash64(body).alias("text_key"), body.alias("text"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        m = shared.value
        table = KeyTable(m.key)
        base = np.log10((m.count + 1) / m.total)
        inside = np.where(np.arange(len(m.key)) < m.own, 0, np.log10((m.count + 1) / (m.class_tokens + m.class_types + 1)[m.kind]))
        seen, sizes, rows_held = [], [], []

        def finished() -> Iterator[pa.Table]:
            if seen:
                exact = np.empty(sum(map(len, sizes)))
                for at, found, reach in _alike(seen, sizes, TOGETHER):
                    exact[at] = _log_likelihood(found, reach, m)
                out = pa.concat_tables(rows_held)
                model_score = exact + out["model"].to_numpy()
                yield out.set_column(out.num_columns - 1, "model", pa.array(model_score))
            for held in (seen, sizes, rows_held):
                held.clear()

        for batch in batches:
            for lo, hi, key, kind, number in _text_chunks(batch.column(3)):
                found = table.find(key)
                known = found >= 0
                symbols, size = m.symbols(found, kind, number)
                owner = np.repeat(np.arange(hi - lo), number)[known]
                add = lambda v: np.bincount(owner, v[found[known]], hi - lo)  # noqa: B023, E731
                seen.append(symbols)
                sizes.append(size)
                rows_held.append(
                    pa.table(
                        [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size), pa.array(np.bincount(owner, minlength=hi - lo) + (m.ends > 0)), pa.array(add(base) + np.log10((m.ends + 1) / m.total)), pa.array(add(inside))],
                        ["doc_id", "held_out", "text_key", "n_tokens", "known", "base", "model"],
                    )
                )
                if sum(map(len, seen)) > GATHERED:
                    yield from finished()
        yield from finished()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = KeyTable(shared.value.key)
        for batch in batches:
            text_key = batch.column(0).to_numpy()
            for lo, _, key, kind, number in _text_chunks(batch.column(1)):
                left = np.flatnonzero(table.find(key) < 0)
                owner, key, kind = np.repeat(np.arange(len(number)), number)[left], key[left], kind[left]
                order = np.lexsort((key, owner))
                owner, key, kind = owner[order], key[order], kind[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.zeros(0, np.int64)
                yield pa.table([pa.array(text_key[lo + owner[first]]), pa.array(key[first].view(np.int64)), pa.array(kind[first]), pa.array(np.diff(np.append(first, len(key))).astype(np.int32))], ["text_key", "word", "kind", "times"])

    scored = over_batches(rows, head, "doc_id long, held_out boolean, text_key long, n_tokens long, known long, base double, model double")
    # SUFFIXES rows: a fixed size.
    classes = F.broadcast(spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.class_tokens + model.class_types + 1)], "kind int, class_total double"))
    remaining = over_batches(rows.select("text_key", "text"), rest, "text_key long, word long, kind int, times int")
    met = remaining.join(counts.select("word", "n"), "word", "left").join(classes, "kind")
    c = F.coalesce(F.col("n"), F.lit(0)) + 1
    sums = met.groupBy("text_key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10(c / F.lit(float(model.total)))).alias("rest_base"),
        F.sum(F.col("times") * F.log10(c / F.col("class_total"))).alias("rest_model"),
    )
    # Rows of equal texts sent the same words, so their sums are that many times one row's.
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies"))
    each = sums.join(copies, "text_key").select("text_key", *((F.col(x) / F.col("copies")).alias(x) for x in ("rest_known", "rest_base", "rest_model")))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return scored.join(each, "text_key", "left").select(
        "doc_id", "held_out", "n_tokens", F.round(plus("known", "rest_known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base", "rest_base").alias("base_score"), plus("model", "rest_model").alias("score")
    )
