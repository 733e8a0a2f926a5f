"""Ranked lexical search: document-at-a-time merges over compressed postings of shards, and one merge of their best.

A shard is a run of documents of one task, of at most SHARD documents or TEXT bytes. Its documents are numbered by ascending id; for each term, the numbers of the documents
that hold it (differences) and how often they do are kept as variable-length bytes, and one further row of the shard has the ids and lengths. Texts are never shuffled:
a shard is made where its texts are read, and only its postings of asked terms move. Whether a term is asked is looked up in a broadcast table of the asked terms' keys where these
are ASKED at most; where they are more, all postings are made and meet the asked terms in a join.

Queries come in blocks of BLOCK items, so that a group, of one shard and one block, is bounded on both sides. For each item, a heap of cursors, one for each posting list, hands
out documents in ascending order; a bounded heap, keyed by score and then by document, keeps the best. Lists whose greatest scores together cannot lift a document over the
worst kept one are not in the first heap; they are only asked about documents that the others hand out (so results stay exact). The best of all shards meet in a window of
each item, whose rows Spark limits before they are shuffled.

Terms are the maximal runs of digits, letters and non-ASCII characters of the whole text, only A-Z lower-cased. In a shard, terms are told apart by 64-bit keys and their sizes.

Defined results: null texts have no terms, and neither documents nor items without terms are found or find anything. Documents with a null id come after all others at equal scores.
Repeated rows of documents are documents of their own (those with the same id and score take neighbouring ranks). Items that are the same in id and text are one item; those
that differ in text are ranked apart. Very long texts are cut into terms a stretch at a time. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.runtime import checkpoint
from papertide.llm.spans import CHUNK, LOWER, keys, over_batches, ragged, utf8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD, TEXT, BLOCK = 1 << 15, 1 << 26, 1024
#: So many asked terms are broadcast (8 bytes each) at most.
ASKED = 1 << 20
#: Documents of the shortest lists, whose scores give a first bound.
SEEDS = 128
IN_TERM = np.zeros(256, bool)
IN_TERM[48:58] = IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True


def terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in bytes."""
    edge = np.diff(np.concatenate([[False], IN_TERM[data], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes of seven bits, the lowest first; the eighth bit says that more follow."""
    n = numbers.astype(np.uint64)
    size = np.ones(len(n), np.int64)
    for k in range(1, 10):
        size += n >= np.uint64(1 << (7 * k)) if 7 * k < 64 else 0
    own = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    part = (n[own] >> (place.astype(np.uint64) * np.uint64(7))) & np.uint64(127)
    return (part.astype(np.uint8) | np.where(place < size[own] - 1, 128, 0).astype(np.uint8)).tobytes()


def unpacked(told: bytes) -> np.ndarray:
    data = np.frombuffer(told, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


class Shard:
    """Gathers documents and gives their postings: for each term its key, a place where it stands, and its documents and counts."""

    def __init__(self, asked: np.ndarray | None) -> None:
        self.asked = asked
        self.ids, self.sizes, self.parts, self.names, self.bytes = [], [], [], {}, 0

    def add(self, ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose texts lie end to end."""
        lengths = np.zeros(len(ids), np.int64)
        for lo, hi in _stretches(data, offsets):
            low = LOWER[data[lo:hi]]
            # The end of a document ends a term also where the next one goes on with a letter.
            starts, ends = terms(low)
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            starts, ends = _cut(starts, ends, np.unique(inner))
            doc = np.searchsorted(offsets, starts + lo, side="right") - 1
            lengths += np.bincount(doc, minlength=len(ids))
            key = keys(low, starts, ends)
            if self.asked is not None:
                at = np.searchsorted(self.asked, key)
                hit = np.flatnonzero(self.asked[np.minimum(at, len(self.asked) - 1)] == key) if len(self.asked) else np.zeros(0, np.int64)
                starts, ends, doc, key = starts[hit], ends[hit], doc[hit], key[hit]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
            self.parts.append((key[new], (doc[new] + len(self.ids)).astype(np.int32), np.diff(np.append(new, len(key))).astype(np.int32)))
            for k in new[np.concatenate([[True], np.diff(key[new]) != 0])].tolist() if len(new) else []:
                name = int(key[k])
                if name not in self.names:
                    self.names[name] = low[starts[order[k]] : ends[order[k]]].tobytes().decode()
        self.ids += ids
        self.sizes += lengths.tolist()
        self.bytes += len(data)

    def rows(self, number: int) -> pa.Table:
        """The shard's rows: (shard, term, df, docs, counts), and for the empty term the ids, the lengths, and in df the number of documents."""
        order = sorted((k for k in range(len(self.ids)) if self.sizes[k]), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        rank = np.full(len(self.ids), -1, np.int64)
        rank[order] = np.arange(len(order))
        key, doc, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        by = np.lexsort((rank[doc] if len(doc) else doc, key))
        key, doc, count = key[by], rank[doc[by]] if len(doc) else doc, count[by].astype(np.int64)
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]) if len(key) else np.zeros(0, bool)  # a long text came in stretches
        first = np.flatnonzero(~same)
        count = np.add.reduceat(count, first) if len(first) else count
        key, doc = key[first], doc[first]
        bound = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
        step = np.diff(doc, prepend=0)
        step[bound[:-1]] = doc[bound[:-1]]
        lists = [(self.names[int(key[a])], b - a, packed(step[a:b]), packed(count[a:b] - 1)) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        ids = np.array([self.ids[k] if self.ids[k] is not None else (1 << 63) - 1 for k in order], np.int64)
        known = sum(self.ids[k] is not None for k in order)
        lists.append(("", len(order), ids[:known].tobytes(), packed(np.array([self.sizes[k] for k in order], np.int64))))
        names, df, docs, counts = zip(*lists, strict=True)
        return pa.table([pa.array([number] * len(lists)), pa.array(names, pa.string()), pa.array(df, pa.int64()), pa.array(docs, pa.binary()), pa.array(counts, pa.binary())], ["shard", "term", "df", "docs", "counts"])


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end where no term goes on."""
    lo = 0
    while lo < len(data):
        hi = min(lo + CHUNK, len(data))
        if hi < len(data):
            gap = np.flatnonzero(~IN_TERM[data[lo:hi]])
            bound = offsets[np.searchsorted(offsets, hi, side="right") - 1]
            if len(gap) or bound > lo:
                hi = max(lo + int(gap[-1]) + 1 if len(gap) else 0, int(bound))
            else:  # one term without end: to where it ends
                more = np.flatnonzero(~IN_TERM[data[hi:]])
                hi = min(hi + int(more[0]) if len(more) else len(data), int(offsets[np.searchsorted(offsets, hi, side="right")]))
        yield lo, hi
        lo = hi


def _cut(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the spans that have one of the places inside."""
    inside = at[(np.searchsorted(starts, at, side="left") - np.searchsorted(ends, at, side="right")) > 0]
    if not len(inside):
        return starts, ends
    return np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))


def postings(documents: DataFrame, asked: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The compressed postings of all shards, of all terms or of those with an asked key (ascending)."""
    shared = documents.sparkSession.sparkContext.broadcast(asked)  # at most ASKED keys

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        shard, number = Shard(shared.value), 0
        for batch in batches:
            task, ids = batch.column(2), batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), lo + max(1, SHARD - len(shard.ids)))
                hi = max(lo + 1, min(hi, int(np.searchsorted(offsets, offsets[lo] + max(0, TEXT - shard.bytes), side="right")) - 1))
                shard.add(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(shard.ids) >= SHARD or shard.bytes >= TEXT:
                    yield shard.rows((task[0].as_py() << 32) + number)
                    shard, number = Shard(shared.value), number + 1
                lo = hi
        if shard.ids:
            yield shard.rows((task[0].as_py() << 32) + number)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("task"))
    return over_batches(rows, index, "shard long, term string, df long, docs binary, counts binary")


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """item (a number), block, item_id, term and how often the item has it; and the number of blocks."""
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = checkpoint(items.select(F.col(item_id).alias("item_id"), low.alias("text")).where("text is not null").distinct().withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-found.count() // BLOCK))
    each = found.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return checkpoint(each.groupBy("block", "item", "item_id", "term").agg(F.count("*").alias("times"))), blocks


def _impacts(docs: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])


def best(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k documents with the highest scores above 0 as (score, document), best first, equal scores by document.

    lists: of each term the greatest score that it gives, the documents in ascending order and the score that it gives each.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0])
    under = [0]
    for most, _, _ in lists:
        under.append(under[-1] + most)
    # A document must have more than `low`; the first `idle` lists cannot give that alone, so they hand out no documents.
    low = idle = 0
    some = list(dict.fromkeys(doc for _, docs, _ in sorted(lists, key=lambda x: len(x[1]))[:SEEDS] for doc in docs[:SEEDS]))[:SEEDS]
    if len(some) >= k:
        sums = []
        for doc in some:
            score = 0
            for _, docs, gives in lists:
                at = bisect_left(docs, doc)
                if at < len(docs) and docs[at] == doc:
                    score += gives[at]
            sums.append(score)
        low = heapq.nlargest(k, sums)[-1] - 1
    while idle < len(lists) and under[idle + 1] <= low:
        idle += 1
    kept: list[tuple[int, int]] = []  # a heap with the worst first: score, and the document negated
    after = [0] * len(lists)
    heap = [(lists[i][1][0], i) for i in range(idle, len(lists))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            if i < idle:
                heapq.heappop(heap)
                continue
            _, docs, gives = lists[i]
            at = after[i]
            score += gives[at]
            after[i] = at + 1
            if at + 1 < len(docs):
                heapq.heapreplace(heap, (docs[at + 1], i))
            else:
                heapq.heappop(heap)
        if not score:
            continue
        for i in range(idle - 1, -1, -1):
            if score + under[i + 1] <= low:
                break
            _, docs, gives = lists[i]
            at = after[i] = bisect_left(docs, doc, after[i])
            if at < len(docs) and docs[at] == doc:
                score += gives[at]
        if score > low:
            if len(kept) == k:
                heapq.heapreplace(kept, (score, -doc))
            else:
                heapq.heappush(kept, (score, -doc))
            if len(kept) == k:
                low = kept[0][0]
                while idle < len(lists) and under[idle + 1] <= low:
                    idle += 1
    return sorted(((s, -d) for s, d in kept), key=lambda x: (-x[0], x[1]))


def merged(group: pd.DataFrame, stats: Row, k: int) -> pd.DataFrame:
    """The best of one shard for each item of a block; group: the shard's rows of the terms that the block asks, and that of its documents."""
    whole, rows = group[group["term"] == ""], group[group["term"] != ""]
    if not len(rows):
        return pd.DataFrame({"item": [], "doc_id": [], "score": []}).astype({"item": "int64", "doc_id": "Int64", "score": "int64"})
    ids, n = np.frombuffer(whole["docs"].iloc[0], np.int64), unpacked(whole["counts"].iloc[0])
    m = 25 + 75 * n * stats.n // stats.l
    lists: dict[int, list] = {}
    for docs, counts, total, items, times in zip(rows["docs"], rows["counts"], rows["total"], rows["items"], rows["times"], strict=True):
        weight = int(np.floor(1000 * np.log((2 * stats.n + 2) / (2 * total + 1))))
        if weight <= 0:
            continue
        at = np.cumsum(unpacked(docs))
        impact = _impacts(at, unpacked(counts) + 1, m) * weight
        most, at, by_times = int(impact.max()), at.tolist(), {}
        for item, t in zip(items.tolist(), times.tolist(), strict=True):
            if t not in by_times:
                by_times[t] = (impact * t).tolist()
            lists.setdefault(item, []).append((most * t, at, by_times[t]))
    out = [(item, ids[d] if d < len(ids) else None, score) for item, of in lists.items() for score, d in best(of, k)]
    return pd.DataFrame({"item": [o[0] for o in out], "doc_id": pd.array([o[1] for o in out], "Int64"), "score": [o[2] for o in out]}).astype({"item": "int64", "score": "int64"})


def search(documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each item."""
    asks, blocks = asked_terms(items, item_id, text)
    wanted, few = asks.select("term").distinct(), None
    if wanted.count() <= ASKED:
        data, offsets = utf8(wanted.toArrow()["term"])
        few = np.unique(keys(data, offsets[:-1], offsets[1:]))
    index = postings(documents, few, doc_id, text)
    if few is None:
        index = index.join(wanted.union(wanted.sparkSession.range(1).select(F.lit(""))), "term", "left_semi").select(*index.columns)
    index = checkpoint(index)
    heads, found = index.where("term = ''"), index.where("term <> ''")
    stats = over_batches(heads.select("counts"), _lengths, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    total = found.groupBy("term").agg(F.sum("df").alias("total"))
    by_term = asks.groupBy("block", "term").agg(F.collect_list("item").alias("items"), F.collect_list("times").alias("times"))  # BLOCK items
    lists = found.join(by_term.join(total, "term"), "term").select("shard", "block", "term", "docs", "counts", "total", "items", "times")
    block, none, nobody = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    groups = lists.unionByName(heads.select("shard", block.alias("block"), "term", "docs", "counts", none.alias("total"), nobody.alias("items"), nobody.alias("times")))
    best_of = groups.groupBy("shard", "block").applyInPandas(lambda g: merged(g, stats, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asks.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """How many documents shards have, and how many terms these."""
    n = total = 0
    for batch in batches:
        for told in batch.column(0).to_pylist():
            sizes = unpacked(told)
            n, total = n + len(sizes), total + int(sizes.sum())
    yield pa.table([pa.array([n]), pa.array([total])], ["n", "l"])
