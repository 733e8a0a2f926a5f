"""Similarity join of documents on their sets of word n-grams, with Bayesian pruning of candidates.

1. Each text becomes its set of hashed word n-grams; documents with equal sets are one node from here on.
2. BANDS keys of ROWS MinHash values each say which nodes may be similar: those that share a key. At similarity 0.8 a pair shares none with
   probability below 2e-7. Of keys with the same nodes, the first one speaks for all. A key of more than TILE nodes is dealt into chunks, and each pair of chunks is
   a tile of its own, so no group grows with a key.
3. A pair belongs to the first key that its two nodes share. A pass over the keys alone leaves, in each tile, the nodes that have such a pair there; only these
   bring their texts.
4. In a tile, the pairs that share a key are compared, MinHash values STEP at a time: under a uniform prior, the posterior probability that a pair with k of
   m equal values reaches the threshold is that of at most k successes in m + 1 trials; pairs fall out when it is below `tolerance`. The
   others, where they belong to the key, are verified on the sets themselves, so that no pair is linked that does not reach the threshold.
5. Each tile sends a spanning forest of its links and each node's number of links, never the pairs. Classes are the connected components of the forests.

Words are runs of what is not a space or a control character 9 to 13, with ASCII letters lowered. A text of fewer words than n has one n-gram: all its
words. Nodes and n-grams are known by 64-bit hashes.

Defined results: texts without words (null or empty) have no n-grams and are linked to nothing; rows with a null id take no part and get a null class;
repeated rows count as copies of each other; other columns are ignored; an empty table gives an empty result; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import checkpoint
from papertide.llm.spans import CHUNK, LOWER, groups_of, keys, mix, over_batches, ragged, utf8, words
from papertide.operators.components import components

BANDS, ROWS, STEP, TILE = 40, 5, 40, 2048
_rng = np.random.default_rng(20)
MULTIPLIER = _rng.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of n-gram hashes of texts laid end to end, and how many each text has."""
    low = LOWER[data]
    starts, ends, number = words(low, offsets)
    word = keys(low, starts, ends)
    first = np.cumsum(number) - number
    count = np.where(number >= n, number - n + 1, np.minimum(number, 1))
    at = ragged(first, count)
    width = np.repeat(np.minimum(number, n), count)
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        use = k < width
        gram = np.where(use, mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(at + k, max(len(word) - 1, 0))] + np.uint64(k)), gram) if len(at) else gram
    owner = np.repeat(np.arange(len(number)), count)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[keep], np.bincount(owner[keep], minlength=len(number))


def text_shingles(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for lo, hi in groups_of(np.diff(offsets), CHUNK):
        yield lo, hi, *shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)


def signatures(gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MinHash values (a row for each hash function) of sets laid end to end, none empty."""
    x = (gram >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum(size) - size
    return np.stack([np.minimum.reduceat(x * a + b, begin) for a, b in zip(MULTIPLIER, SHIFT, strict=True)]) if len(size) else np.zeros((len(SHIFT), 0), np.uint32)


def set_keys(gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (none empty): sums of mixed members, mixed with the size."""
    begin = np.cumsum(size) - size
    a, b = (np.add.reduceat(mix(gram ^ np.uint64(seed)), begin) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return mix(mix(a + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b).view(np.int64)


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """After each STEP values, the fewest matches with which a pair stays."""
    out = []
    for m in range(STEP, BANDS * ROWS + 1, STEP):
        tail, k = 0.0, -1
        while tail < tolerance:
            k += 1
            tail += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """The keys (a row for each set, a column for each band) of MinHash values."""
    least, out = values.astype(np.uint64), np.zeros((values.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(values.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        out[:, b] = h
    return out.view(np.int64)


def _nodes(documents: DataFrame, n: int) -> DataFrame:
    """id, node and bands of each document that has n-grams. documents: id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for lo, hi, gram, size in text_shingles(batch.column(1), n):
                has = np.flatnonzero(size)
                bands = band_keys(signatures(gram, size[has]))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                node = set_keys(gram, size[has]) if len(has) else np.zeros(0, np.int64)
                yield pa.table([batch.column(0).slice(lo, hi - lo).take(pa.array(has)), pa.array(node), listed], ["id", "node", "bands"])

    return over_batches(documents, work, "id long, node long, bands array<long>")


def similar_pairs(gram: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) between `left` and `right` (equal arrays: all pairs) of sets laid end to end whose Jaccard similarity reaches the threshold and that
    share no key of a band before `band`."""
    values = signatures(gram, size)
    before = band_keys(values)[:, :band]
    inside = left is right
    few, found = fewest_matches(threshold, tolerance), []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        match = np.zeros((len(rows), len(right)), np.uint8)
        for h in range(STEP):
            match += values[h][rows][:, None] == values[h][right][None, :]
        keep = (match >= few[0]) & (np.minimum(size[rows][:, None], size[right]) >= threshold * np.maximum(size[rows][:, None], size[right]) - 1e-9)
        if inside:
            keep &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(keep)
        n = match[i, j].astype(np.int32)
        i, j = rows[i], right[j]
        for step in range(1, len(few)):
            for h in range(step * STEP, (step + 1) * STEP):
                n += values[h][i] == values[h][j]
            stay = n >= few[step]
            i, j, n = i[stay], j[stay], n[stay]
        own = np.ones(len(i), bool)
        for b in range(band):
            own &= before[i, b] != before[j, b]
        found.append((i[own], j[own]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    shared = _shared(gram, size, i, j)
    true = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    return i[true], j[true]


def _shared(gram: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members the sets of each pair share."""
    begin = np.cumsum(size) - size
    if len(i) <= 4 * len(size) or len(i) < 2000:
        out = np.zeros(len(i), np.int64)
        for p, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = gram[begin[a] : begin[a] + size[a]], gram[begin[b] : begin[b] + size[b]]
            at = np.searchsorted(x, y)
            out[p] = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)
        return out
    # Many pairs among few sets: a product of membership matrices, over the members that several sets have, some columns at a time.
    member, column, times = np.unique(gram, return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    owner = np.repeat(np.arange(len(size)), size)
    keep = number >= 0
    owner, number = owner[keep], number[keep]
    order = np.argsort(number, kind="stable")
    owner, number, total = owner[order], number[order], np.zeros((len(size), len(size)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(number, [lo, lo + 2048])
        x = np.zeros((len(size), 2048), np.float32)
        x[owner[a:b], number[a:b] - lo] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    while (root != root[root]).any():
        root = root[root]
    return root


def _by_tile(batches: Iterator[pa.RecordBatch], group: Callable[[pa.Table], pa.Table]) -> Iterator[pa.Table]:
    """group() of the rows of each tile, which stand together in the batches; the tile is the first column."""
    held: list[pa.Table] = []
    for batch in batches:
        table, tile = pa.Table.from_batches([batch]), batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        if held and len(tile) and held[0].column(0)[0].as_py() != tile[0]:
            yield group(pa.concat_tables(held))
            held = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            held.append(table.slice(a, b - a))
            if b < len(tile):
                yield group(pa.concat_tables(held))
                held = []
    if held and len(held[0]):
        yield group(pa.concat_tables(held))


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a tile that are compared with each other: two chunks, or (equal arrays) one with itself."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left


def tiles(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """tile, side, band and node for the nodes that have a pair belonging to the tile's key. sets: node and bands."""
    posted = sets.select("node", F.posexplode("bands").alias("band", "key"))
    a, b = F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b")
    shared = posted.groupBy("band", "key").agg(F.count("*").alias("n"), a, b).where("n > 1")
    first = shared.groupBy("n", "a", "b").agg(F.min(F.struct("band", "key")).alias("first")).select("first.*", "n")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    met = posted.join(first, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    # Each chunk meets itself and each other chunk of its key once.
    met = met.select(F.xxhash64("band", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "band", "node")

    def own(rows: pa.Table) -> pa.Table:
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(rows), BANDS)
        left, right = _sides(rows["side"].to_numpy())
        band, has = rows["band"][0].as_py(), np.zeros(len(rows), bool)
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            pair = some[:, None] != right[None, :]
            for b in range(band):
                pair &= bands[some, b][:, None] != bands[right, b][None, :]
            has[some] |= pair.any(axis=1)
            has[right] |= pair.any(axis=0)
        return rows.select(["tile", "side", "band", "node"]).filter(pa.array(has))

    keyed = met.join(sets.select("node", "bands"), "node").select("tile", "side", "band", "node", "bands")
    return over_batches(keyed.repartition("tile").sortWithinPartitions("tile"), lambda batches: _by_tile(batches, own), "tile long, side int, band int, node long")


def _links(met: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """node, root and links (documents linked to) for the nodes of each tile. met: tile, side, band, node, copies, text; a tile's rows stand together."""

    def group(rows: pa.Table) -> pa.Table:
        parts = [(g, s) for _, _, g, s in text_shingles(rows["text"].combine_chunks(), n)]
        gram, size = np.concatenate([g for g, _ in parts]), np.concatenate([s for _, s in parts])
        node, copies, side = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        # A text whose set is not the node's shares its id with the one that is; and of equal ones, one is enough.
        begin = np.cumsum(size) - size
        good = np.zeros(len(node), bool)
        has = size > 0
        good[has] = set_keys(gram, size[has]) == node[has]
        where = np.flatnonzero(good)
        where = where[np.unique(node[where], return_index=True)[1]]
        gram, size, node, copies, side = gram[ragged(begin[where], size[where])], size[where], node[where], copies[where], side[where]
        left, right = _sides(side)
        i, j = similar_pairs(gram, size, left, right, threshold, tolerance, rows["band"][0].as_py())
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        out = np.flatnonzero(links)
        return pa.table([pa.array(node[out]), pa.array(node[_forest(len(node), i, j)[out]]), pa.array(links[out].astype(np.int64))], ["node", "root", "links"])

    return over_batches(met, lambda batches: _by_tile(batches, group), "node long, root long, links long")


def _texts(documents: DataFrame, n: int) -> DataFrame:
    """id, node and text of each document that has n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for lo, _, gram, size in text_shingles(batch.column(1), n):
                at = pa.array(lo + np.flatnonzero(size))
                yield pa.table([batch.column(0).take(at), pa.array(set_keys(gram, size[size > 0]) if len(at) else np.zeros(0, np.int64)), batch.column(1).take(at)], ["id", "node", "text"])

    return over_batches(documents, work, "id long, node long, text string")


def _with_texts(placed: DataFrame, nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The placed nodes with a text each, that of the row which has their id. Where an id has several rows, its texts are told apart by their own nodes, one of each."""
    columns = ("tile", "side", "band", "node", "copies", "text")
    several = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        return placed.join(rows, "id").select(*columns)
    several = checkpoint(several)
    told = _texts(rows.join(several, "id", "left_semi"), n).groupBy("id", "node").agg(F.min("text").alias("text"))
    alone = placed.join(several, "id", "left_anti").join(rows, "id")
    return alone.select(*columns).union(placed.join(told, ["id", "node"]).select(*columns))


def jaccard_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, tile: int = TILE) -> DataFrame:
    """doc_id, class_id (the smallest id of the documents that links connect it to, itself included) and n_links (documents whose similarity to it
    reaches the threshold) of each document."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    nodes = checkpoint(_nodes(rows.where("id is not null"), n))
    sets = checkpoint(nodes.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    placed = checkpoint(tiles(sets, tile).join(sets.select("node", "id", "copies"), "node"))
    met = _with_texts(placed, nodes, rows.where("id is not null"), n)
    links = checkpoint(_links(met.repartition("tile").sortWithinPartitions("tile"), n, threshold, tolerance))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    component = components(links.select("node", "root").distinct(), "node", "root")
    each = sets.select("node", "id", "copies").join(total, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = each.groupBy("component").agg(F.min("id").alias("class_id"))
    # Classes are settled between nodes; documents meet them once.
    settled = each.join(lowest, "component").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # An id that several texts bear (repeated rows among them) takes the smallest class and the most links of its texts.
    found = nodes.select("id", "node").join(settled, "node").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return rows.select("id").join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
