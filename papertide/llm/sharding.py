"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

Rows fall into buckets by a hash of their content. How many rows of each bucket go to each cell (a shard is a row of cells) is drawn from the
multivariate hypergeometric law, so the counts are those of a uniform permutation and cells have their exact sizes beforehand. Within a bucket
a keyed hash orders the rows (the local permutation), the drawn counts send them to cells (the exchange), and a second keyed hash orders each
cell. Offsets of cells are known beforehand, hence a row's slot is its cell's offset plus its place there.

The driver holds the matrix only: BUCKETS x shards x CELLS numbers at most, whatever the number of rows.

Rows that are the same in id and text cannot be told apart by a hash; where more than HOT are, their places in a written table tell them apart, so
that they spread over the buckets. That table holds no texts.

Defined results: a null text has no bytes; rows with a null id or repeated rows are rows like others; shards are empty where there are fewer rows
than shards; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from papertide.functions.runtime import checkpoint

#: The largest number of buckets and of cells in a shard, and the rows for which each is meant.
BUCKETS, CELLS, ROWS = 1024, 64, 1 << 20
#: How many equal rows are left to their hash.
HOT = 4096
#: Numpy draws for totals below this; larger ones are halved until they are, each half's part drawn by `_drawn`.
TOTAL = 1_000_000_000


def _drawn(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n members drawn from good + bad are good, by inversion over the probabilities relative to that of the mode, which follow from those of their
    neighbours. What lies beyond 12 standard deviations (or 64) has a probability below 1e-30 and is left out."""
    total = good + bad
    low, high, mode = max(0, n - bad), min(n, good), (n + 1) * (good + 1) // (total + 2)
    deviation = (n / total * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)) * total) ** 0.5
    reach = int(12 * deviation) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(weight)
    return mode - len(below) + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(upto) - 1)


def _split(colours: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n drawn members."""
    total = int(colours.sum())
    if total < TOTAL:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    if len(colours) == 1:
        return np.array([n], np.int64)
    half = len(colours) // 2
    first = int(colours[:half].sum())
    part = _drawn(first, total - first, n, rng)
    return np.concatenate([_split(colours[:half], part, rng), _split(colours[half:], n - part, rng)])


def hypergeometric(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many members of each of `counts` fall into each of `sizes` (equal sums) under a uniform permutation."""
    rng = np.random.default_rng(seed)

    def rows(counts: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        if len(counts) == 1:
            return [left]
        half = len(counts) // 2
        first = _split(left, int(counts[:half].sum()), rng)
        return rows(counts[:half], first) + rows(counts[half:], left - first)

    left = np.asarray(sizes, np.int64)
    return np.asarray(rows(np.asarray(counts, np.int64), left) if len(counts) else [], np.int64).reshape(len(counts), len(sizes))


def shard_rows(documents: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", seed: int = 7, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null) of each document; shard sizes differ by one at most."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(doc_id), body).alias("content"),
    )
    rows = checkpoint(rows.withColumn("place", F.monotonically_increasing_id()))
    alike = rows.groupBy("content").agg(F.count("*").alias("n"))
    total = alike.agg(F.sum("n")).first()[0] or 0
    hot = alike.where(F.col("n") > HOT).select("content", F.lit(True).alias("hot"))
    rows = rows.join(hot, "content", "left").withColumn("first", F.when(F.col("hot"), F.xxhash64("content", "place")).otherwise(F.col("content")))
    rows = rows.drop("content", "place", "hot").withColumn("second", F.xxhash64(F.lit(seed + 1), "first"))
    buckets, cells = (min(most, 1 + total // ROWS) for most in (BUCKETS, CELLS))
    buckets = max(buckets, min(64, BUCKETS))
    rows = rows.withColumn("bucket", F.pmod(F.col("first"), F.lit(buckets)).cast("int"))
    counts = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}
    ids = sorted(counts)
    shard_sizes = [total // shards + (s < total % shards) for s in range(shards)]
    cell_sizes = [n // cells + (c < n % cells) for n in shard_sizes for c in range(cells)]
    drawn = hypergeometric([counts[b] for b in ids], cell_sizes, seed).reshape(len(ids), shards, cells)
    offsets = [0] * (shards * cells)
    for s in range(shards):
        for c in range(1, cells):
            offsets[s * cells + c] = offsets[s * cells + c - 1] + cell_sizes[s * cells + c - 1]
    by_shard = drawn.sum(axis=2).cumsum(axis=1)
    by_cell = drawn.cumsum(axis=2) + (by_shard - drawn.sum(axis=2))[:, :, None]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("to_shard", T.ArrayType(T.LongType())), T.StructField("to_cell", T.ArrayType(T.ArrayType(T.LongType())))])
    matrix = documents.sparkSession.createDataFrame([(b, by_shard[i].tolist(), by_cell[i].tolist()) for i, b in enumerate(ids)], schema)
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("first", "doc_id", "size")).cast("long") - 1)
    # The matrix is bounded by BUCKETS x shards x CELLS numbers, so that it can be broadcast.
    placed = placed.join(F.broadcast(matrix), "bucket")
    placed = placed.withColumn("shard", F.size(F.filter("to_shard", lambda x: x <= F.col("at"))))
    placed = placed.withColumn("cell", F.size(F.filter(F.col("to_cell")[F.col("shard")], lambda x: x <= F.col("at"))))
    at_cell = F.lit(offsets)[F.col("shard") * cells + F.col("cell")] if offsets else F.lit(0)
    slot = at_cell + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("second", "first", "doc_id", "size")) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
