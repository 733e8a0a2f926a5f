"""Vector code compression: product quantisation in whole numbers, so that every run gives the same codes.

Components become floor(SCALE * x). A vector is cut into equal consecutive parts, and each part position has a codebook of a few entries, moved by Lloyd rounds: every
part goes to its nearest entry, and an entry becomes the floor of the mean of its parts. The rows are an RDD of columnar NumPy blocks, one array of rows for each
component. In a block, squared distances accumulate dimension by dimension, and np.add.at adds parts into tensors of sums and counts; treeAggregate merges these by a
reduction tree, so the driver gets one tensor of the codebooks' size a round, whatever the number of rows. Sums of whole numbers do not depend on their order, hence
neither on partitions nor on tasks that run again.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, all others kept. Vectors are filled with zeros at their end to the
length of the longest, and that to a multiple of the number of parts. The first entries are the vectors of the smallest ids, null ids last, equal ids in the order of
their vectors; with fewer rows there are fewer entries. Repeated rows count as often as they occur and each get their row; null labels are one label; other columns are
ignored; an empty table gives an empty result. Where a component is too large for sums in 64 bits (WIDE), the same steps run on Python's whole numbers, and errors
beyond 64 bits are given as the largest 64-bit number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import checkpoint
from papertide.llm.spans import over_batches

SCALE, BLOCK = 4096.0, 4096
#: Up to this size of a component, sums of 2^38 rows and squared distances of 2^13 components stay within 64 bits.
WIDE = 1 << 24
LARGEST = (1 << 63) - 1


def whole(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x): the product with a power of two is exact, but for numbers so large that they have no fraction."""
    if not wide:
        return np.floor(x * SCALE).astype(np.int32)
    flat = [int(np.floor(v * SCALE)) if abs(v) < 2.0**1000 else int(v) * int(SCALE) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def columns(batch: pa.Array, width: int, wide: bool) -> np.ndarray:
    """The vectors of a list column as a row of whole numbers for each component; short vectors end in zeros."""
    batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    size, flat = batch.value_lengths().to_numpy(), batch.flatten().to_numpy().astype(np.float64)
    x = np.zeros((width, len(batch)), np.float64)
    own = np.repeat(np.arange(len(batch)), size)
    x[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), own] = flat
    return whole(x, wide)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For columns x and books (part, entry, component): the nearest entry of each part, ties to the first, and its squared distance."""
    parts, entries, width = books.shape
    index, error = np.zeros((parts, x.shape[1]), np.int64), np.zeros((parts, x.shape[1]), books.dtype)
    for p in range(parts):
        far = np.zeros((entries, x.shape[1]), books.dtype)
        for j in range(width):
            off = x[p * width + j] - books[p, :, j, None]
            far += off * off
        index[p] = far.argmin(axis=0)
        error[p] = far[index[p], np.arange(x.shape[1])]
    return index, error


def gather(books: np.ndarray, x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add the parts of a block to the sums and counts of their nearest entries."""
    index, _ = assign(x, books)
    width = books.shape[2]
    for p in range(len(books)):
        np.add.at(counts[p], index[p], 1)
        for j in range(width):
            np.add.at(sums[p, :, j], index[p], x[p * width + j])


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; unused entries stay."""
    used = counts > 0
    return np.where(used[:, :, None], sums // np.where(used, counts, 1)[:, :, None], books)


def _kept(vectors: DataFrame, vector: str, *others: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(*(F.col(c) for c in others), v.alias("v"))


def _shape(kept: DataFrame, parts: int) -> tuple[int, bool]:
    """The filled length of vectors, and whether components are too large for 64-bit sums."""
    row = kept.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()
    return -(-(row[0] or 0) // parts) * parts, (row[1] or 0.0) * SCALE >= WIDE


def blocks(kept: DataFrame, width: int, wide: bool) -> RDD:
    """The rows as an RDD of columnar blocks, computed once where there is room and again from the table where one is lost."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                x = columns(batch.column(0).slice(lo, BLOCK), width, wide)
                told = np.ascontiguousarray(x, "<i4").tobytes() if not wide else repr(x.tolist()).encode()
                yield pa.table([pa.array([x.shape[1]], pa.int32()), pa.array([told], pa.binary())], ["n", "x"])

    def read(row) -> np.ndarray:
        if wide:
            return np.array([list(map(int, line.strip("[ ").split(", "))) for line in row.x.decode().rstrip("]").split("],")], object).reshape(width, row.n)
        return np.frombuffer(row.x, "<i4").reshape(width, row.n).astype(np.int64)

    return over_batches(kept.select("v"), pack, "n int, x binary").rdd.persist(StorageLevel.MEMORY_AND_DISK).map(read)


def learn(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """The codebooks as an array (part, entry, component)."""
    kept = _kept(vectors, vector, vec_id)
    width, wide = _shape(kept, parts)
    kind = object if wide else np.int64
    first = kept.orderBy(F.col(vec_id).cast("long").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = columns(first["v"], width, wide).astype(kind).T.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not width or not books.shape[1]:
        return books
    spread = blocks(kept, width, wide)

    def add(total: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gather(shared.value, x, *total)
        return total

    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)  # of the size of the codebooks
        nothing = np.zeros(books.shape, kind), np.zeros(books.shape[:2], np.int64)
        books = moved(books, *spread.treeAggregate(nothing, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3))
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance to the entries of the code) of each kept row."""
    kept = _kept(vectors, vector, vec_id, label)
    wide, parts = books.dtype == object, len(books)
    width = parts * books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # of the size of the codebooks

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                index, error = assign(columns(part.column(2), width, wide).astype(books.dtype), shared.value)
                told, total = index.T.astype(np.uint8).tobytes().hex(), np.minimum(error.sum(axis=0), LARGEST).astype(np.int64)
                codes = [told[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(part))]
                yield pa.table([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(total)], ["vec_id", "label", "code", "error"])

    named = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), "v")
    return over_batches(named, code, f"vec_id long, label {named.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", to: str = "decoded") -> DataFrame:
    """The rows with the vector that their code stands for: the entries, over SCALE."""
    width = books.shape[2]
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in entry)) for entry in part)) for part in books))
    place = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(to, F.concat(*(table[p][place(p)] for p in range(len(books)))) if width else F.array().cast("array<double>"))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, label, code, error, label_error (the error summed over rows of the same label) and the digest of the codebooks for each kept row."""
    books = learn(vectors, vec_id, vector, parts, entries, rounds)
    coded = checkpoint(encode(vectors, books, vec_id, vector, label))
    # One row a label and task before the shuffle; rows of a label that many have are split by AQE where the join is not a broadcast.
    total = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
