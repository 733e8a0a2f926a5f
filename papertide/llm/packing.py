"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Packing looks at lengths only, so it works on the histogram of piece lengths, which has no more entries than a sequence has tokens. A bin is
filled greedily, the longest piece that fits first; then its smallest piece gives way to the two unpacked pieces that fill the widened gap best,
if they fill it better. As long as the histogram still holds a bin's pieces, the next bin would come out the same: so a bin is applied as often
as its pieces last, and the plan is a list of bin patterns with multiplicities. Pieces are numbered within their length (in hashed parts, so
that a common length is no single group), and the number says which bin of which pattern a piece goes to.

Only the histogram reaches the driver, and only the plan is broadcast; both are bounded by the sequence length.

Defined results: a null or empty text is the end token alone; longer documents are cut into whole sequences and a rest; repeated rows are
packed as rows of their own, rows with a null id too; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from papertide.functions.runtime import checkpoint
from papertide.llm.pretokens import Cache, Splitter, encoded, strings
from papertide.llm.spans import over_batches

#: Pieces for each of the parts into which the pieces of one length are numbered separately.
PIECES = 1 << 16


def _fill(lengths: list[int], count: dict[int, int], room: int) -> dict[int, int]:
    """One bin: piece lengths and how many of each. lengths: those with a count, ascending."""
    bin_: dict[int, int] = {}

    def left(n: int) -> int:
        return count[n] - bin_.get(n, 0)

    def greedy(gap: int) -> int:
        at = bisect_right(lengths, gap) - 1
        while at >= 0:
            n = lengths[at]
            if k := min(left(n), gap // n):
                bin_[n] = bin_.get(n, 0) + k
                gap -= k * n
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        return gap

    gap = greedy(room)
    if not gap:
        return bin_
    small = min(bin_)
    target, best = gap + small, (small, 0, 0)
    at = bisect_right(lengths, target) - 1
    while at >= 0 and 2 * lengths[at] > best[0]:
        a = lengths[at]
        if left(a):
            other = min(at, bisect_right(lengths, target - a) - 1)
            while other >= 0 and not left(lengths[other]) - (lengths[other] == a) > 0:
                other -= 1
            if other >= 0 and a + lengths[other] > best[0]:
                best = (a + lengths[other], a, lengths[other])
                if best[0] == target:
                    break
        at -= 1
    if best[1]:
        bin_[small] -= 1
        for n in best[1:]:
            bin_[n] = bin_.get(n, 0) + 1
        bin_ = {n: k for n, k in bin_.items() if k}
        greedy(target - best[0])
    return bin_


def plan(histogram: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces in each bin, first bin, offset in the bin), sorted, and the number of bins."""
    count = {n: k for n, k in histogram.items() if k}
    lengths, used, rows, bins = sorted(count), dict.fromkeys(count, 0), [], 0
    while lengths:
        bin_ = _fill(lengths, count, room)
        times = min(count[n] // k for n, k in bin_.items())
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, used[n], bin_[n], bins, offset))
            offset += n * bin_[n]
            used[n] += bin_[n] * times
            count[n] -= bin_[n] * times
            if not count[n]:
                lengths.pop(bisect_left(lengths, n))
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pieces(documents: DataFrame, path: str, room: int, end: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document's ids with the end id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        tok, splitter = Tokenizer.from_file(path), Splitter(path)
        cache = Cache(lambda words: [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)])
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            lo = 0
            for flat, sizes in encoded(strings(batch.column(1)), splitter, cache, lambda t: tok.encode(t, add_special_tokens=False).ids):
                data, cut = memoryview(flat.astype("<u4").tobytes()), (np.concatenate([[0], np.cumsum(sizes)]) * 4).tolist()
                number = (sizes + room) // room  # of pieces: the end id counts
                owner = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                length = np.minimum(room, sizes[owner] + 1 - piece * room)
                crc = []
                for i, p, n in zip(owner.tolist(), piece.tolist(), length.tolist(), strict=True):
                    a = cut[i] + 4 * p * room
                    body = data[a : min(a + 4 * n, cut[i + 1])]
                    crc.append(zlib.crc32(last, zlib.crc32(body)) if len(body) < 4 * n else zlib.crc32(body))
                yield pa.table([batch.column(0).slice(lo, len(sizes)).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(piece * room), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
                lo += len(sizes)

    return over_batches(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, path: str, room: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    # Tokens are counted once: the histogram and the placement both read the checkpoint, whose rows hold no text.
    cut = checkpoint(pieces(documents, path, room, end, doc_id, text).withColumn("hash", F.xxhash64("doc_id", "piece", "ids_crc32")))
    cut = cut.withColumn("part", F.pmod("hash", F.lit(1 + cut.count() // PIECES)).cast("int"))
    parts = cut.groupBy("length", "part").count()
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table, _ = plan(histogram, room)
    shared = documents.sparkSession.sparkContext.broadcast(table)
    before = parts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = cut.withColumn("inside", inside).join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("inside"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        t = shared.value
        top = np.int64(1) << 40  # above any number of pieces of a length
        key = t[:, 0] * top + t[:, 1]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            row = t[np.searchsorted(key, length * top + number, side="right") - 1]
            at = number - row[:, 1]
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.table([*out, pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return over_batches(numbered.select(*columns), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
