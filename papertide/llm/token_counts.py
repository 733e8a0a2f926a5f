"""Token counts without a pre-token shuffle.

Two tiers answer how many tokens a pre-token has: a broadcast table of the keys and lengths of frequent pre-tokens, and each worker's own
cache, which encodes what the table lacks. Both are bounded, and neither changes a count: a pre-token found in no tier is encoded.

The frequent pre-tokens come from a bounded sample of documents, since they only decide which lookups are fast. Counts cover every text.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text count as the library counts them; very long texts
are cut where the tokenizer would always cut (before a space that follows something else); repeated rows each get their row; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papertide.llm.pretokens import Cache, Splitter, encoded, spelled, strings
from papertide.llm.spans import CHUNK, groups_of, keys, over_batches

#: Documents from which the frequent pre-tokens are taken, tasks that count them, and entries of the broadcast table (8 bytes of key, 4 of length).
SAMPLE_DOCS, SAMPLE_TASKS, TABLE_SIZE = 20_000, 8, 1 << 16


def frequent_pretokens(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of about sample_docs documents; each of SAMPLE_TASKS tasks sends `size` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = Splitter(path), Counter()
        for batch in batches:
            texts = [splitter.normal(t) for t in strings(batch.column(0))]
            for lo, hi in groups_of(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                code, starts, ends, _ = splitter.split(texts[lo:hi])
                _, at, n = np.unique(keys(code, starts, ends), return_index=True, return_counts=True)
                often = np.argsort(-n, kind="stable")[: 4 * size]
                seen.update(dict(zip(spelled(code, starts[at[often]], ends[at[often]]), n[often].tolist(), strict=True)))
            if len(seen) > 8 * size:
                seen = Counter(dict(seen.most_common(4 * size)))
        best = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in best]]), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], ["word", "n"])

    total = documents.count()
    part = documents.select(F.col(text).alias("text"), F.col(doc_id).alias("id"))
    if total > sample_docs:
        # By id and text: copies of one text come in proportion.
        part = part.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(sample_docs / total * (1 << 30)))
    merged: Counter = Counter()
    for row in over_batches(part.select("text").repartition(SAMPLE_TASKS), count, "word array<string>, n array<long>").collect():
        merged.update(dict(zip(row.word, row.n, strict=True)))
    return sorted(merged, key=lambda w: (-merged[w], w))[:size]


def token_counts(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, sample_docs: int = SAMPLE_DOCS, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document, by the tokenizer file at `path`."""
    words = frequent_pretokens(documents, path, doc_id, text, sample_docs, size)
    tokenizer = Tokenizer.from_file(path)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    key = keys(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), ends - np.fromiter(map(len, words), np.int64, len(words)), ends)
    length = np.fromiter((len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)), np.int32, len(words))
    frequent = documents.sparkSession.sparkContext.broadcast((key, length))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, splitter = Tokenizer.from_file(path), Splitter(path)
        cache = Cache(lambda new: [e.ids for e in tok.encode_batch_fast(new, add_special_tokens=False)])
        cache.keep(*frequent.value, np.zeros(0, np.int32))
        for batch in batches:
            n = [s for _, s in encoded(strings(batch.column(1)), splitter, cache, lambda t: tok.encode(t, add_special_tokens=False).ids, counts=True)]
            n = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))
            size = pc.binary_length(batch.column(1).fill_null("")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return over_batches(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
