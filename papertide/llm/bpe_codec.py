"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

A merge may be undone only by what competes for its right-hand symbol, and only a merge of lower rank can compete. Chains of such competition
run to the right with falling ranks, so the merge list itself bounds how far ahead a token's fate is decided. `MergeList.lookahead` is that
bound. `WordEncoder` emits a token as soon as so many bytes follow it, and keeps only what is not yet settled; what follows an emitted token
encodes as if it stood alone. Words are cut from the text by `pretokens.Splitter`; each worker keeps a bounded cache of encoded words, which only the encoder fills. Ids go back to text
through `TextDecoder`, some at a time.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings in a text become their ids, as the library
has it by default; very long texts are taken in parts cut before a space; repeated rows each get their row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.pretokens import Cache, Splitter, encoded, pieces_of, strings
from papertide.llm.spans import CHUNK, over_batches


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from U+0100."""
    shown = [chr(b) if unicodedata.category(chr(b))[0] not in "CZ" else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in shown]


class MergeList:
    """Vocabulary and merges of a tokenizer file, with the lookahead that they need."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        letters = byte_alphabet()
        self.first = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        self.letters = {c: b for b, c in enumerate(letters)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a.removesuffix(self.end) + b if self.end else a + b]))
        self.lookahead = self._lookahead()
        self.window = 2 * self.lookahead + max(self.size.values())

    def _lookahead(self) -> int:
        size = self.size = {i: len(t.removesuffix(self.end) if self.end else t) for t, i in self.vocab.items()}
        beyond: dict[int, int] = {}  # of a symbol: the bytes after it that can decide whether it forms
        taken: dict[int, int] = {}  # of a symbol: how far the merges met so far that take it as their left part can reach
        most = 0
        for (a, b), (_, made) in self.ranks.items():
            beyond[made] = max(beyond.get(made, 0), beyond.get(b, 0), taken.get(b, 0))
            taken[a] = max(taken.get(a, 0), size[b] + beyond[made])
            most = max(most, taken[a], beyond[made])
        return most + 1  # and whether the word ends there

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply the merges, the lowest rank first and the leftmost of equals."""
        if len(symbols) > 48:
            return self._merged_long(symbols)
        ranks = self.ranks
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = ranks.get((symbols[i], symbols[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        n, ranks = len(symbols), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := ranks.get((made, symbols[after[i]])):
                    heapq.heappush(heap, (r[0], i, r[1], made, symbols[after[i]]))
            if before[i] >= 0 and (r := ranks.get((symbols[before[i]], made))):
                heapq.heappush(heap, (r[0], before[i], r[1], symbols[before[i]], made))
        return [s for s, x in zip(symbols, alive, strict=True) if x]


class WordEncoder:
    """Takes the bytes of one word in parts of any size and emits the ids that are settled. It never holds more than `window` bytes beyond the part given.

    The first token of a full window is settled whichever it is, as more than the lookahead follows the longest of all tokens there.
    """

    def __init__(self, merges: MergeList) -> None:
        self.merges, self.held, self.size, self.window = merges, bytearray(), merges.size, merges.window

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        while len(self.held) > self.window:
            window, at = self.held[: self.window], 0
            for token in self.merges.merged([self.merges.first[b] for b in window]):
                if len(window) - at - self.size[token] < self.merges.lookahead:
                    break
                out.append(token)
                at += self.size[token]
            del self.held[:at]
        return out

    def finish(self) -> list[int]:
        if not self.held:
            return []
        symbols = [self.merges.first[b] for b in self.held]
        symbols[-1] = self.merges.final[self.held[-1]]
        self.held = bytearray()
        return self.merges.merged(symbols)


#: Bytes and ids that are given to the encoder and the decoder at a time.
BYTES, IDS = 4096, 65_536


def word_ids(merges: MergeList, word: bytes) -> list[int]:
    """The ids of a whole word, which passes through the encoder in parts of bounded size."""
    encoder, out = WordEncoder(merges), []
    for lo in range(0, len(word), BYTES):
        out += encoder.feed(word[lo : lo + BYTES])
    return out + encoder.finish()


class TextDecoder:
    """Takes ids in parts of any size and emits text. Byte-level files yield bytes, which an incremental UTF-8 machine turns into text (replacing
    what is no UTF-8, as the library does); the others yield their tokens' strings with single spaces between, which is their file's rule."""

    def __init__(self, merges: MergeList, raw: list[bytes] | None = None) -> None:
        self.byte_level, self.started = merges.byte_level, False
        self.raw = self._raw(merges) if raw is None else raw
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _raw(self, merges: MergeList) -> list[bytes]:
        """The bytes of each id."""
        names = {i: t for t, i in merges.vocab.items()} | {i: t for t, i in merges.specials.items()}
        raw = [b""] * (max(names) + 1)
        for i, t in names.items():
            raw[i] = bytes(merges.letters[c] for c in t) if self.byte_level and i not in merges.specials.values() else (b" " * (not self.byte_level) + t.encode())
        return raw

    def feed(self, ids: list[int], final: bool = False) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        if data and not self.byte_level and not self.started:
            self.started, data = True, data[1:]
        return self.utf8.decode(data, final)


def _packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids as binary values: 32-bit unsigned, little-endian."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])


def text_of(merges: MergeList, raw: list[bytes], ids: list[int]) -> str:
    """What ids decode to, through the incremental machine in parts of bounded size. raw: TextDecoder.raw, which all texts share."""
    decoder = TextDecoder(merges, raw)
    if len(ids) <= IDS:
        return decoder.feed(ids, True)
    parts = [decoder.feed(ids[lo : lo + IDS]) for lo in range(0, len(ids), IDS)]
    return "".join([*parts, decoder.feed([], True)])


class OddTexts:
    """Ids of texts that the Splitter leaves out: those with special strings, and those with characters that Python's Unicode tables lack.

    A text is cut at its special strings, which stand for their ids. Of the stretches between, those that hold such characters are normalised and cut into words by the
    library, whose tables are newer; the others by the Splitter. The words of both go through the encoder.
    """

    def __init__(self, merges: MergeList, splitter: Splitter, cache: Cache) -> None:
        self.merges, self.splitter, self.cache, self.library = merges, splitter, cache, None
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(merges.specials, key=len, reverse=True))) if merges.specials else None

    def __call__(self, text: str) -> list[int]:
        out, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            out += self._stretch(text[at : found.start()])
            out.append(self.merges.specials[found.group()])
            at = found.end()
        return out + self._stretch(text[at:])

    def _stretch(self, text: str) -> list[int]:
        if not text:
            return []
        plain = self.splitter.normal(text)
        if not self.splitter.unsure([plain]):
            return [i for part in pieces_of(plain, CHUNK) for flat, _ in encoded([part], self.splitter, self.cache, self) for i in flat.tolist()]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.splitter.path)
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        words = (bytes(map(self.merges.letters.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        return [i for w in words for i in word_ids(self.merges, w)]


def coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.Table]:
    """encode_decode() for batches of doc_id and text."""
    merges, splitter = MergeList(path), Splitter(path)
    cache = Cache(lambda words: [word_ids(merges, w.encode()) for w in words])
    odd, raw = OddTexts(merges, splitter, cache), TextDecoder(merges).raw
    for batch in batches:
        lo = 0
        for flat, sizes in encoded(strings(batch.column(1)), splitter, cache, odd):
            n, cut = len(sizes), np.concatenate([[0], np.cumsum(sizes)]).tolist()
            decoded = pa.array([text_of(merges, raw, flat[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.large_string())
            yield pa.table([batch.column(0).slice(lo, n), pa.array(sizes), _packed(flat, sizes).cast(pa.binary()), decoded.cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
            lo += n


def encode_decode(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: 32-bit little-endian) and decoded (their text) of each document."""
    return over_batches(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), lambda batches: coded(batches, path), "doc_id long, n_tokens long, ids binary, decoded string")
