"""Pre-tokens of the two public JSON tokenizers, found by character class over whole chunks of documents, and a bounded cache of encodings.

`Splitter` cuts texts where the tokenizer's own pattern does; `Cache` keeps what each pre-token encodes to. Both are exact: texts that hold
one of the tokenizer's special strings, or characters that Python's Unicode tables lack, are left to a function that the caller gives, and a
pre-token that the cache lacks is encoded on its own. A cached pre-token is recognised by its 64-bit key (see `spans`).
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from papertide.llm.spans import CHUNK, KeyTable, groups_of, keys, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

SPACE, BLANK, LETTER, NUMBER, OTHER, UNASSIGNED = range(6)
#: The characters with the Unicode property White_Space, besides the space.
WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the patterns of both tokenizers let follow an apostrophe.
SINGLE, DOUBLE = "stmd", ("re", "ve", "ll")
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((UNASSIGNED if (of := unicodedata.category(chr(c))) == "Cn" else kind.get(of[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        out[WHITE] = BLANK
        out[32] = SPACE
        _classes.append(out)
    return _classes[0]


class Splitter:
    """Cuts texts into pre-tokens. `joined`: a space belongs to the pre-token after it and spaces are kept (byte-level), or spaces go and digits stand alone (word-level)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.joined = path, spec["normalizer"] is None
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def normal(self, text: str) -> str:
        """The text as the tokenizer's normalizer leaves it, but for white space, which no word-level pre-token holds."""
        if self.joined or (text.isascii() and text.islower()):
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would make some a final sigma
        return text.lower()

    def special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def unsure(self, texts: list[str]) -> list[int]:
        """The texts with characters that Python's Unicode tables lack, so that another version's may lower or class them otherwise."""
        odd = [i for i, t in enumerate(texts) if not t.isascii()]
        sizes = np.fromiter((len(texts[i]) for i in odd), np.int64, len(odd))
        out = []
        for lo, hi in groups_of(sizes, CHUNK):
            code = np.frombuffer("".join(texts[i] for i in odd[lo:hi]).encode("utf-32-le"), np.uint32)
            if len(at := np.flatnonzero(classes()[code] == UNASSIGNED)):
                owner = np.searchsorted(np.cumsum(sizes[lo:hi]), at, side="right")
                out += [odd[lo + k] for k in np.unique(owner).tolist()]
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the normal texts laid end to end, starts and ends of pre-tokens, and their number by text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n, offsets = len(code), np.concatenate([[0], np.cumsum(sizes)])
        if not n:
            return code, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        cls = classes()[code]
        run = np.maximum(cls, BLANK)
        first, last = np.zeros(n + 1, bool), np.zeros(n, bool)
        first[offsets[:-1][sizes > 0]] = True
        first[n] = True
        last[:] = first[1:]
        change = np.empty(n + 1, bool)
        change[0], change[n] = True, True
        np.not_equal(run[1:], run[:-1], out=change[1:n])
        start = first[:n] | change[:n]
        white = run == BLANK
        if self.joined:
            start |= white & ~last & np.append(run[1:] != BLANK, False)
            after = np.zeros(n, bool)
            after[1:] = cls[:-1] == SPACE
            start &= white | first[:n] | ~after
        else:
            start |= cls == NUMBER
        self._contractions(code, cls, start, last)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if not self.joined:
            keep = ~white[starts]
            starts, ends = starts[keep], ends[keep]
        return code, starts, ends, np.diff(np.searchsorted(starts, offsets))

    @staticmethod
    def _contractions(code: np.ndarray, cls: np.ndarray, start: np.ndarray, last: np.ndarray) -> None:
        at = np.flatnonzero((code == 39) & start & ~last)
        at = at[cls[at + 1] == LETTER]
        for i in at.tolist():
            one = chr(code[i + 1])
            size = 1 if one in SINGLE else 2 if not last[i + 1] and code[i + 2] < 128 and one + chr(code[i + 2]) in DOUBLE else 0
            if size:
                start[i + 1] = False
                if not last[i + size] and cls[i + size + 1] == LETTER:
                    start[i + size + 1] = True


def spelled(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as strings."""
    size = ends - starts
    text = code[ragged(starts, size)].tobytes().decode("utf-32-le")
    cut = np.cumsum(size).tolist()
    return [text[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)] if cut else []


def pieces_of(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about limit characters, cut only where a space follows something else."""
    lo = 0
    while len(text) - lo > limit:
        cut = text.find(" ", lo + limit)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


class Cache:
    """Encodings of pre-tokens: a first tier that stays, and a second that this worker fills and empties once it holds `bound` entries.

    `encode` takes a list of distinct pre-tokens and returns their lists of ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bound: int = 1_000_000) -> None:
        self.encode, self.bound, self.kept = encode, bound, None
        self._empty()

    def _empty(self) -> None:
        self.table, self.size, self.offset, self.ids, self.used = KeyTable(), np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, k: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Insert distinct keys that are not there, with the sizes of their encodings and these end to end (or nothing, where only sizes are wanted)."""
        n, total = self.table.n, len(ids)
        self.size, self.offset, self.ids = self._grown(self.size, n + len(k)), self._grown(self.offset, n + len(k)), self._grown(self.ids, self.used + total)
        self.size[n : n + len(k)] = sizes
        self.offset[n : n + len(k)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.table.add(k)

    def keep(self, k: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Make these the first tier."""
        self.kept = (k, sizes, ids)
        self._seed()

    def _seed(self) -> None:
        self._empty()
        if self.kept is not None:
            self.add(*self.kept)

    def rows(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each pre-token; those not held yet are encoded first."""
        if self.table.n > self.bound:
            self._seed()
        k = keys(code, starts, ends)
        found = self.table.find(k)
        if len(miss := np.flatnonzero(found < 0)):
            new, at = np.unique(k[miss], return_index=True)
            at = miss[at]
            lists = self.encode(spelled(code, starts[at], ends[at]))
            self.add(new, np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.int32))
            found[miss] = self.table.find(k[miss])
        return found


def encoded(texts: list[str], splitter: Splitter, cache: Cache, whole: Callable[[str], list[int]], counts: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of neighbouring texts: the ids of all of them end to end (none if only counts are asked for), and how many each has."""
    plain, special = [], {}
    for i, t in enumerate(texts):
        if splitter.special(t):
            special[i] = np.asarray(whole(t), np.int32)
            plain.append("")
        else:
            plain.append(splitter.normal(t))
    for i in splitter.unsure(plain):
        special[i], plain[i] = np.asarray(whole(texts[i]), np.int32), ""
    for lo, hi in groups_of(np.fromiter(map(len, plain), np.int64, len(plain)), CHUNK):
        ids, sizes = [], np.zeros(hi - lo, np.int64)
        for part, owners in _parts(plain[lo:hi]):
            code, starts, ends, number = splitter.split(part)
            rows = cache.rows(code, starts, ends)
            n = cache.size[rows]
            total = np.concatenate([[0], np.cumsum(n)])
            bounds = np.concatenate([[0], np.cumsum(number)])
            np.add.at(sizes, owners, total[bounds[1:]] - total[bounds[:-1]])
            if not counts:
                ids.append(cache.ids[ragged(cache.offset[rows], n.astype(np.int64))])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if inner := [i for i in special if lo <= i < hi]:
            parts, bounds = [], np.concatenate([[0], np.cumsum(sizes)])
            for i in range(lo, hi):
                parts.append(special[i] if i in special else flat[bounds[i - lo] : bounds[i - lo + 1]])
            for i in inner:
                sizes[i - lo] = len(special[i])
            flat = np.concatenate(parts) if not counts else flat
        yield flat, sizes


def _parts(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts as they are, or one very long text in several parts; with the text that each part belongs to."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        for part in pieces_of(texts[0], CHUNK):
            yield [part], np.zeros(1, np.int64)
    else:
        yield texts, np.arange(len(texts))


def strings(column: pa.Array) -> list[str]:
    """A string column as a list; null counts as empty."""
    return column.fill_null("").to_pylist()
