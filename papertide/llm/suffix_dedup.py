"""Exact removal of long repeated byte strings by a distributed sparse suffix sort.

A byte goes if it lies in a string of WIDTH bytes that also starts in a document with a smaller id. Sorting all suffixes would move each byte WIDTH
times, so only the suffixes at anchors are sorted: in each string of WIDTH bytes, the GRAM-byte string with the smallest hash is its anchor, so equal
strings have equal anchors at equal places. The steps, all over blocks of documents of about BLOCK bytes and parts of about PART anchors:

1. Copies of whole texts are set apart by their digest: all but the one with the smallest id go whole.
2. Sieve: each block sends the hashes of its anchors, once each, to parts by hash; parts answer with a bit for each hash that another document has.
3. Sort: each surviving anchor goes, with the bytes around it, to the part of its hash, where the suffixes from the anchor on, and the reversed
   prefixes before it, are sorted deep-shallow: multikey quicksort to SHALLOW bytes, then blind tries for the groups that still agree. Common prefix lengths
   of neighbours give the classes of equal left and right parts, and so, for each of the places at which a string can hold the anchor, the
   smallest document with the same string.
4. An anchor that occurs more than HOT times goes another way: blocks sort the strings it anchors, send each distinct one with its smallest id,
   and parts by string hash find the smallest of all. So no group grows with an anchor, and frequent strings meet as one row for each block.
5. Blocks mark the answered strings and cut what they cover.

Documents are shuffled once; each step that needs them reads that same shuffle. Anchor and digest hashes only choose what is compared:
matches are decided on bytes, but for whole-text copies, which a SHA-256 digest and the size identify.

Defined results: a null or empty text keeps nothing and loses nothing; texts shorter than WIDTH lose nothing; a null id counts as larger than all
others; rows with equal ids do not take from each other; very long texts are taken in overlapping segments; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertide.llm.spans import BASE, mix, over_batches, ragged, release, utf8

WIDTH, GRAM, SHALLOW, HOT = 50, 20, 24, 4096
BLOCK, PART, SEGMENT = 8 << 20, 1_000_000, 1 << 20
#: Strings of hot anchors that a block sorts together; each lot sends its own distinct strings.
TOGETHER = 1 << 20
LAST = (1 << 63) - 1
LEFT = WIDTH - GRAM


# --- deep-shallow sorting -------------------------------------------------------------------------------------------------------------


def big_endian(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words that compare as the bytes do."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def _sort_groups(order: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort members within their groups by value; and the groups of those that agree."""
    at = np.lexsort((value, group))
    order, group, value = order[at], group[at], value[at]
    split = np.ones(len(order), bool)
    split[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return order, np.cumsum(split) - 1


def _shared_only(group: np.ndarray) -> np.ndarray:
    """Which members are not alone in their group (groups ascend)."""
    edge = np.ones(len(group) + 1, bool)
    edge[1:-1] = group[1:] != group[:-1]
    return ~(edge[1:] & edge[:-1])


def deep_shallow(words: np.ndarray, bucket: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings (rows of big-endian words) within buckets, and the bytes each has in common with the one before it (-1: another bucket).

    Shallow: multikey quicksort, a word a level, on the groups that agree so far. Deep: blind tries, built for all remaining groups at once; a
    node's branching byte is where the smallest and largest of its members first differ, and what they have in common is never looked at.
    """
    n = len(words)
    order, group = _sort_groups(np.arange(n), np.zeros(n, np.int64), bucket)
    for level in range(min(shallow // 8, words.shape[1])):
        at = np.flatnonzero(_shared_only(group))
        if not len(at):
            break
        sub, _ = _sort_groups(order[at], group[at], words[order[at], level])
        order[at] = sub
        group = _regrouped(group, order, words[:, level])
    at = np.flatnonzero(_shared_only(group))
    members, node = order[at], group[at]
    while len(members):
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(first, len(node)))
        branch, byte = np.full(len(first), -1), np.zeros(len(first), np.int64)
        for level in range(words.shape[1]):
            value = words[members, level]
            differ = np.minimum.reduceat(value, first) ^ np.maximum.reduceat(value, first)
            new = (branch < 0) & (differ > 0)
            branch[new], byte[new] = level, _leading_bytes(differ[new])
        open_ = np.repeat(branch >= 0, size)
        if not open_.any():
            break
        slot, members, at = node[open_], members[open_], at[open_]
        level, shift = np.repeat(branch, size)[open_], (56 - 8 * np.repeat(byte, size)[open_]).astype(np.uint64)
        letter = (words[members, level] >> shift) & np.uint64(255)
        members, node = _sort_groups(members, slot, letter)
        order[at] = members
        keep = _shared_only(node)
        members, node, at = members[keep], node[keep], at[keep]
    common = np.full(n, -1)
    same = bucket[order[1:]] == bucket[order[:-1]]
    total, going = np.zeros(int(same.sum()), np.int64), np.ones(int(same.sum()), bool)
    a, b = order[1:][same], order[:-1][same]
    for level in range(words.shape[1]):
        differ = words[a, level] ^ words[b, level]
        total[going] += np.where(differ[going] > 0, _leading_bytes(differ[going]), 8)
        going &= differ == 0
    common[1:][same] = total
    return order, common


def _regrouped(group: np.ndarray, order: np.ndarray, value: np.ndarray) -> np.ndarray:
    v = value[order]
    split = np.ones(len(order), bool)
    split[1:] = (group[1:] != group[:-1]) | (v[1:] != v[:-1])
    return np.cumsum(split) - 1


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """The zero bytes at the head of each word (8 for zero)."""
    n = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        low = x < (np.uint64(1) << np.uint64(64 - bits))
        n[low] += bits // 8
        x = np.where(low, x << np.uint64(bits), x)
    return n + (x == 0)


# --- anchors --------------------------------------------------------------------------------------------------------------------------


def _slide(a: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each run of n neighbours."""
    now, k = a, 1
    while 2 * k <= n:
        now, k = f(now[: len(now) - k], now[k:]), 2 * k
    return f(now[: len(a) - n + 1], now[n - k : len(a) - k + 1]) if n > k else now


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes, by doubling."""
    now, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = GRAM
    while left:
        if left & 1:
            out, done = (now, size) if out is None else (out[: len(now) - done] * np.uint64(pow(BASE, size, 1 << 64)) + now[done:], done + size)
        left >>= 1
        if left:
            now, size = now[: len(now) - size] * np.uint64(pow(BASE, size, 1 << 64)) + now[size:], 2 * size
    return np.maximum(mix(out), np.uint64(1))


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of the bytes of documents laid end to end, and the document ends in each: runs of documents, or overlapping pieces of a long one."""
    lo = 0
    ends = offsets[1:]
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, offsets[lo] + SEGMENT, side="right")))
        a, b = int(offsets[lo]), int(ends[hi - 1])
        if hi == lo + 1 and b - a > 2 * SEGMENT:
            for at in range(a, b - WIDTH + 1, SEGMENT):
                yield at, min(b, at + SEGMENT + WIDTH - 1), np.zeros(0, np.int64)
        else:
            yield a, b, ends[lo : hi - 1]
        lo = hi


def _least(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each segment of documents laid end to end: where it begins, its gram hashes, and the anchor hash of each of its strings of WIDTH bytes (0: the
    string crosses documents)."""
    for a, b, inner in segments(offsets):
        if b - a < WIDTH:
            continue
        h = _gram_hashes(data[a:b])
        # Strings that cross documents have no anchor: their smallest hash is 0, which no gram has.
        crosses = np.zeros(len(h) + 1, np.int32)
        edge = np.unique(inner - a)
        np.add.at(crosses, np.maximum(edge - GRAM + 1, 0), 1)
        np.subtract.at(crosses, np.minimum(edge, len(h)), 1)
        h[np.cumsum(crosses[:-1], dtype=np.int32) > 0] = 0
        yield a, h, _slide(h, WIDTH - GRAM + 1, np.minimum)


def _joined(found: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(found) if found else np.zeros(0, kind)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents laid end to end."""
    places, hashes, span = [], [], WIDTH - GRAM + 1
    for a, h, least in _least(data, offsets):
        pad = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), span, np.maximum) == h) & (h > 0))
        places.append(at + a)
        hashes.append(h[at])
    # Pieces of a long document overlap.
    place, once = np.unique(_joined(places, np.int64), return_index=True)
    return place, _joined(hashes, np.uint64)[once]


def anchored(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Starts of the strings of WIDTH bytes whose anchor hash is wanted (ascending, not empty)."""
    found = []
    for a, _, least in _least(data, offsets):
        near = wanted[np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)]
        found.append(np.flatnonzero((near == least) & (least > 0)) + a)
    return np.unique(_joined(found, np.int64))


# --- blocks ---------------------------------------------------------------------------------------------------------------------------


class Block:
    """The documents of a block in a fixed order, their bytes end to end, and which of them are copies."""

    def __init__(self, rows: pa.Table, sides: pa.Table) -> None:
        order = pa.compute.sort_indices(rows, sort_keys=[("ord", "ascending"), ("digest", "ascending")])
        self.rows = rows.take(order)
        self.ord = self.rows["ord"].to_numpy()
        copies = sides.filter(pa.compute.equal(sides["kind"], 0))
        gone = set(zip(copies["ord"].to_pylist(), copies["blob"].to_pylist(), strict=True))
        self.copy = np.array([x in gone for x in zip(self.ord.tolist(), self.rows["digest"].to_pylist(), strict=True)], bool) if gone else np.zeros(len(self.ord), bool)
        self.data, self.offsets = utf8(self.rows["text"])
        size = np.diff(self.offsets)
        # Copies, and texts too short, take no further part; and of rows with the same id and text, one is enough.
        again = np.zeros(len(size), bool)
        digest = self.rows["digest"].to_pylist()
        again[1:] = [a == b and x == y for a, b, x, y in zip(self.ord[1:].tolist(), self.ord[:-1].tolist(), digest[1:], digest[:-1], strict=True)]
        live = ~self.copy & ~again & (size >= WIDTH)
        self.live, self.taken = np.flatnonzero(live), np.repeat(live, size)
        self.bytes, self.bounds = self.data[self.taken], np.concatenate([[0], np.cumsum(size[live])])

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def _parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _distinct(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by part and then value, where each part begins, each hash's row, and how often each occurs."""
    part = _parts_of(h, parts)
    order = np.lexsort((h, part))
    hs, ps = h[order], part[order]
    first = np.ones(len(h), bool)
    first[1:] = hs[1:] != hs[:-1]
    row = np.empty(len(h), np.int64)
    row[order] = np.cumsum(first) - 1
    return hs[first], np.searchsorted(ps[first], np.arange(parts + 1)), row, np.diff(np.append(np.flatnonzero(first), len(h)))


OUT = "part int, kind int, block int, blob binary"


def _rows(part: list[int], kind: int, block: int, blob: list[bytes]) -> pa.Table:
    n = len(part)
    return pa.table([pa.array(part, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "block", "blob"])


def _block_id(rows: pa.Table) -> int:
    return rows["block"][0].as_py()


def sieve_block(rows: pa.Table, sides: pa.Table, parts: int) -> pa.Table:
    """To each part: the block's distinct anchor hashes (48 bits each), with the logarithm of how often they occur and whether several documents have them."""
    if not len(rows):
        return _rows([], 0, 0, [])
    block = Block(rows, sides)
    at, h = anchors(block.bytes, block.bounds)
    distinct, begin, row, times = _distinct(h, parts)
    owner = block.owner(at)
    low, high = np.full(len(distinct), LAST), np.full(len(distinct), -1)
    np.minimum.at(low, row, owner)
    np.maximum.at(high, row, owner)
    code = (np.log2(times).astype(np.uint8) | np.where(high > low, 128, 0).astype(np.uint8)) if len(times) else np.zeros(0, np.uint8)
    top = distinct >> np.uint64(16)
    blobs, used = [], np.flatnonzero(np.diff(begin)).tolist()
    for p in used:
        s = slice(begin[p], begin[p + 1])
        blobs.append((top[s] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (top[s] >> np.uint64(32)).astype("<u2").tobytes() + code[s].tobytes())
    return _rows(used, 0, _block_id(rows), blobs)


def sieve_part(rows: pa.Table) -> pa.Table:
    """To each block: which of its hashes other documents have, and which of them are hot, as bits in the order it sent them."""
    blobs, blocks = rows["blob"].to_pylist(), rows["block"].to_numpy()
    size = np.array([len(b) // 7 for b in blobs])
    key = np.concatenate([np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32) for b, n in zip(blobs, size.tolist(), strict=True)])
    code = np.concatenate([np.frombuffer(b, np.uint8, n, 6 * n) for b, n in zip(blobs, size.tolist(), strict=True)])
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    count = np.diff(np.append(first, len(key)))
    stays = (count > 1) | (np.maximum.reduceat(code[order], first) >= 128)
    hot = stays & (np.add.reduceat(np.int64(1) << (code[order] & 63).astype(np.int64), first) > HOT)
    flags = np.empty((len(key), 2), bool)
    flags[order] = np.repeat(np.stack([stays, hot], axis=1), count, axis=0)
    cut, out, to = np.concatenate([[0], np.cumsum(size)]), [], []
    for k, block in enumerate(blocks.tolist()):
        mine = flags[cut[k] : cut[k + 1]]
        if mine[:, 0].any():
            out.append(np.packbits(mine[:, 0]).tobytes() + np.packbits(mine[:, 1]).tobytes())
            to.append(block)
    part = rows["part"][0].as_py()
    return pa.table([pa.array([part] * len(to), pa.int32()), pa.array([1] * len(to), pa.int32()), pa.array(to, pa.int32()), pa.array(out, pa.binary())], ["part", "kind", "block", "blob"])


def sort_block(rows: pa.Table, sides: pa.Table, parts: int) -> pa.Table:
    """To each part: the surviving anchors with the bytes around them (kind 0), and the distinct strings of hot anchors with their smallest id (kind 1)."""
    answers = {p: b for k, p, b in zip(sides["kind"].to_pylist(), sides["part"].to_pylist(), sides["blob"].to_pylist(), strict=True) if k == 1}
    if not len(rows) or not answers:
        return _rows([], 0, 0, [])
    block = Block(rows, sides)
    at, h = anchors(block.bytes, block.bounds)
    distinct, begin, row, _ = _distinct(h, parts)
    stays, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for p, blob in answers.items():
        n = int(begin[p + 1] - begin[p])
        bits = np.unpackbits(np.frombuffer(blob, np.uint8))
        half = -(-n // 8) * 8
        stays[begin[p] : begin[p + 1]], hot[begin[p] : begin[p + 1]] = bits[:n], bits[half : half + n]
    cold = np.flatnonzero(stays[row] & ~hot[row])
    tables = [_cold_rows(block, at[cold], h[cold], parts, _block_id(rows))]
    if hot.any():
        # Strings of hot anchors that no later step would see otherwise.
        start = anchored(block.bytes, block.bounds, np.sort(distinct[hot]))
        tables += [_hot_rows(block, start[k : k + TOGETHER], parts, _block_id(rows)) for k in range(0, len(start), TOGETHER)]
    return pa.concat_tables(tables)


def _around(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The LEFT bytes before each anchor (nearest first) and the WIDTH bytes from it on, with zeros beyond the document; how many of each are real."""
    owner = block.owner(at)
    before, after = np.minimum(LEFT, at - block.bounds[owner]), np.minimum(WIDTH, block.bounds[owner + 1] - at)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), block.bytes, np.zeros(WIDTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WIDTH)[at]
    left, right = view[:, LEFT - 1 :: -1].copy(), view[:, LEFT:].copy()
    left[np.arange(LEFT) >= before[:, None]] = 0
    right[np.arange(WIDTH) >= after[:, None]] = 0
    return np.concatenate([left, right], axis=1), before, after


def _cold_rows(block: Block, at: np.ndarray, h: np.ndarray, parts: int, number: int) -> pa.Table:
    part = _parts_of(h, parts)
    order = np.argsort(part, kind="stable")
    at, h, part = at[order], h[order], part[order]
    begin = np.searchsorted(part, np.arange(parts + 1))
    ord_ = block.ord[block.live[block.owner(at)]]
    used, blobs = np.flatnonzero(np.diff(begin)).tolist(), []
    for p in used:
        s = slice(begin[p], begin[p + 1])
        around, before, after = _around(block, at[s])
        blobs.append(h[s].astype("<u8").tobytes() + ord_[s].astype("<i8").tobytes() + at[s].astype("<u4").tobytes() + before.astype(np.uint8).tobytes() + after.astype(np.uint8).tobytes() + around.tobytes())
    return _rows(used, 0, number, blobs)


def _hot_rows(block: Block, start: np.ndarray, parts: int, number: int) -> pa.Table:
    strings = np.lib.stride_tricks.sliding_window_view(block.bytes, WIDTH)[start]
    words = big_endian(strings)
    order, common = deep_shallow(words, np.zeros(len(words), np.int64))
    group = np.cumsum(common < WIDTH) - 1
    # Blocks lay documents out by id, so that the first member of a group has its smallest id.
    order = order[np.lexsort((start[order], group))]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    ord_ = block.ord[block.live[block.owner(start[order])]]
    lowest = np.add.reduceat((ord_ == ord_[np.repeat(first, size)]).astype(np.int64), first)
    h = np.zeros(len(first), np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(BASE) + words[order[first], k])
    part = _parts_of(h, parts)
    by = np.argsort(part, kind="stable")
    begin, blobs = np.searchsorted(part[by], np.arange(parts + 1)), []
    used = np.flatnonzero(np.diff(begin)).tolist()
    for p in used:
        g = by[begin[p] : begin[p + 1]]
        member = ragged(first[g], size[g])
        blobs.append(len(g).to_bytes(4, "little") + strings[order[first[g]]].tobytes() + ord_[first[g]].astype("<i8").tobytes() + lowest[g].astype("<u4").tobytes() + size[g].astype("<u4").tobytes() + start[order[member]].astype("<u4").tobytes())
    return _rows(used, 1, number, blobs)


def _answer(part: int, blocks: np.ndarray, block: np.ndarray, at: np.ndarray, places: np.ndarray) -> pa.Table:
    """To each block: positions, and as bits k the strings that start k bytes before them."""
    to, out = [], []
    order = np.argsort(block, kind="stable")
    begin = np.searchsorted(block[order], np.arange(len(blocks) + 1))
    for b in range(len(blocks)):
        mine = order[begin[b] : begin[b + 1]]
        if len(mine):
            to.append(int(blocks[b]))
            out.append(at[mine].astype("<u4").tobytes() + places[mine].astype("<u4").tobytes())
    return pa.table([pa.array([part] * len(to), pa.int32()), pa.array([2] * len(to), pa.int32()), pa.array(to, pa.int32()), pa.array(out, pa.binary())], ["part", "kind", "block", "blob"])


def sort_part(rows: pa.Table) -> pa.Table:
    """The answers for the anchors, or the hot strings, of one part."""
    return _sort_hot(rows) if rows["kind"][0].as_py() else _sort_cold(rows)


def _fields(blobs: list[bytes], size: np.ndarray, kinds: list[tuple[str, int]], head: int = 0) -> list[np.ndarray]:
    """The arrays that the blobs hold one after the other: of each, `width` values for each of its entries."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b, n in zip(blobs, size.tolist(), strict=True):
        at = head
        for k, (kind, width) in enumerate(kinds):
            out[k].append(np.frombuffer(b, kind, n * width, at))
            at += n * width * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _sort_cold(rows: pa.Table) -> pa.Table:
    blobs, blocks = rows["blob"].to_pylist(), rows["block"].to_numpy()
    size = np.array([len(b) // (22 + LEFT + WIDTH) for b in blobs])
    h, ord_, at, before, after, around = _fields(blobs, size, [("<u8", 1), ("<i8", 1), ("<u4", 1), ("u1", 1), ("u1", 1), ("u1", LEFT + WIDTH)])
    block = np.repeat(np.arange(len(blobs)), size)
    by = np.argsort(ord_, kind="stable")
    h, ord_, at, before, after, around, block = h[by], ord_[by], at[by], before[by], after[by], around.reshape(-1, LEFT + WIDTH)[by], block[by]
    n = len(h)
    left_order, left_common = deep_shallow(big_endian(around[:, :LEFT]), h)
    right_order, right_common = deep_shallow(big_endian(around[:, LEFT:]), h)
    places, left, right = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(LEFT + 1):
        whole = np.flatnonzero((before >= k) & (after >= WIDTH - k))
        left[left_order] = np.cumsum(left_common < k)
        right[right_order] = np.cumsum(right_common < WIDTH - k)
        key = left[whole] * (n + 1) + right[whole]
        order = np.argsort(key, kind="stable")
        group = key[order]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        lowest = ord_[whole[order]][np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))] if len(group) else ord_[:0]
        gone = whole[order][ord_[whole[order]] > lowest]
        places[gone] |= 1 << k
    hit = np.flatnonzero(places)
    return _answer(rows["part"][0].as_py(), blocks, block[hit], at[hit], places[hit])


def _sort_hot(rows: pa.Table) -> pa.Table:
    blobs, blocks = rows["blob"].to_pylist(), rows["block"].to_numpy()
    size = np.array([int.from_bytes(b[:4], "little") for b in blobs])
    strings, ord_, lowest, many = _fields(blobs, size, [("u1", WIDTH), ("<i8", 1), ("<u4", 1), ("<u4", 1)], 4)
    block = np.repeat(np.arange(len(blobs)), size)
    members = np.concatenate([np.frombuffer(b, "<u4", -1, 4 + n * (WIDTH + 16)) for b, n in zip(blobs, size.tolist(), strict=True)])
    order, common = deep_shallow(big_endian(strings.reshape(-1, WIDTH)), np.zeros(len(ord_), np.int64))
    group = np.cumsum(common < WIDTH) - 1
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(ord_[order], first)[group]
    skip = np.empty(len(ord_), np.int64)
    skip[order] = np.where(ord_[order] == least, lowest[order], 0)
    many = many.astype(np.int64)
    begin = np.cumsum(many) - many
    at = members[ragged(begin + skip, many - skip)]
    return _answer(rows["part"][0].as_py(), blocks, np.repeat(block, many - skip), at, np.ones(len(at), np.int64))


def cut_block(rows: pa.Table, sides: pa.Table) -> pa.Table:
    """doc_id, n_bytes, spans and kept bytes of the block's documents; and, where something is carried along, the text that is left of those that are cut, and that."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    more = "carried" in rows.column_names
    names = ["doc_id", "n_bytes", "spans", "kept", *(["kept_text", "carried"] if more else [])]
    if not len(rows):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], span), pa.array([], pa.binary()), *([pa.array([], pa.string()), rows["carried"]] if more else [])], names)
    block = Block(rows, sides)
    edge = np.zeros(len(block.bytes) + 1, np.int32)
    for kind, blob in zip(sides["kind"].to_pylist(), sides["blob"].to_pylist(), strict=True):
        if kind == 2:
            n = len(blob) // 8
            at, places = np.frombuffer(blob, "<u4", n).astype(np.int64), np.frombuffer(blob, "<u4", n, 4 * n)
            for k in range(LEFT + 1):
                start = at[(places >> np.uint32(k)) & np.uint32(1) == 1] - k
                np.add.at(edge, start, 1)
                np.subtract.at(edge, start + WIDTH, 1)
    size = np.diff(block.offsets)
    gone = np.repeat(block.copy & (size >= WIDTH), size)
    gone[block.taken] = np.cumsum(edge[:-1], dtype=np.int32) > 0
    digest = block.rows["digest"].to_pylist()
    for k in range(1, len(size)):  # rows with the same id and text are cut alike
        if block.ord[k] == block.ord[k - 1] and digest[k] == digest[k - 1]:
            gone[block.offsets[k] : block.offsets[k + 1]] = gone[block.offsets[k - 1] : block.offsets[k]]
    spans, kept = [], []
    data = block.data
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        mine = gone[a:b]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        spans.append([{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
        kept.append(data[a:b][~mine].tobytes() if len(turn) else data[a:b].tobytes())
    left = [pa.array([k.decode("utf-8", "ignore") if s else None for k, s in zip(kept, spans, strict=True)], pa.string()), block.rows["carried"]] if more else []
    return pa.table([block.rows["doc_id"].combine_chunks(), pa.array(size), pa.array(spans, span), pa.array(kept, pa.binary()), *left], names)


# --- the operator ---------------------------------------------------------------------------------------------------------------------


def _by_part(frame: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """work() for the rows of each key, one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cut = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
            if held and len(values) and [held[0][k][0].as_py() for k in keys] != values[0].tolist():
                yield work(pa.concat_tables(held))
                held = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                held.append(table.slice(a, b - a))
                if b < len(values):
                    yield work(pa.concat_tables(held))
                    held = []
        if held:
            yield work(pa.concat_tables(held))

    return over_batches(frame.repartition(*keys).sortWithinPartitions(*keys), run, OUT)


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, part_anchors: int = PART, carried: str | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each removed run of bytes) and kept (the other bytes) of each document; and, if a column is to be
    carried along, that as `carried`, and kept_text: of documents that lose bytes, the text left, without characters of which only a part is."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("ord"), body.alias("text"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.octet_length(body).alias("size"), *([F.col(carried).alias("carried")] if carried else []))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    blocks, parts = 1 + total // block_bytes, 1 + int(total * 2 / (WIDTH - GRAM + 2)) // part_anchors
    rows = rows.withColumn("block", F.pmod(F.xxhash64("ord", "digest"), F.lit(blocks)).cast("int"))
    # All copies but those with the smallest id. Neither side holds texts.
    small = rows.select("ord", "digest", "size", "block")
    first = small.groupBy("digest", "size").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = small.join(first, ["digest", "size"]).where(F.col("ord") > F.col("first")).select(F.lit(0).alias("part"), F.lit(0).alias("kind"), "block", F.col("digest").alias("blob"), "ord").distinct()
    held = rows.select("block", "doc_id", "ord", "text", "digest", *(["carried"] if carried else [])).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").groupBy("block")

    def beside(sides: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
        own = [F.col(c).alias(c) for c in ("part", "kind", "block", "blob", "ord")]  # columns of its own, not those of `held`

        def block(rows: pa.Table, beside_it: pa.Table) -> pa.Table:
            out = work(rows, beside_it)
            release()
            return out

        return held.cogroup(sides.select(*own).groupBy("block")).applyInArrow(block, schema)

    def answers(frame: DataFrame) -> DataFrame:
        return frame.withColumn("ord", F.lit(None).cast("long"))

    hashes = beside(copies, lambda a, b: sieve_block(a, b, parts), OUT)
    sieved = answers(_by_part(hashes, ["part"], sieve_part))
    met = beside(copies.unionByName(sieved), lambda a, b: sort_block(a, b, parts), OUT)
    found = answers(_by_part(met, ["part", "kind"], sort_part))
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return beside(copies.unionByName(found), cut_block, schema.add("kept_text", "string").add("carried", documents.schema[carried].dataType) if carried else schema)
