"""FLAC as a media column: lossless 8-bit mono streams written and read with array operations over many frames at a time.

Encoding chooses, for each frame of BLOCK samples, the predictor (fixed, of order 0 to 4, or linear, of order LINEAR, with coefficients from the frame's
autocorrelation) and the Rice parameter that need the fewest bits, or a verbatim or constant subframe where that is smaller. Streams carry STREAMINFO (with the MD5 of the samples)
and a seek table. Decoding parses the metadata and frame headers, checks CRC-8 and CRC-16 of each frame, decodes Rice residuals and restores
fixed or LPC prediction, in lockstep over the frames of a batch, checks the MD5, and yields PCM blocks with their first sample's number and
their byte offset in the stream, which is what seeking needs.

The sample of a byte b is b - 128. Layout and codes are those of the published format specification (RFC 9639).

Defined results: a null or empty text is one payload of spaces; payloads are padded with spaces to a positive multiple of UNIT bytes; equal
texts give equal streams; very long texts have more frames; repeated rows each get their row; other columns are ignored; an empty table gives an
empty result. A stream that is damaged raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.spans import groups_of, over_batches, ragged, utf8

#: Payloads are multiples of UNIT bytes; frames have BLOCK samples; RATE is nominal; a seek point stands at each SEEK-th frame.
UNIT, BLOCK, RATE, SEEK = 192, 1152, 8000, 8
#: Samples that a task encodes or decodes together.
TOGETHER = 1 << 20
ORDERS = 5
#: The order of linear predictors, and the bits of their coefficients.
LINEAR, PRECISION = 4, 8
COEFFICIENTS = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial) if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each of the ranges of data, in lockstep."""
    order = np.argsort(-sizes, kind="stable")
    starts, counts = starts[order], np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")
    c, n = np.zeros(len(sizes), np.uint32), len(sizes)
    for t, shorter in enumerate(counts.tolist()):
        m = n - shorter
        c[:m] = ((c[:m] << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(c[:m] >> np.uint32(8)) ^ data[starts[:m] + t]]
    out = np.empty(n, np.uint32)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([(0x100 - 2 * limit) & 0xFF | n, *reversed(tail)])
        limit >>= 1


def _header(number: int, size: int) -> bytes:
    code = 0b0011 if size == BLOCK else 0b0111
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0000_001_0]) + _number(number) + (b"" if size == BLOCK else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


@dataclass
class Frames:
    """Frames of several streams laid end to end: each one's stream, number there, first sample and size."""

    stream: np.ndarray
    number: np.ndarray
    start: np.ndarray
    size: np.ndarray


def frames_of(sizes: np.ndarray) -> Frames:
    n = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[stream] + number * BLOCK
    return Frames(stream, number, start, np.minimum(BLOCK, sizes[stream] - number * BLOCK))


def _linear(samples: np.ndarray, frames: Frames, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each frame: quantised coefficients (nearest sample first), their shift and whether the predictor can be used; and the folded residuals, 0 for the first samples."""
    x, count = samples.astype(np.int32), len(frames.size)
    lagged = [x]
    for j in range(1, LINEAR + 1):
        past = np.concatenate([np.zeros(j, np.int32), x[:-j]])[: len(x)]
        for t in range(j):
            past[frames.start[frames.size > t] + t] = 0
        lagged.append(past)
    r = [np.add.reduceat(x * past, frames.start, dtype=np.int64).astype(np.float64) for past in lagged]
    # Levinson's recursion, for all frames at once.
    error, a = np.where(r[0] > 0, r[0], 1.0), np.zeros((count, LINEAR))
    for i in range(LINEAR):
        reflect = (r[i + 1] - (a[:, :i] * np.stack(r[i:0:-1], axis=1)).sum(axis=1) if i else r[1]) / error
        a[:, :i] -= reflect[:, None] * a[:, :i][:, ::-1]
        a[:, i] = reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    most, top = np.abs(a).max(axis=1), (1 << (PRECISION - 1)) - 1
    shift = np.where(most < top / 64, 6, 5)
    weight = np.clip(np.rint(a * (1 << shift)[:, None]), -top, top).astype(np.int32)
    usable = (r[0] > 0) & (most < top / 32) & (frames.size > 2 * LINEAR)
    guess = np.zeros(len(x), np.int32)
    for j in range(LINEAR):
        guess += weight[:, j][owner] * lagged[j + 1]
    residual = x - (guess >> shift.astype(np.int32)[owner])
    folded = (residual << 1) ^ (residual >> 31)
    for t in range(LINEAR):
        folded[frames.start[frames.size > t] + t] = 0
    return weight, shift, usable, folded


def encode_frames(samples: np.ndarray, frames: Frames) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all frames end to end, and the size in bytes of each."""
    count = len(frames.size)
    owner = np.repeat(np.arange(count, dtype=np.int32), frames.size)
    # Bits of each predictor with the Rice parameter that the sum of its residuals suggests; the first samples of a frame stay as they are.
    folds, residual = [], samples.astype(np.int16)
    best, best_order, best_k = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for order in range(ORDERS):
        if order:
            residual = residual - np.concatenate([np.zeros(1, np.int16), residual[:-1]])
        folded = ((residual << 1) ^ (residual >> 15)).astype(np.int32)
        for t in range(order):
            folded[frames.start[frames.size > t] + t] = 0
        folds.append(folded)
        sums, n = np.add.reduceat(folded, frames.start, dtype=np.int64), frames.size - order
        for k in range(9):
            bits = (sums >> k) + n * (k + 1) + 8 * order + 10
            better = (bits < best) & (n > 0)
            best[better], best_order[better], best_k[better] = bits[better], order, k
    weight, shift, usable, folded = _linear(samples, frames, owner)
    folds.append(folded)
    sums, about = np.add.reduceat(folded, frames.start, dtype=np.int64), 9 + PRECISION * LINEAR
    for k in range(9):
        bits = (sums >> k) + (frames.size - LINEAR) * (k + 1) + 8 * LINEAR + 10 + about
        better = usable & (bits < best)
        best[better], best_order[better], best_k[better] = bits[better], ORDERS, k
    flat = np.maximum.reduceat(samples, frames.start) == np.minimum.reduceat(samples, frames.start)
    verbatim = ~flat & (best >= 8 * frames.size)
    rice = ~flat & ~verbatim
    # Each sample's code: `zeros` zero bits, then `width` bits of `value`.
    zeros, width, value = np.zeros(len(samples), np.int32), np.full(len(samples), 8, np.int32), samples.view(np.uint8).astype(np.int32)
    place = np.arange(len(samples), dtype=np.int32) - np.repeat(frames.start.astype(np.int32), frames.size)
    k_of, order_of = best_k.astype(np.int32)[owner], np.where(rice, best_order, -1).astype(np.int8)[owner]
    warm_up = [*range(ORDERS), LINEAR]
    for order in range(ORDERS + 1):
        at = np.flatnonzero((order_of == order) & (place >= warm_up[order]))
        folded, k = folds[order][at], k_of[at]
        zeros[at], width[at], value[at] = folded >> k, k + 1, (folded & ((1 << k) - 1)) | 1 << k
    width[flat[owner] & (place > 0)] = 0
    # What stands before the samples: header and subframe header; and, after the warm-up, the residual's coding method and parameter.
    heads = [_header(n, s) for n, s in zip(frames.number.tolist(), frames.size.tolist(), strict=True)]
    linear = rice & (best_order == ORDERS)
    kind = np.where(flat, 0, np.where(verbatim, 1, np.where(linear, 31 + LINEAR, 8 + best_order))) << 1
    head_bits = np.fromiter(map(len, heads), np.int64, count) * 8 + 8
    extra = np.where(rice, 10, 0) + np.where(linear, about, 0)
    size = zeros + width
    body = np.add.reduceat(size, frames.start)
    total = (head_bits + extra + body + 7) // 8 + 2
    first = (np.cumsum(total) - total) * 8
    warm = np.where(rice, np.asarray(warm_up)[best_order], 0)
    inside = np.cumsum(size) - size
    at = first[owner] + head_bits[owner] + inside - inside[frames.start][owner] + np.where(place >= warm[owner], extra[owner], 0)
    bits = np.zeros(int(total.sum()) * 8, np.uint8)
    end = at + size - 1
    for j in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > j)
        bits[end[has] - j] = (value[has] >> j) & 1
    coded = np.flatnonzero(linear)
    where = first[coded] + head_bits[coded] + 8 * LINEAR
    for offset, wide, number in ((0, 4, np.full(count, PRECISION - 1)), (4, 5, shift), *((9 + PRECISION * t, PRECISION, weight[:, t]) for t in range(LINEAR))):
        for j in range(wide):
            bits[where + offset + j] = (number[coded] >> (wide - 1 - j)) & 1
    coded = np.flatnonzero(rice)
    where = first[coded] + head_bits[coded] + 8 * warm[coded] + (extra[coded] - 10) + 2 + 4  # method 0, no further partitions
    for j in range(4):
        bits[where + j] = (best_k[coded] >> (3 - j)) & 1
    out = np.packbits(bits)
    raw = np.frombuffer(b"".join(heads), np.uint8)
    length = head_bits // 8 - 1
    out[ragged(first // 8, length)] = raw
    out[first // 8 + length] = kind
    crc = crc16(out, first // 8, total - 2)
    out[first // 8 + total - 2], out[first // 8 + total - 1] = crc >> 8, crc & 0xFF
    return out, total


def encode(payloads: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The streams of payloads (bytes laid end to end)."""
    samples, frames = (payloads ^ np.uint8(0x80)).view(np.int8), frames_of(sizes)
    coded, length = encode_frames(samples, frames)
    data, ends, cut = coded.tobytes(), np.cumsum(length), np.cumsum(sizes)
    bounds = np.searchsorted(frames.stream, np.arange(len(sizes) + 1))
    out = []
    for s, n in enumerate(sizes.tolist()):
        a, b = int(bounds[s]), int(bounds[s + 1])
        size, begin = length[a:b], int(ends[a] - length[a])
        md5 = hashlib.md5(samples[cut[s] - n : cut[s]].tobytes()).digest()
        block = max(BLOCK, 16)
        info = block.to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + md5
        at = ends[a:b] - size - begin
        seek = b"".join((k * BLOCK).to_bytes(8, "big") + int(at[k]).to_bytes(8, "big") + min(BLOCK, n - k * BLOCK).to_bytes(2, "big") for k in range(0, b - a, SEEK))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[begin : int(ends[b - 1])])
    return out


@dataclass
class Stream:
    """A stream's metadata, and where its frames begin."""

    samples: int
    block: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    begin: int


def metadata(stream: bytes) -> Stream:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out, last = 4, Stream(0, 0, b"", [], 0), False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            fields = int.from_bytes(body[10:18], "big")
            if (fields >> 36 & 31) != 7 or (fields >> 41 & 7):
                raise ValueError("only 8-bit mono is read")
            out.samples, out.block, out.md5 = fields & ((1 << 36) - 1), int.from_bytes(body[0:2], "big"), body[18:34]
        elif kind == 3:
            out.seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    out.begin = at
    return out


def _frame_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Number, samples and header bytes of the frame that begins at `at`; checks its CRC-8."""
    if data[at] != 0xFF or data[at + 1] not in (0xF8, 0xF9):
        raise ValueError("no frame where one must begin")
    code, p = data[at + 2] >> 4, at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for b in data[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if code == 6:
        size, p = data[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("a frame header is damaged")
    return number, size, p + 1 - at


def _found_frames(joined: bytes, data: np.ndarray, infos: list[Stream], base: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Header fields, position and stream of each frame of each stream."""
    sync = np.flatnonzero((data[:-1] == 0xFF) & ((data[1:] & 0xFE) == 0xF8))
    ends = np.append(base[1:], len(joined))
    heads, where, owner = [], [], []
    for s, info in enumerate(infos):
        lo, hi = np.searchsorted(sync, [base[s] + info.begin, ends[s]])
        due, left = 0, info.samples
        for at in sync[lo:hi].tolist():
            try:
                head = _frame_header(joined, at)
            except (ValueError, IndexError):
                continue
            if head[0] == due and head[1] == min(info.block, left):
                heads.append(head)
                where.append(at)
                owner.append(s)
                due, left = due + 1, left - head[1]
        if left:
            raise ValueError("frames are missing")
    return heads, np.array(where, np.int64), np.array(owner, np.int64)


def _bits(window: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Unsigned values of up to 24 bits at bit positions. window: the 32 bits from each byte on."""
    shifted = (window[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return np.where(np.asarray(width) > 0, shifted >> (32 - np.asarray(width)).astype(np.uint64), 0).astype(np.int64)


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """Samples (int8) of the streams laid end to end, how many each has, and of each its PCM blocks (first sample, samples, byte offset).

    Frames follow each other without a length. They are found by their sync code, header CRC and running number, decoded together, and each must
    end where the next begins.
    """
    infos = [metadata(s) for s in streams]
    joined = b"".join(streams)
    data = np.concatenate([np.frombuffer(joined, np.uint8), np.zeros(8, np.uint8)])
    wide = data.astype(np.uint64)
    window = wide[:-3] << np.uint64(24) | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(8) | wide[3:]
    ones = np.flatnonzero(np.unpackbits(data)).astype(np.int32 if len(data) < 1 << 27 else np.int64)  # a unary code ends at the next one bit
    upto = np.concatenate([[0], np.cumsum(_POPCOUNT[data])])
    base = np.cumsum([0, *map(len, streams)])[:-1]
    sizes = np.array([i.samples for i in infos], np.int64)
    out = np.zeros(int(sizes.sum()), np.int32)
    place = np.cumsum(sizes) - sizes
    heads, where, owner = _found_frames(joined, data, infos, base)
    n, head, number = (np.array([h[k] for h in heads], np.int64) for k in (1, 2, 0))
    kind = (data[where + head] >> 1) & 63
    first = place[owner] + number * np.array([i.block for i in infos], np.int64)[owner]
    bit = _subframes(data, window, ones, upto, (where + head + 1) * 8, kind, n, out, first)
    length = (bit + 7) // 8 - where
    want = data[where + length].astype(np.uint32) << np.uint32(8) | data[where + length + 1]
    ends = np.append(where[1:], len(joined))
    ends[:-1] = np.where(owner[1:] == owner[:-1], ends[:-1], np.append(base[1:], len(joined))[owner[:-1]])
    if (where + length + 2 != ends).any() or (crc16(data, where, length) != want).any():
        raise ValueError("a frame is damaged")
    blocks: list[list[tuple[int, int, int]]] = [[] for _ in streams]
    for s, f, m, o in zip(owner.tolist(), (first - place[owner]).tolist(), n.tolist(), (where - base[owner]).tolist(), strict=True):
        blocks[s].append((f, m, o))
    samples = out.astype(np.int8)
    for s, info in enumerate(infos):
        if hashlib.md5(samples[place[s] : place[s] + sizes[s]].tobytes()).digest() != info.md5:
            raise ValueError("the samples are not those of the stream's MD5")
    return samples, sizes, blocks


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return (v ^ half) - half


def _subframes(data, window, ones, upto, bit, kind, n, out, place) -> np.ndarray:
    """Decode one subframe for each frame into out[place:]; returns the bit after each."""
    bit = bit.copy()
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(constant):
        value = _signed(_bits(window, bit[constant], 8), 8)
        out[ragged(place[constant], n[constant])] = np.repeat(value, n[constant])
        bit[constant] += 8
    if len(verbatim):
        # The subframe header is a byte, so verbatim samples are whole bytes.
        out[ragged(place[verbatim], n[verbatim])] = data[ragged(bit[verbatim] >> 3, n[verbatim])].view(np.int8)
        bit[verbatim] += 8 * n[verbatim]
    coded = np.flatnonzero(kind >= 8)
    coded = coded[np.argsort(-n[coded], kind="stable")]
    if not len(coded):
        return bit
    lpc = kind[coded] >= 32
    if ((kind[coded] > 12) & ~lpc).any():
        raise ValueError("a reserved kind of subframe")
    order = np.where(lpc, kind[coded].astype(np.int64) - 31, kind[coded].astype(np.int64) - 8)
    pos, size, at = bit[coded], n[coded], place[coded]
    for t in range(int(order.max(initial=0))):
        has = np.flatnonzero(order > t)
        out[at[has] + t] = _signed(_bits(window, pos[has], 8), 8)
        pos[has] += 8
    # Predictors: coefficients of the nearest sample first, and a right shift.
    weight, shift = np.zeros((len(coded), max(4, int(order.max(initial=0)))), np.int64), np.zeros(len(coded), np.int64)
    for o in range(ORDERS):
        weight[(order == o) & ~lpc, :o] = COEFFICIENTS[o]
    f = np.flatnonzero(lpc)
    precision = np.zeros(len(coded), np.int64)
    precision[f], shift[f] = _bits(window, pos[f], 4) + 1, _signed(_bits(window, pos[f] + 4, 5), 5)
    pos[f] += 9
    for t in range(int(order[f].max(initial=0))):
        has = f[order[f] > t]
        weight[has, t] = _signed(_bits(window, pos[has], precision[has]), precision[has])
        pos[has] += precision[has]
    method, parts = _bits(window, pos, 2), np.int64(1) << _bits(window, pos + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    bits_k = 4 + method
    pos = pos + 6
    in_part = size // parts
    k, escape = np.zeros(len(coded), np.int64), np.zeros(len(coded), bool)
    active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")
    whole, late, mask = not (parts > 1).any(), int(order.max()), (np.uint64(1) << np.arange(32, dtype=np.uint64)) - np.uint64(1)
    for t in range(int(size.max())):
        m = int(active[t])
        i = slice(0, m)
        if t > late and whole and not escape.any():  # the common case, in as few operations as it can be done
            p, kk = pos[i], k[i]
            byte = p >> 3
            one = ones[upto[byte] + _POPCOUNT[data[byte] >> (8 - (p & 7)).astype(np.uint8)]].astype(np.int64)
            after = one + 1 + kk
            rest = (window[(one + 1) >> 3] >> (32 - kk - ((one + 1) & 7)).astype(np.uint64) & mask[kk]).astype(np.int64)
            folded = ((one - p) << kk) | rest
            pos[i] = after
            out[at[i] + t] = (folded >> 1) ^ -(folded & 1)
            continue
        if t == 0 or (parts[i] > 1).any():
            fresh = np.flatnonzero((t % in_part[i] == 0) & (t < size[i])) if t else np.arange(m)
            if len(fresh):
                k[fresh] = _bits(window, pos[fresh], bits_k[fresh])
                pos[fresh] += bits_k[fresh]
                escape[fresh] = k[fresh] == (1 << bits_k[fresh]) - 1
                raw = fresh[escape[fresh]]
                if len(raw):
                    k[raw] = _bits(window, pos[raw], 5)
                    pos[raw] += 5
        now = t >= order[i]
        full = bool(now.all()) and not escape[i].any()
        f = np.arange(m) if full else np.flatnonzero(now & ~escape[i])
        if len(f):
            p, kk = pos[f], k[f]
            byte = p >> 3
            skip = upto[byte] + _POPCOUNT[data[byte] >> (8 - (p & 7)).astype(np.uint8)]
            one = ones[skip].astype(np.int64)
            folded = ((one - p) << kk) | _bits(window, one + 1, kk)
            pos[f] = one + 1 + kk
            out[at[f] + t] = (folded >> 1) ^ -(folded & 1)
        if not full and len(raw := np.flatnonzero(now & escape[i])):
            has = raw[k[raw] > 0]
            out[at[raw] + t] = 0
            out[at[has] + t] = _signed(_bits(window, pos[has], k[has]), k[has])
            pos[raw] += k[raw]
    _restore(out, at, size, order, weight, shift, lpc)
    bit[coded] = pos
    return bit


_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.int64)


def _restore(out, at, size, order, weight, shift, lpc) -> None:
    """Add the predictions to the residuals in out[at:at + size], frame by frame in lockstep; frames come longest first."""
    rows = np.flatnonzero(order > 0)
    if not len(rows):
        return
    at, size, order, weight, shift = at[rows], size[rows], order[rows], weight[rows], shift[rows]
    active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")
    if (shift < 0).any():
        raise ValueError("a negative shift")
    reach = weight.shape[1]
    for t in range(1, min(reach, int(size.max()))):
        f = np.arange(int(active[t]))
        f = f[order[f] <= t]
        total = np.zeros(len(f), np.int64)
        for j in range(weight.shape[1]):
            use = order[f] > j
            total[use] += weight[f[use], j] * out[at[f[use]] + t - 1 - j]
        out[at[f] + t] += total >> shift[f]
    if int(size.max()) <= reach:
        return
    # From here on all frames have as many samples before this one as any predictor takes. The latest ones are kept at hand.
    by, right = np.ascontiguousarray(weight.T, np.int32), shift.astype(np.int32)
    m = int(active[reach])
    near = [out[at[:m] + reach - 1 - j] for j in range(reach)]
    for t in range(reach, int(size.max())):
        m = int(active[t])
        place, total = at[:m] + t, by[0, :m] * near[0][:m]
        for j in range(1, reach):
            total += by[j, :m] * near[j][:m]
        new = out[place] + (total >> right[:m])
        out[place] = new
        near = [new, *near[:-1]]


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each padded with spaces to a positive multiple of UNIT bytes; and the padded sizes."""
    size = np.diff(offsets)
    padded = np.maximum(1, -(-size // UNIT)) * UNIT
    out = np.full(int(padded.sum()), 32, np.uint8)
    out[ragged(np.cumsum(padded) - padded, size)] = data
    return out, padded


def media(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, stream (the FLAC file), payload (read back from it), blocks (first sample, samples, byte offset) and feature of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("samples", pa.int32()), ("byte_offset", pa.int64())]))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups_of(np.diff(offsets) + UNIT, TOGETHER):
                body, sizes = payloads(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                streams = encode(body, sizes)
                samples, read, blocks = decode(streams)
                back = (samples.view(np.uint8) ^ np.uint8(0x80)).tobytes()
                cut = np.concatenate([[0], np.cumsum(read)])
                spread = samples.astype(np.float64)
                power = np.add.reduceat(spread * spread, cut[:-1]) / read
                crossing = np.concatenate([[False], (samples[1:] < 0) != (samples[:-1] < 0)])
                crossing[cut[:-1]] = False
                crossings = np.add.reduceat(crossing.astype(np.int64), cut[:-1])
                feature = [f"rms={np.sqrt(p):.4f};crossings={c};peak={k}" for p, c, k in zip(power, crossings, np.maximum.reduceat(np.abs(samples.astype(np.int16)), cut[:-1]), strict=True)]
                payload = [back[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                listed = pa.array([[{"first_sample": f, "samples": n, "byte_offset": o} for f, n, o in b] for b in blocks], kind)
                yield pa.table([batch.column(0).slice(lo, hi - lo), pa.array(offsets[lo + 1 : hi + 1] - offsets[lo:hi]), pa.array(streams, pa.binary()), pa.array(payload, pa.binary()), listed, pa.array(feature)], ["doc_id", "n_bytes", "stream", "payload", "blocks", "feature"])

    schema = "doc_id long, n_bytes long, stream binary, payload binary, blocks array<struct<first_sample: long, samples: int, byte_offset: long>>, feature string"
    return over_batches(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, schema)
