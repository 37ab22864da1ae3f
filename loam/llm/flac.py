"""FLAC in numpy: frames of many streams are coded and decoded in step, one lane for each frame.

The decoder reads one to eight channels of up to 24 bits (stereo as left and right, or with a side or mid channel),
constant, verbatim, fixed and linear-predictor subframes, Rice residuals of both kinds with partitions and escapes. It
verifies frame headers (CRC-8), frames (CRC-16), the frames' numbers, and whole streams (MD5). Frames are found by seek
points where these name every frame, and else by sync code, header checksum, number and frame checksum.

The encoder writes mono streams of 8-bit samples in blocks of BLOCK samples, with a seek point for every frame: the
cheapest of constant, fixed predictors of order 0 to 2 and a linear predictor of order ORDER from the frame's
autocorrelation, its residual in one Rice partition or in eight, whichever is shorter.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.bpe import parts
from loam.llm.common import lean, table

BLOCK, RATE = 1024, 8000
#: Payload bytes, frames that are decoded in step, and frames that are coded together in a worker: these bound its memory,
#: whatever a text's length.
TOGETHER, LANES, TOGETHER_CODED = 2_000_000, 1024, 256
#: The encoder's linear predictor: order, bits of a coefficient, largest shift; and its residual's partitions (2^PARTS).
ORDER, PRECISION, SHIFT, PARTS = 4, 10, 12, 3
#: Fixed predictors' coefficients, newest sample first (fixed values).
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Block sizes and bits a sample by their codes in a frame header (fixed values; 0: elsewhere, -1: reserved).
BLOCK_SIZES = np.array([-1, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
SAMPLE_BITS = np.array([0, 8, 12, -1, 16, 20, 24, 32])


class FlacError(ValueError):
    """A stream that is damaged, or of a kind that is not read here."""


def crc_table(polynomial: int, width: int, bits: int = 8) -> np.ndarray:
    """The checksums of all numbers of so many bits."""
    values = np.arange(1 << bits, dtype=np.int64) << (width - bits)
    for _ in range(bits):
        values = np.where(values >> (width - 1) & 1, values << 1 ^ polynomial, values << 1) & ((1 << width) - 1)
    return values


CRC8, CRC16, CRC16_PAIR = crc_table(0x07, 8), crc_table(0x8005, 16), crc_table(0x8005, 16, 16).astype(np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of data, all spans stepped together by two bytes, longest first so that the ended drop out."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    low, high = int(starts.min()), int((starts + lengths).max())
    own = np.concatenate([data[low:high], np.zeros(2, np.uint8)]).astype(np.uint16)
    pairs = own[:-1] << np.uint16(8) | own[1:]
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order] - low, lengths[order]
    state = np.zeros(len(order), dtype=np.uint16)
    alive = np.searchsorted(-left, -np.arange(2, left[0] + 1, 2), side="right")
    for step, n in enumerate(alive.tolist()):
        state[:n] = CRC16_PAIR[state[:n] ^ pairs[at[:n] + 2 * step]]
    odd = np.flatnonzero(left % 2)
    s = state[odd].astype(np.int64)
    state[odd] = (CRC16[s >> 8 ^ own[at[odd] + left[odd] - 1]] ^ (s & 0xFF) << 8).astype(np.uint16)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = state
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in FLAC's variable-length code."""
    if n < 0x80:
        return bytes([n])
    extra = 1
    while n >= 1 << (6 * extra + 6 - extra):
        extra += 1
    lead = (0xFF << (7 - extra)) & 0xFF
    return bytes([lead | n >> 6 * extra, *((0x80 | n >> 6 * k & 0x3F) for k in range(extra - 1, -1, -1))])


# --- encoder


def frame_headers(lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The headers' bytes, a row each, with their CRC-8, and their sizes."""
    codes = [utf8_number(n) for n in numbers.tolist()]
    sizes = np.array([len(c) for c in codes]) + 7
    out = np.zeros((len(codes), 14), dtype=np.uint8)
    out[:, :4] = [0xFF, 0xF8, 0x70, 0x02]
    lanes = np.arange(len(codes))
    for k in range(int(sizes.max()) - 7):
        out[:, 4 + k] = [c[k] if k < len(c) else 0 for c in codes]
    out[lanes, sizes - 3], out[lanes, sizes - 2] = (lengths - 1) >> 8, (lengths - 1) & 0xFF
    crc = np.zeros(len(codes), dtype=np.int64)
    for k in range(int(sizes.max()) - 1):
        crc = np.where(k < sizes - 1, CRC8[crc ^ out[:, k]], crc)
    out[lanes, sizes - 1] = crc
    return out, sizes


def linear_predictors(x: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (newest sample first) and shifts from each lane's autocorrelation (Levinson's recursion). Sums
    are exact (of 8-bit samples, 2^24 at most in blocks of 1024), so that a lane's result does not depend on the others."""
    y = x.astype(np.float32 if x.shape[1] <= 1024 else np.float64)
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : y.shape[1] - k]) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(ORDER):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    a = np.where(np.isfinite(a) & able[:, None], a, 0)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(axis=1), 1e-3))), 0, SHIFT).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int32), shift


def rice_parameter(total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A good Rice parameter for residuals of a sum, and about the bits that it takes."""
    mean = total / np.maximum(count, 1)
    k = np.clip(np.round(np.log2(np.maximum(mean * np.log(2), 1))), 0, 14).astype(np.int64)
    return k, count * (k + 1) + (total.astype(np.int64) >> k)


def encode_frames(samples: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the sample spans (int8), as bytes end to end, and the size of each."""
    n, width = len(starts), int(lengths.max())
    place = np.arange(width)
    inside = place < lengths[:, None]
    x = np.where(inside, samples[np.minimum(starts[:, None] + place, len(samples) - 1)], 0).astype(np.int32)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)

    residuals, costs = [x], []
    for _ in range(2):
        residuals.append(np.diff(residuals[-1], axis=1, prepend=0))
    able = (lengths >= 8 * ORDER) & ~constant
    coefficients, shift = linear_predictors(x, able)
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, j + 1 :] += coefficients[:, j : j + 1] * x[:, : width - j - 1]
    residuals.append(x - (guess >> shift[:, None].astype(np.int32)))
    warm_ups = np.array([0, 1, 2, ORDER])
    for r, w in zip(residuals, warm_ups, strict=True):
        costs.append(np.abs(np.where(inside[:, w:], r[:, w:], 0)).sum(axis=1, dtype=np.int64))
    costs[1][lengths <= 2], costs[2][lengths <= 2], costs[3][~able] = 1 << 40, 1 << 40, 1 << 40
    kind = np.argmin(np.stack(costs), axis=0)  # 0 to 2: fixed predictors, 3: linear
    order, linear = warm_ups[kind], kind == 3
    residual = np.choose(kind[:, None], residuals)
    coded = inside & (place >= order[:, None]) & ~constant[:, None]
    folded = np.where(coded, residual << 1 ^ residual >> 31, 0)

    # Rice parameters of eight partitions, or one
    many = 1 << PARTS
    split = (lengths % many == 0) & (lengths // many > order)
    span = np.where(split, lengths // many, width + 1)
    part = np.minimum(place // span[:, None], many - 1)
    cell = (np.arange(n)[:, None] * many + part).ravel()
    total = np.bincount(cell, folded.ravel(), minlength=n * many).reshape(n, many)
    count = np.bincount(cell[coded.ravel()], minlength=n * many).reshape(n, many)
    k_each, bits_each = rice_parameter(total, count)
    k_one, bits_one = rice_parameter(total.sum(axis=1), count.sum(axis=1))
    split &= bits_each.sum(axis=1) + 4 * many < bits_one + 4
    k_each = np.where(split[:, None], k_each, k_one[:, None])
    k = np.take_along_axis(k_each, part, axis=1)
    begins = coded & (((place % span[:, None] == 0) & split[:, None]) | (place == order[:, None]))
    quotient = folded >> k
    code = np.where(coded, quotient + 1 + k, 0)
    # bits after the header: subframe header 8; constant: 8; warm-up 8 each; linear: 4 + 5 + coefficients; method and partitions 6
    prologue = np.where(constant, 16, 14 + 8 * order + linear * (9 + ORDER * PRECISION))
    ends = prologue[:, None] + np.cumsum(code + 4 * begins, axis=1)
    heads, head_size = frame_headers(lengths, numbers)
    body = (np.where(constant, 16, ends[:, -1]) + 7) // 8
    sizes = head_size + body + 2
    begin = np.cumsum(sizes) - sizes
    at = (begin + head_size) * 8
    words = np.zeros(int(sizes.sum()) // 4 + 3, dtype=np.uint64)

    def put(where: np.ndarray, values: np.ndarray, width: np.ndarray | int) -> None:
        """Values of so many bits at bit places, of which no two are in one word of 32 bits."""
        shifted = (values.astype(np.int64) & ((1 << np.asarray(width)) - 1)).astype(np.uint64) << (64 - (where & 31) - width).astype(np.uint64)
        words[where >> 5] |= shifted >> np.uint64(32)
        words[(where >> 5) + 1] |= shifted & np.uint64(0xFFFFFFFF)

    lane, sample = np.nonzero(coded)
    if len(lane):
        kk = k[lane, sample]
        f = folded[lane, sample].astype(np.int64)
        last = at[lane] + ends[lane, sample]  # where the code ends: a one and k bits, after zeros
        where = last - kk - 1
        value = ((1 << kk) | (f & ((1 << kk) - 1))).astype(np.uint64) << (64 - (where & 31) - kk - 1).astype(np.uint64)
        word = where >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] |= np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] |= np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        for p in range(many):  # each partition's parameter
            own, column = np.nonzero(begins & (part == p)) if split.any() or not p else (lane[:0], sample[:0])
            put(at[own] + ends[own, column] - code[own, column] - 4, k_each[own, p], 4)
    put(at, np.where(constant, 0, np.where(linear, 31 + ORDER, 8 | order)) << 1, 8)
    put(at[constant] + 8, x[constant, 0], 8)
    for w in range(ORDER):
        some = ~constant & (order > w)
        put(at[some] + 8 + 8 * w, x[some, w], 8)
    some = linear & ~constant
    put(at[some] + 8 + 8 * ORDER, (PRECISION - 1) << 5 | shift[some], 9)
    for j in range(ORDER):
        put(at[some] + 17 + 8 * ORDER + PRECISION * j, coefficients[some, j], PRECISION)
    put(at[~constant] + prologue[~constant] - 6, np.where(split, PARTS, 0)[~constant], 6)
    out = words.astype(">u4").view(np.uint8)
    inner = np.arange(14) < head_size[:, None]
    out[(begin[:, None] + np.arange(14))[inner]] = heads[inner]
    crc = crc16(out, begin, sizes - 2)
    out[begin + sizes - 2], out[begin + sizes - 1] = crc >> 8, crc & 0xFF
    return out[: int(sizes.sum())], sizes


def encode_streams(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes (stored as signed 8-bit samples, each less by 128)."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    signed = (data ^ 0x80).view(np.int8)
    sizes = np.array([len(p) for p in payloads])
    at = np.cumsum(sizes) - sizes
    frames = -(-sizes // block)
    number = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames, frames)
    starts = np.repeat(at, frames) + number * block
    lengths = np.minimum(block, np.repeat(at + sizes, frames) - starts)
    made, made_sizes = [], []
    for a in range(0, len(starts), TOGETHER_CODED):
        own = slice(a, a + TOGETHER_CODED)
        body, each = encode_frames(signed, starts[own], lengths[own], number[own])
        made.append(body.tobytes())
        made_sizes.append(each)
    body, each = b"".join(made), np.concatenate(made_sizes) if made_sizes else np.zeros(0, np.int64)
    offset = np.cumsum(each) - each
    points = np.zeros(len(each), dtype=[("sample", ">u8"), ("offset", ">u8"), ("length", ">u2")])
    points["sample"], points["length"] = number * block, lengths
    points["offset"] = offset - np.repeat(offset[(np.cumsum(frames) - frames)[frames > 0]], frames[frames > 0])
    out, frame = [], 0
    for payload, n, start in zip(payloads, frames.tolist(), at.tolist(), strict=True):
        own = slice(frame, frame + n)
        low = int(offset[frame]) if n else 0
        high = int(offset[frame + n - 1] + each[frame + n - 1]) if n else 0
        table_of = points[own].tobytes()
        small, large = (int(each[own].min()), int(each[own].max())) if n else (0, 0)
        info = struct.pack(">HH", block, block) + small.to_bytes(3, "big") + large.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5(signed[start : start + len(payload)].tobytes()).digest()
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info
        for p in range(0, max(1, len(table_of)), 18 * 900_000):  # a metadata block has 24 bits for its length
            some = table_of[p : p + 18 * 900_000]
            last = p + 18 * 900_000 >= len(table_of)
            head += bytes([0x83 if last else 0x03]) + len(some).to_bytes(3, "big") + some
        out.append(head + body[low:high])
        frame += n
    return out


# --- decoder


class Stream:
    """A stream's metadata: block size, depth, channels, total samples (0: unknown), MD5, seek points, where frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        at, last, self.points, self.depth = 4, False, [], 0
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata is cut short")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                if size < 34:
                    raise FlacError("metadata is cut short")
                packed = int.from_bytes(block[10:18], "big")
                self.block = int.from_bytes(block[2:4], "big")
                self.channels, self.depth, self.total = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                self.points += [p for p in struct.iter_unpack(">QQH", block[: size // 18 * 18]) if p[0] != (1 << 64) - 1]
            at += 4 + size
        self.frames = at
        if not 4 <= self.depth <= 24:
            raise FlacError("only 4 to 24 bits a sample are read")


class Headers(NamedTuple):
    """Frame headers: whether each is one that holds, its size, block size, number, whether that counts samples, channel
    code and bits a sample (0: as in the metadata)."""

    good: np.ndarray
    size: np.ndarray
    block: np.ndarray
    number: np.ndarray
    variable: np.ndarray
    channels: np.ndarray
    depth: np.ndarray


def read_headers(data: np.ndarray, starts: np.ndarray) -> Headers:
    """Parses what may be frame headers at the starts."""
    h = np.concatenate([data, np.zeros(20, np.uint8)])[starts[:, None] + np.arange(17)].astype(np.int64)
    lanes = np.arange(len(starts))
    lead = h[:, 4]
    extra = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead < 0xFF], [0, -1, 1, 2, 3, 4, 5, 6], -1)
    number = np.where(extra <= 0, lead, lead & (0x3F >> np.maximum(extra, 0)))
    for k in range(1, 7):
        number = np.where(k <= extra, number << 6 | h[:, 4 + k] & 0x3F, number)
    at = 5 + np.maximum(extra, 0)
    code, rate = h[:, 2] >> 4, h[:, 2] & 15
    block = BLOCK_SIZES[code]
    block = np.where(code == 6, h[lanes, at] + 1, np.where(code == 7, (h[lanes, at] << 8 | h[lanes, at + 1]) + 1, block))
    at = at + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    crc = np.zeros(len(starts), dtype=np.int64)
    for k in range(int(at.max()) if len(at) else 0):
        crc = np.where(k < at, CRC8[crc ^ h[:, k]], crc)
    channels, depth = h[:, 3] >> 4, SAMPLE_BITS[h[:, 3] >> 1 & 7]
    good = (h[:, 0] == 0xFF) & (h[:, 1] & 0xFE == 0xF8) & (extra >= 0) & (block > 0) & (rate != 15) & (channels <= 10) & (depth >= 0)
    good &= (h[:, 3] & 1 == 0) & (crc == h[lanes, at])
    return Headers(good, at + 1, block, number, h[:, 1] & 1 == 1, channels, depth)


def frame_starts(data: np.ndarray, info: Stream) -> list[int]:
    """Where a stream's frames begin: its seek points, where they name every frame, or what is found by sync code, header
    checksum, number and the frame's own checksum."""
    points = info.points
    if info.total and sum(p[2] for p in points) == info.total and [p[0] for p in points] == np.cumsum([0, *(p[2] for p in points)])[:-1].tolist():
        return [info.frames + p[1] for p in points]
    found = info.frames + np.flatnonzero((data[info.frames : -1] == 0xFF) & (data[info.frames + 1 :] & 0xFE == 0xF8))
    head = read_headers(data, found)
    keep = head.good
    found, number, block, variable = found[keep], head.number[keep], head.block[keep], head.variable[keep]
    if len(data) > info.frames and (not len(found) or found[0] != info.frames):
        raise FlacError("no frame header")
    out: list[int] = []
    i = 0
    while i < len(found):
        out.append(int(found[i]))
        after = number[i] + (block[i] if variable[i] else 1)
        likely = [j for j in np.flatnonzero(number[i + 1 :] == after) + i + 1 if variable[j] == variable[i]]
        ends = [*(int(found[j]) for j in likely), len(data)]
        for j, end in zip([*likely, len(found)], ends, strict=True):
            if end - out[-1] > 2 and crc16(data, np.array(out[-1:]), np.array([end - out[-1] - 2]))[0] == int(data[end - 2]) << 8 | int(data[end - 1]):
                i = j
                break
        else:
            raise FlacError("a frame fails its checksum")
    return out


class Bits:
    """Big-endian bits at each lane's own position in one array of bytes; a word of 64 bits from every byte on is laid out
    beforehand, so that a look ahead is one lookup."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(24 - len(data) % 8, np.uint8)])
        self.words = np.zeros(len(padded), dtype=np.uint64)
        for k in range(8):
            own = padded[k : k + (len(padded) - k) // 8 * 8].view(">u8")
            self.words[k : k + 8 * len(own) : 8] = own
        self.at = at.astype(np.int64) * 8
        self.end = len(data) * 8

    def window(self, lanes: np.ndarray | slice) -> np.ndarray:
        """At least 56 bits from each position on, at the top of 64."""
        at = np.minimum(self.at[lanes], self.end)
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of n bits (0 to 32 each)."""
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), len(lanes))
        value = (self.window(lanes) >> np.uint64(32)) >> (32 - n).astype(np.uint64)
        self.at[lanes] += n
        return value.astype(np.int64)

    def signed(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), len(lanes))
        value = self.take(lanes, n)
        return np.where(n > 0, value - ((value >> np.maximum(n - 1, 0) & 1) << n), 0)

    def unary(self, lanes: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is taken too."""
        out = np.zeros(len(lanes), dtype=np.int64)
        todo = np.arange(len(lanes))
        while len(todo):
            top = self.window(lanes[todo]) >> np.uint64(16)  # 48 sure bits; exact as a double
            _, exponent = np.frexp(top.astype(np.float64))
            zeros = np.where(top > 0, 48 - exponent, 48)
            out[todo] += zeros
            self.at[lanes[todo]] += zeros + (top > 0)
            todo = todo[top == 0]
            if len(todo) and (self.at[lanes[todo]] > self.end).any():
                raise FlacError("residual is cut short")
        return out


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, channels: int) -> tuple[Headers, np.ndarray]:
    """Frames at [starts, ends) of data: their headers, and samples (channel, time, lane). Every header's CRC-8 and every
    frame's CRC-16 is verified."""
    head = read_headers(data, starts)
    if not head.good.all() or ((head.depth != 0) & (head.depth != depth)).any():
        raise FlacError("no frame header that holds")
    if (np.where(head.channels < 8, head.channels + 1, 2) != channels).any():
        raise FlacError("a frame of another number of channels")
    if (ends - starts - 2 <= head.size).any() or (crc16(data, starts, ends - starts - 2) != (data[ends - 2].astype(np.int64) << 8 | data[ends - 1])).any():
        raise FlacError("a frame fails its checksum")
    longest_first = np.argsort(-head.block, kind="stable")
    low, high = int(starts.min()), int(ends.max())
    bits = Bits(data[low:high], (starts + head.size - low)[longest_first])
    sizes, code = head.block[longest_first], head.channels[longest_first]
    out = np.zeros((channels, int(sizes[0]), len(starts)), dtype=np.int64 if depth > 16 else np.int32)
    for c in range(channels):
        side = ((code == 8) & (c == 1)) | ((code == 9) & (c == 0)) | ((code == 10) & (c == 1))
        out[c] = subframes(bits, sizes, depth + side, out.dtype)
    if channels == 2:
        a, b = out
        left, right, mid = code == 8, code == 9, code == 10
        b[:, left] = a[:, left] - b[:, left]
        a[:, right] += b[:, right]
        twice = (a[:, mid] << 1) | (b[:, mid] & 1)
        a[:, mid], b[:, mid] = (twice + b[:, mid]) >> 1, (twice - b[:, mid]) >> 1
    back = np.empty_like(out)
    back[:, :, longest_first] = out
    return head, back


def subframes(bits: Bits, sizes: np.ndarray, depth: np.ndarray, kind_of: np.dtype) -> np.ndarray:
    """A subframe of each lane, as (time, lane); lanes are ordered by size, the longest first."""
    n, longest = len(sizes), int(sizes[0])
    lanes = np.arange(n)
    head = bits.take(lanes, 8)
    kind, wasted = head >> 1 & 63, head & 1
    if (head & 0x80).any():
        raise FlacError("bad subframe")
    some = lanes[wasted == 1]
    wasted[some] = bits.unary(some) + 1
    deep = depth - wasted
    if (deep < 1).any():
        raise FlacError("bad subframe")
    out = np.zeros((longest, n), dtype=kind_of)
    some = lanes[kind == 0]
    out[:, some] = bits.signed(some, deep[some])
    verbatim = lanes[kind == 1]
    for t in range(int(sizes[verbatim].max()) if len(verbatim) else 0):
        some = verbatim[sizes[verbatim] > t]
        out[t, some] = bits.signed(some, deep[some])
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise FlacError("bad subframe")
    coded = lanes[fixed | linear]
    if len(coded):
        order = np.where(linear, kind - 31, kind - 8)
        if (order[coded] > sizes[coded]).any():
            raise FlacError("bad subframe")
        for t in range(int(order[coded].max())):
            some = coded[order[coded] > t]
            out[t, some] = bits.signed(some, deep[some])
        coefficients, shift = np.zeros((max(1, int(order[coded].max())), n), dtype=kind_of), np.zeros(n, dtype=kind_of)
        for o in range(1, 5):
            coefficients[:o, fixed & (order == o)] = np.array(FIXED[o])[:, None] if (fixed & (order == o)).any() else 0
        some = lanes[linear]
        precision = bits.take(some, 4) + 1
        shift[some] = bits.signed(some, 5)
        if (shift < 0).any() or (precision > 15).any():
            raise FlacError("bad subframe")
        for t in range(int(order[some].max()) if len(some) else 0):
            here = order[some] > t
            coefficients[t, some[here]] = bits.signed(some[here], precision[here])
        method, partition = bits.take(coded, 2), bits.take(coded, 4)
        if (method > 1).any() or (sizes[coded] >> partition << partition != sizes[coded]).any() or (sizes[coded] >> partition < order[coded]).any():
            raise FlacError("bad residual")
        residuals(bits, coded, 4 + method, sizes[coded] >> partition, order[coded], sizes[coded], out)
        predict(out, coded, order[coded], coefficients[:, coded], shift[coded], sizes[coded])
    if wasted.any():
        out <<= wasted.astype(kind_of)
    return out


def residuals(bits: Bits, lanes: np.ndarray, width: np.ndarray, span: np.ndarray, order: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
    """Rice residuals into out from each lane's order on; a new parameter is read at the start and at each span's multiple."""
    n = len(lanes)
    k, raw = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right").tolist()
    every = len(lanes) == out.shape[1]  # all lanes: slices instead of lists
    settled = int(order.max())
    boundary = np.where(order > 0, 0, span)  # the next start of a partition after the first
    boundary = np.where(boundary <= order, span, boundary)
    escapes = False
    for t in range(int(order.min()), int(sizes[0])):
        m = alive[t]
        live = np.arange(m) if t >= settled else np.flatnonzero(t >= order[:m])
        if not len(live):
            continue
        new = boundary[:m] == t
        if t <= settled:
            new = new | (t == order[:m])
        if new.any():
            new = np.flatnonzero(new)
            boundary[new] = np.where(boundary[new] == t, t + span[new], boundary[new])
            k[new] = bits.take(lanes[new], width[new])
            escaped = k[new] == (1 << width[new]) - 1
            raw[new] = -1
            if escaped.any():
                raw[new[escaped]] = bits.take(lanes[new[escaped]], 5)
                escapes = True
        rice = live if not escapes or (raw[live] < 0).all() else live[raw[live] < 0]
        plain = len(rice) == m
        own = slice(0, m) if plain and every else lanes[rice]
        kk = k[:m] if plain else k[rice]
        top = bits.window(own)
        seen = top >> np.uint64(24)  # 40 bits
        _, exponent = np.frexp(seen.astype(np.float64))
        q = (40 - exponent).astype(np.int64)
        taken = q + 1 + kk
        if ((taken <= 40) & (seen > 0)).all():
            low = (top << (q + 1).astype(np.uint64)) >> np.uint64(32) >> (32 - kk).astype(np.uint64)
            value = q << kk | low.astype(np.int64)
            bits.at[own] += taken
        else:
            own = lanes[rice]
            q = bits.unary(own)
            value = q << kk | bits.take(own, kk)
        out[t, own] = value >> 1 ^ -(value & 1)
        if len(rice) < len(live):
            some = live[raw[live] >= 0]
            out[t, lanes[some]] = bits.signed(lanes[some], raw[some])
    if (bits.at[lanes] > bits.end).any():
        raise FlacError("residual is cut short")


def predict(out: np.ndarray, lanes: np.ndarray, order: np.ndarray, coefficients: np.ndarray, shift: np.ndarray, sizes: np.ndarray) -> None:
    """Adds each sample's prediction from the samples before it."""
    for some, most in ((np.flatnonzero((order > 0) & (order <= ORDER)), ORDER), (np.flatnonzero(order > ORDER), 32)):
        if not len(some):
            continue
        most = min(most, int(order[some].max()))
        c, s, o, own = coefficients[:most, some], shift[some], order[some], lanes[some]
        x = out[:, own]
        settled = int(o.max())
        guess, step = np.empty_like(s), np.empty_like(s)
        for t in range(int(o.min()), len(x)):
            reach = min(t, most)
            np.multiply(x[t - 1], c[0], out=guess)
            for j in range(1, reach):
                guess += np.multiply(x[t - 1 - j], c[j], out=step)
            guess >>= s
            if t >= settled:
                x[t] += guess
            else:
                x[t] += np.where(t >= o, guess, 0)
        x[np.arange(len(x))[:, None] >= sizes[some]] = 0
        out[:, own] = x


class Block(NamedTuple):
    """A frame's samples (mono: a row, else a row for each time), and its place in the stream."""

    sample_offset: int
    byte_offset: int
    samples: np.ndarray


def pcm_bytes(x: np.ndarray, depth: int) -> bytes:
    """Signed samples as little-endian integers of whole bytes."""
    if depth <= 8:
        return x.astype(np.int8).tobytes()
    if depth <= 16:
        return x.astype("<i2").tobytes()
    return np.ascontiguousarray(x, dtype="<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def stream_blocks(streams: list[bytes]) -> list[list[Block]]:
    """Each stream decoded into blocks, frames of all streams in step. Headers, frames, their numbers, the total and the MD5
    (where the stream has them) are verified."""
    infos = [Stream(s) for s in streams]
    if len({(i.depth, i.channels) for i in infos}) > 1:
        return [stream_blocks([s])[0] for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base, starts, ends, owner = 0, [], [], []
    for k, (s, info) in enumerate(zip(streams, infos, strict=True)):
        own = frame_starts(data[base : base + len(s)], info)
        starts += [base + a for a in own]
        ends += [base + a for a in [*own[1:], len(s)]][: len(own)]
        owner += [k] * len(own)
        base += len(s)
    if any(b <= a for a, b in zip(starts, ends, strict=True)):
        raise FlacError("seek points do not follow each other")
    out: list[list[Block]] = [[] for _ in streams]
    reached, base = [0] * len(streams), np.cumsum([0, *map(len, streams)]).tolist()
    for a in range(0, len(starts), LANES):
        some = slice(a, a + LANES)
        head, x = decode_frames(data, np.array(starts[some]), np.array(ends[some]), infos[0].depth, infos[0].channels)
        x = np.ascontiguousarray(x.transpose(2, 1, 0))  # lane, time, channel
        columns = (head.block.tolist(), head.number.tolist(), head.variable.tolist())
        for i, (k, start, n, number, variable) in enumerate(zip(owner[some], starts[some], *columns, strict=True)):
            if number != (reached[k] if variable else len(out[k])):
                raise FlacError("a frame's number is out of order")
            out[k].append(Block(reached[k], start - base[k], x[i, :n, 0] if infos[0].channels == 1 else x[i, :n]))
            reached[k] += n
    for blocks, info, n in zip(out, infos, reached, strict=True):
        if info.total and n != info.total:
            raise FlacError("a stream has not as many samples as it says")
        if any(info.md5):
            sums = hashlib.md5()
            for b in blocks:
                sums.update(pcm_bytes(b.samples, info.depth))
            if sums.digest() != info.md5:
                raise FlacError("a stream fails its MD5")
    return out


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (signed) of each stream: a row, or a row for each time of several channels."""
    return [np.concatenate([b.samples for b in blocks]) if blocks else np.zeros(0, np.int32) for blocks in stream_blocks(streams)]


# --- operators


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def features(x: np.ndarray) -> str:
    """Length, mean, root mean square, peak and zero crossings of samples, as JSON."""
    y = x.astype(np.int64)
    rms = float(np.sqrt((y * y).mean()))
    values = {"samples": len(y), "mean": round(float(y.mean()), 6), "rms": round(rms, 6), "peak": int(np.abs(y).max())}
    return json.dumps(values | {"crossings": int(np.count_nonzero(np.diff(np.signbit(y))))})


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_bytes (UTF-8), media (the payload as a FLAC stream), pcm (the payload, put together from the blocks decoded
    from media), blocks (array of block's sample_offset, byte_offset and n_samples) and feature added; columns so named are
    replaced, others kept. A null text counts as empty: 64 bytes 0. Repeated rows each have their stream, the same one. An
    empty table gives no rows. No shuffle; long texts are coded as many frames, so memory is that of a text and its stream."""
    added = ("n_bytes", "media", "pcm", "blocks", "feature")
    rest = [c for c in df.columns if c not in added]
    place = T.StructType().add("sample_offset", "long").add("byte_offset", "long").add("n_samples", "integer")
    schema = df.select(*rest).schema.add("n_bytes", "long").add("media", "binary").add("pcm", "binary")
    schema = schema.add("blocks", T.ArrayType(place)).add("feature", "string")
    at = rest.index(text)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at, TOGETHER):
                texts = part.column(at).to_pylist()
                media = encode_streams([payload_of(t) for t in texts])
                found = stream_blocks(media)
                samples = [np.concatenate([b.samples for b in blocks]) for blocks in found]
                places = [[{"sample_offset": b.sample_offset, "byte_offset": b.byte_offset, "n_samples": len(b.samples)} for b in blocks] for blocks in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                        pa.array(media, pa.binary()),
                        pa.array([(x + 128).astype(np.uint8).tobytes() for x in samples], pa.binary()),
                        pa.array(places, kind),
                        pa.array([features(x) for x in samples]),
                    ],
                    [*rest, *added],
                )

    return df.select(*rest).mapInArrow(lean(run), schema)


def pcm_blocks(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, block, sample_offset, byte_offset, n_samples, pcm) of every frame of df's FLAC streams: signed samples as
    little-endian integers of one to three bytes, channels interleaved, with the frame's place in the stream, so that a
    reader can seek to any sample. A null stream gives no rows; a damaged one fails the job with FlacError."""
    schema = df.select(key).schema
    for name, kind in (("block", "integer"), ("sample_offset", "long"), ("byte_offset", "long"), ("n_samples", "integer"), ("pcm", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, TOGETHER):
                rows: list[tuple] = []
                for k, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if s is None:
                        continue
                    depth, (blocks,) = Stream(s).depth, stream_blocks([s])
                    rows += [(k, i, b.sample_offset, b.byte_offset, len(b.samples), pcm_bytes(b.samples, depth)) for i, b in enumerate(blocks)]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return df.select(key, media).mapInArrow(lean(run), schema)


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a FLAC stream and back; see store_texts for nulls, repeats and empty tables."""
    tail = F.expr("substring(pcm, length(pcm) - 63, 64)")
    return store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("n_blocks"),
        F.element_at("blocks", -1)["byte_offset"].alias("last_block_at"),
    )
