"""Token files: static range asymmetric numeral system over interleaved lanes, with checkpoints and checksums.

A container is a Parquet folder with one row per block (Spark's committer makes it safe against lost tasks, its
row groups are what readers split). A block is self-contained given the shared frequency table:

    header   magic, tokens, lanes, steps between checkpoints, words, crc32 of the ids (little-endian uint32)
    states   final coder state of each lane (uint64)
    marks    per checkpoint: word position (uint32) and the state of each lane (uint64)
    words    the 32-bit words of all lanes in the order in which the decoder reads them

Token i of a block belongs to lane i mod lanes. All lanes take one step at a time in numpy; a lane reads at most one word
a step. A reader may start at any checkpoint. Frequencies are scaled to 2^SCALE_BITS with at least 1 for every id, so any id can be written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, SCALE_BITS, LANES, MARK_STEPS = b"RANS", 20, 4096, 128
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIII")


def scale(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2^bits, each at least 1, close to ``counts`` in proportion."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    counts = counts.astype(np.float64) + 1e-9
    f = 1 + np.floor(counts / counts.sum() * (total - len(counts))).astype(np.int64)
    f[np.argsort(-counts, kind="stable")[:total - int(f.sum())]] += 1
    return f


class Table:
    """Frequencies, cumulative frequencies and the slot-to-symbol table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - bits)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, mark_steps: int = MARK_STEPS) -> bytes:
    """One block of ``ids``."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out, marks, written = [], [], 0
    for s in range(steps - 1, -1, -1):
        part = ids[s * lanes:(s + 1) * lanes]
        k = len(part)
        f, c = table.freq[part], table.start[part]
        y = x[:k]
        over = y >= table.limit[part]
        if over.any():
            w = (y[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
            out.append(w)
            written += len(w)
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[:k] = (q << table.bits) + (y - q * f) + c
        if s and s % mark_steps == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    head = _HEAD.pack(MAGIC, n, lanes, mark_steps, len(words), zlib.crc32(ids.tobytes()))
    # a mark's position counts from the end while encoding, from the start while decoding
    tail = b"".join(struct.pack("<I", len(words) - at) + state.tobytes() for at, state in reversed(marks))
    return head + x.tobytes() + struct.pack("<I", len(marks)) + tail + words.tobytes()


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None, check: bool = True) -> np.ndarray:
    """Ids [first, last) of a block; whole blocks are checked against their checksum."""
    magic, n, lanes, mark_steps, n_words, crc = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    last = n if last is None else min(last, n)
    at = _HEAD.size
    x = np.frombuffer(block, "<u8", lanes, at).copy()
    at += 8 * lanes
    n_marks, = struct.unpack_from("<I", block, at)
    at += 4
    size = 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, at + n_marks * size)
    if last <= first:
        return np.zeros(0, np.uint32)
    mark = min(first // lanes // mark_steps, n_marks)
    step, pos = 0, 0
    if mark:
        step = mark * mark_steps
        pos, = struct.unpack_from("<I", block, at + (mark - 1) * size)
        x = np.frombuffer(block, "<u8", lanes, at + (mark - 1) * size + 4).copy()
    begin, stop = step * lanes, -(-last // lanes)
    out = np.empty(min(stop * lanes, n) - begin, np.uint32)
    low = np.uint64((1 << int(table.bits)) - 1)
    for s in range(step, stop):
        k = min(lanes, n - s * lanes)
        y = x[:k]
        slot = y & low
        sym = table.symbol[slot]
        out[s * lanes - begin:s * lanes - begin + k] = sym
        y = table.freq[sym] * (y >> table.bits) + slot - table.start[sym]
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = (y[under] << np.uint64(32)) | words[pos:pos + len(under)]
            pos += len(under)
        x[:k] = y
    if check and first == 0 and last == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("token block fails its checksum")
    return out[first - begin:last - begin]
