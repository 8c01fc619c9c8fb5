"""Static range asymmetric numeral system over token ids: blocks of interleaved lanes that share one frequency table.

A block is a byte string, little-endian: a header (magic, number of ids, lanes, bits of the table, steps between two
checkpoints, checkpoints, words, crc32 of the table), the checkpoints (place in the words, crc32 of the ids up to the next
checkpoint, the state of each lane), the 32-bit words, and the crc32 of all that. Id i belongs to lane i % lanes. Each
checkpoint is a place where decoding can begin, so parts of a block can be decoded alone, or in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANS"
HEAD = struct.Struct("<4sIHBxIIII")
#: Bits of a frequency table: the frequencies add up to 2 ** BITS.
BITS = 20
LANES, EVERY = 512, 128
LOW = np.uint64(1 << 31)
_HALF, _WORD = np.uint64(32), np.uint64(0xFFFFFFFF)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to counts that add up to 2 ** BITS; each id that occurs has 1 at least."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    if used.sum() > 1 << BITS:
        raise ValueError(f"a table holds {1 << BITS} different ids at most")
    out = np.zeros(len(counts), np.int64)
    if used.any():
        out[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << BITS)))
        rest = (1 << BITS) - int(out.sum())
        if rest >= 0:
            out[int(counts.argmax())] += rest
        else:  # the ones that were rounded up: taken back from the largest, in turn
            order = np.argsort(-out, kind="stable")
            while rest < 0:
                for i in order[out[order] > 1][:-rest]:
                    out[i] -= 1
                    rest += 1
    return out.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks with one frequency table; ids are below 2 ** BITS."""

    def __init__(self, freq: np.ndarray):
        if len(freq) > 1 << BITS:
            raise ValueError(f"ids must be below {1 << BITS}")
        self.freq = np.ascontiguousarray(freq, "<u4")
        if len(self.freq) and int(self.freq.sum()) not in (0, 1 << BITS):
            raise ValueError("the frequencies don't add up to the table's size")
        self.sum = zlib.crc32(self.freq.tobytes())
        self.f = self.freq.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64) if len(self.f) else self.f
        self._slots = None

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps = -(-n // lanes)
        if n and (ids.min() < 0 or ids.max() >= len(self.f) or not self.f[ids].all()):
            raise ValueError("an id is not in the frequency table")
        f, c = self.f[ids], self.c[ids]
        most, gap = f << np.uint64(63 - BITS), np.uint64(1 << BITS) - f
        x, words, marks, given = np.full(lanes, LOW, np.uint64), [], [], 0
        for t in range(steps - 1, -1, -1):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            own = x[: hi - lo]
            big = np.flatnonzero(own >= most[lo:hi])
            if len(big):
                out = own[big]
                words.append((out & _WORD).astype("<u4"))
                given += len(out)
                own[big] = out >> _HALF
            own += own // f[lo:hi] * gap[lo:hi] + c[lo:hi]  # (x // f << BITS) + x % f + c
            if t % every == 0:
                marks.append((given, x.astype("<u8").tobytes(), zlib.crc32(np.ascontiguousarray(ids[lo : min(n, lo + every * lanes)], "<u4"))))
        head = HEAD.pack(MAGIC, n, lanes, BITS, every, len(marks), given, self.sum)
        body = b"".join(struct.pack("<II", given - at, crc) + states for at, states, crc in reversed(marks))
        out = head + body + b"".join(w.tobytes() for w in reversed(words))
        return out + struct.pack("<I", zlib.crc32(out))

    def decode(self, block: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids lo to hi of a block, from the last checkpoint before lo on; damaged blocks raise ValueError."""
        magic, n, lanes, bits, every, marks, given, table = HEAD.unpack_from(block)
        if magic != MAGIC or bits != BITS:
            raise ValueError("this is no block of this format")
        if table != self.sum:
            raise ValueError("the block was written with another frequency table")
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("the block is damaged: its checksum differs")
        hi = n if hi is None else min(hi, n)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        if self._slots is None:
            # Frequency, place within the symbol, and symbol of each slot, in one integer.
            symbols = np.repeat(np.arange(len(self.f), dtype=np.uint64), self.freq)
            place = np.arange(1 << BITS, dtype=np.uint64) - self.c[symbols]
            self._slots = (self.f[symbols] << np.uint64(2 * BITS)) | (place << np.uint64(BITS)) | symbols
        each, size = every * lanes, 8 + 8 * lanes
        words = np.frombuffer(block, "<u4", given, HEAD.size + marks * size).astype(np.uint64)
        out = []
        mask, shift, twice = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(2 * BITS)
        for k in range(lo // each, -(-hi // each)):
            at, crc = struct.unpack_from("<II", block, HEAD.size + k * size)
            x = np.frombuffer(block, "<u8", lanes, HEAD.size + k * size + 8).astype(np.uint64)
            first, last = k * each, min(n, (k + 1) * each)
            found = np.empty(last - first, np.uint64)
            for t in range(first, last, lanes):
                own = x[: min(lanes, n - t)]
                slot = self._slots[own & mask]
                found[t - first : t - first + len(own)] = slot
                own >>= shift
                own *= slot >> twice
                own += (slot >> shift) & mask
                small = np.flatnonzero(own < LOW)
                if len(small):
                    own[small] = (own[small] << _HALF) | words[at : at + len(small)]
                    at += len(small)
            ids = (found & mask).astype(np.uint32)
            if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
                raise ValueError("the ids between two checkpoints differ from their checksum")
            out.append(ids[max(lo - first, 0) : hi - first])
        return np.concatenate(out)
