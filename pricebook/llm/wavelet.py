"""Wavelet matrix: token access, counting and occurrence lookup from one compressed byte string."""

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512                 # bits between two entries of the rank directory


class WaveletMatrix:
    """Bit-planes of a token sequence, highest bit first, each stably partitioned by the planes above it.

    Tokens are first replaced by their place among the sequence's distinct tokens, so the number of planes follows
    the alphabet in use. An empty sequence has no planes.
    """

    def __init__(self, n, alphabet, planes, zeros):
        self.n, self.alphabet, self.planes, self.zeros = n, alphabet, planes, zeros
        self._ranks = [None] * len(planes)

    @classmethod
    def build(cls, tokens: np.ndarray):
        seen = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, bool)
        seen[tokens] = True
        alphabet = np.flatnonzero(seen)
        place = np.cumsum(seen, dtype=np.uint32) - np.uint32(1)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        x = place.astype(kind)[tokens]
        planes, zeros = [], []
        for level in reversed(range(max(len(alphabet) - 1, 0).bit_length())):
            bit = ((x >> kind(level)) & kind(1)).astype(np.uint8)
            one = bit.view(bool)
            left = x[~one]
            planes.append(np.packbits(bit))
            zeros.append(len(left))
            x = np.concatenate([left, x[one]])
        return cls(len(tokens), alphabet, planes, zeros)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(np.diff(self.alphabet, prepend=0).astype(np.uint32).tobytes())] + [pack(p.tobytes()) for p in self.planes]
        head = json.dumps({"n": self.n, "zeros": self.zeros, "sizes": [len(p) for p in parts]}).encode()
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(bytes(data[8:8 + size]))
        at, parts = 8 + size, []
        for k in head["sizes"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + k]))
            at += k
        alphabet = np.cumsum(np.frombuffer(parts[0], np.uint32), dtype=np.uint32)
        return cls(head["n"], alphabet, [np.frombuffer(p, np.uint8) for p in parts[1:]], head["zeros"])

    def tokens(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n).view(bool)
            y = np.empty(self.n, kind)
            y[~one] = x[:z]
            y[one] = x[z:] | kind(1 << level)
            x = y
        return self.alphabet[x]

    def _bit(self, level, i):
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, level, i):
        """Ones among the first i bits of a plane."""
        if self._ranks[level] is None:
            per = np.bitwise_count(self.planes[level]).astype(np.int64)
            self._ranks[level] = np.concatenate([[0], np.cumsum(np.add.reduceat(per, np.arange(0, len(per), BLOCK // 8)))])
        block = i // BLOCK
        at, end = block * BLOCK // 8, i >> 3
        n = int(self._ranks[level][block]) + int(np.bitwise_count(self.planes[level][at:end]).sum())
        return n + (int(self.planes[level][end] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, i)
            i = z + self._ones(level, i) if bit else i - self._ones(level, i)
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token):
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i positions."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi, top = 0, min(max(i, 0), self.n), len(self.zeros) - 1
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if code >> (top - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _nth(self, level, bit, k):
        """Position of the k-th (from 0) zero or one of a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            return -1
        lo, top = 0, len(self.zeros) - 1
        for level, z in enumerate(self.zeros):
            a = self._ones(level, lo)
            lo = z + a if code >> (top - level) & 1 else lo - a
        i = lo + k
        for level in reversed(range(len(self.zeros))):
            bit = code >> (top - level) & 1
            i = self._nth(level, bit, i - self.zeros[level] if bit else i)
        return i
