"""Elias-Fano codes of ascending numbers, with a sampled select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A sample of the select structure every so many numbers.
STEP = 64


@dataclass
class EliasFano:
    """``n`` ascending numbers from 0 to ``bound``: about 2 + log2(bound / n) bits each.

    ``low`` packs the lower ``low_bits`` bits of each number, ``high`` has the rest in unary: the i-th one stands at
    place (number >> low_bits) + i. ``samples`` has the place of every 64th one as an unsigned 32-bit integer.
    """

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, numbers: np.ndarray, bound: int) -> EliasFano:
        numbers = np.asarray(numbers, np.int64)
        n = len(numbers)
        if n and (numbers[0] < 0 or numbers[-1] > bound or (np.diff(numbers) < 0).any()):
            raise ValueError("ascending numbers from 0 to the bound are needed")
        low_bits = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
        bits = (numbers[:, None] >> np.arange(low_bits)) & 1
        ones = (numbers >> low_bits) + np.arange(n)
        if (bound >> low_bits) + n >= 1 << 32:
            raise ValueError("a block holds fewer than 2**32 high bits")
        high = np.zeros((bound >> low_bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def _lows(self, begin: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        first, last = begin * self.low_bits, (begin + count) * self.low_bits
        packed = np.frombuffer(self.low, np.uint8)[first // 8:-(-last // 8)]
        bits = np.unpackbits(packed, bitorder="little")[first % 8:first % 8 + last - first]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4")[i // STEP])
        left = i % STEP
        high = np.frombuffer(self.high, np.uint8)
        byte = place // 8
        bits = np.flatnonzero(np.unpackbits(high[byte:byte + 1], bitorder="little"))
        found = bits[bits >= place % 8] + 8 * byte
        while len(found) <= left:
            left -= len(found)
            byte += 1
            found = np.flatnonzero(np.unpackbits(high[byte:byte + 1], bitorder="little")) + 8 * byte
        return int(found[left] - i << self.low_bits) + int(self._lows(i, 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        return (ones - np.arange(self.n) << self.low_bits) + self._lows(0, self.n)
