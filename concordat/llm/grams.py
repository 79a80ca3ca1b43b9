"""Hashed n-grams and word statistics of blocks of texts, as whole-array operations."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE, MIX, LEFT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n; kept for the next block."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, x in enumerate((BASE, inverse)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Texts of a block end to end, a line break after each; words are runs without ASCII white space."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length + 1) - self.length - 1
        word = ~SPACE[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.begin, self.start)
        self.words = np.searchsorted(self.begin, self.start + self.length) - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.words)
        power, inverse = powers(len(self.raw) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:len(self.raw)])])
        self.hash = (total[self.end] - total[self.begin]) * inverse[self.begin]

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text ``table`` marks."""
        total = np.concatenate([[0], np.cumsum(table[self.raw])])
        return total[self.start + self.length] - total[self.start]

    def repeats(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each text, how many of its values equal an earlier one in it."""
        mixed = values ^ ((doc.astype(np.uint64) + np.uint64(1)) * LEFT)
        order = np.argsort(mixed, kind="stable")
        same = np.concatenate([[False], mixed[order][1:] == mixed[order][:-1]])
        return np.bincount(doc[order[same]], minlength=len(self.length))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words of one text, and its text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = self.hash[:k]
        for i in range(1, n):
            value = value * MIX + self.hash[i:k + i]
        inside = self.doc[:k] == self.doc[n - 1:]
        return value[inside], self.doc[:k][inside]

    def family(self, name: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of one family ("c3": byte 3-grams, "w2": word 2-grams) in order of texts; first and number by text."""
        n = int(name[1:])
        if name[0] == "w":
            value, doc = self.windows(n)
            number = np.bincount(doc, minlength=len(self.length))
            return ((value * BASE) >> np.uint64(64 - bits)).astype(np.int32), np.cumsum(number) - number, number
        k = max(len(self.raw) - n + 1, 0)
        if n == 1:
            return self.raw.astype(np.int32), self.start, self.length
        value = np.zeros(k, np.uint64)
        for i in range(n):
            value = (value << np.uint64(8)) | self.raw[i:k + i]
        return ((value * BASE) >> np.uint64(64 - bits)).astype(np.int32), self.start, np.maximum(self.length - n + 1, 0)


def profile(block: Block, families: dict[str, int]) -> np.ndarray:
    """Share of each bucket in its family, a row for each text; the families side by side."""
    out = []
    for name, bits in families.items():
        bucket, first, number = block.family(name, bits)
        out.append(np.array([np.bincount(bucket[a:a + n], minlength=1 << bits) / max(n, 1)
                             for a, n in zip(first.tolist(), number.tolist())], np.float32).reshape(len(first), 1 << bits))
    return np.concatenate(out, axis=1)


def dot(block: Block, families: dict[str, int], weights: np.ndarray) -> np.ndarray:
    """``profile(block, families) @ weights`` without the profile."""
    total, at = np.zeros(len(block.length)), 0
    for name, bits in families.items():
        bucket, first, number = block.family(name, bits)
        sums = np.concatenate([[0.0], np.cumsum(weights[at:at + (1 << bits)][bucket])])
        last = np.minimum(first + number, len(bucket))
        total += (sums[last] - sums[np.minimum(first, last)]) / np.maximum(number, 1)
        at += 1 << bits
    return total
