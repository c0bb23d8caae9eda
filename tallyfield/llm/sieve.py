"""A bitmap of hashes that is small whatever their number.

It tells most values that aren't among the hashes; those it lets through by chance
must be told by a join afterwards.  With many hashes it lets more through, and
costs work but no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bits at most: 8 MB, gathered as at most 2 ** 20 words.
MOST, LEAST = 26, 16


class Sieve:
    """Bits that 64-bit hashes set, two for each."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Sieve:
        """Of a column of long hashes."""
        n = df.count()
        bits = min(MOST, max(LEAST, int(np.ceil(np.log2(16 * max(1, n))))))
        mask = (1 << bits) - 1
        at = df.selectExpr(f"explode(array({column} & {mask}L, shiftrightunsigned({column}, 32) & {mask}L)) AS p")
        found = at.groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("w")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("i").to_numpy()] = found.column("w").to_numpy().view(np.uint64)
        return cls(bits, words)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of an array of int64 hashes may be among them."""
        h = hashes.view(np.uint64)
        mask = np.uint64((1 << self.bits) - 1)
        out = np.ones(len(h), bool)
        for p in (h & mask, (h >> np.uint64(32)) & mask):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
