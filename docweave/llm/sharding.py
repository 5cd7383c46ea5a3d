"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

A row's number in id order is permuted over exactly [0, n) by a Feistel
network with cycle walking. Position ``p`` lies in shard ``p mod shards`` at
slot ``p div shards``, so counts differ by one at most, slots have no gaps,
and both directions are arithmetic: no lookup table, no second shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from docweave.llm.common import cut, numbered

ROUNDS = 6
_MASK = (1 << 64) - 1


class Feistel:
    """Keyed bijection of [0, n); ``n`` from 1 to 2**62."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.low, self.high = bits // 2, bits - bits // 2
        self.keys = [self._mix_int((seed * 0x9E3779B97F4A7C15 + i + 1) & _MASK) for i in range(rounds)]

    @staticmethod
    def _mix_int(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        return x ^ (x >> 31)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        # each round adds a keyed hash of one part to the other part, in turn
        low = np.uint64(self.low)
        ml, mh = np.uint64((1 << self.low) - 1), np.uint64((1 << self.high) - 1)
        left, right = x >> low, x & ml
        steps = list(enumerate(self.keys))
        for i, key in reversed(steps) if back else steps:
            if i % 2:
                right = right ^ (self._mix(left + np.uint64(key)) & ml)
            else:
                left = left ^ (self._mix(right + np.uint64(key)) & mh)
        return (left << low) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        """Shuffled position of each row number."""
        return self._walk(row, False)

    def row(self, position: np.ndarray) -> np.ndarray:
        """Row number at each shuffled position (inverse of ``position``)."""
        return self._walk(position, True)


def row_at(n: int, shards: int, shard: int, slot: int, seed: int = 0) -> int:
    """Row number that lies in ``slot`` of ``shard``, for readers that seek."""
    return int(Feistel(n, seed).row(np.array([slot * shards + shard]))[0])


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and slot under law ``rows``.

    Returns (id, size, text_crc32, row_number, shard, slot). Row numbers
    follow (id, size, crc), nulls first; rows equal in all three are
    interchangeable, so repeated rows get a place each. Null text has size 1
    and crc 0. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Only the narrow columns are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(cut(thin), [id_col, "size", "text_crc32"])
    f = Feistel(max(n, 1), seed)

    @pandas_udf("long")
    def position(x):
        import pandas as pd

        return pd.Series(f.position(x.to_numpy()))

    p = rows.withColumn("__pos", position("row_number"))
    return p.select(
        id_col, "size", "text_crc32", "row_number",
        (F.col("__pos") % shards).cast("int").alias("shard"),
        F.expr(f"__pos div {shards}").cast("long").alias("slot"),
    )
