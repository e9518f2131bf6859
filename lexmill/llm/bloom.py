"""A blocked Bloom filter of bounded size over a column of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has at most this many blocks of 256 bits: 32 MB.
MAX_BLOCKS = 1 << 20
#: Listed URLs per block aimed at; about 12 bits for each.
KEYS_PER_BLOCK = 20
#: Odd multipliers that pick one bit in each of a block's eight words.
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


class BlockedBloom:
    """``blocks``: [n, 8] unsigned 32-bit words."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.blocks):
            return np.zeros(len(hashes), bool)
        u = hashes.astype(np.int64).view(np.uint64)
        own = self.blocks[((u >> np.uint64(32)) % np.uint64(len(self.blocks))).astype(np.int64)]
        low = u & np.uint64(0x7FFFFFFF)
        out = np.ones(len(hashes), bool)
        for i, m in enumerate(MULTIPLIERS):
            bit = ((low * np.uint64(m)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            out &= (own[:, i] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return out


def build_filter(listed: DataFrame, column: str = "canonical", max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """The filter over the distinct non-null values of a string column."""
    n = listed.count()
    blocks = int(min(max_blocks, max(1, -(-n // KEYS_PER_BLOCK))))
    bits = [F.expr(f"shiftleft(1, cast(shiftrightunsigned(((h & 2147483647L) * {m}L) & 4294967295L, 27) as int))") for m in MULTIPLIERS]
    rows = listed.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    block = (F.shiftrightunsigned("h", 32) % F.lit(blocks)).cast("int").alias("block")
    words = rows.select(block, *[b.alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    table = words.toArrow()  # at most max_blocks rows of 36 bytes
    out = np.zeros((blocks if n else 0, 8), np.uint32)
    if table.num_rows:
        out[table.column(0).to_numpy()] = np.stack([table.column(i + 1).to_numpy() for i in range(8)], axis=1).astype(np.int32).view(np.uint32)
    return BlockedBloom(out)


def possible(listed: DataFrame, column: str, tested: str | Column, max_blocks: int = MAX_BLOCKS) -> Column:
    """A boolean column: false only where ``tested`` is null or surely not in ``listed``'s
    ``column``, which must have the same type and no null. Only hashes go to Python."""
    shared = listed.sparkSession.sparkContext.broadcast(build_filter(listed, column, max_blocks))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.test(h.to_numpy()))

    return test(F.xxhash64(tested)) & (F.col(tested) if isinstance(tested, str) else tested).isNotNull()


def possible_ids(listed: DataFrame, column: str, tested: str) -> Column:
    """As ``possible``, for integer keys of any width."""
    return possible(listed.select(F.col(column).cast("long").alias(column)), column, F.col(tested).cast("long"))
