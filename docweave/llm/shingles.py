"""Near copies by word shingles: MinHash bands find candidates, exact Jaccard similarity decides.

A text is the set of its lower-cased 5-word shingles. Two texts of Jaccard
similarity 0.8 share none of the 32 bands of four least hashes, and are
missed, with a chance of 5 in 10**8; more alike ones more rarely. The texts
of a band meet in the cell of the band's leader, its text of least hash, so
that copies that share many bands meet once. Whole sets are compared in each
cell, so nothing else is linked. A cell of more than ``CELL_BYTES`` is dealt
to a grid of smaller ones in which every two of its texts still meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import cut, partitions
from docweave.llm.simhash import _Roots

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
#: Members of shingles' lists that are counted at a time.
COUNTED = 1 << 22
#: Bytes of shingle sets that a cell is meant to hold; a single text may have more.
CELL_BYTES = 16 << 20

_rng = np.random.default_rng(5)
_X = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the whole text's shingles, sorted; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    own = (text or "").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxh64_intdigest, " ".join(own).encode("utf-8", "surrogatepass").split(b" ")), np.uint64, len(own))
    n = max(1, len(own) - words + 1)
    key = np.zeros(n, np.uint64)
    for i in range(min(words, len(own))):
        key = (key ^ hashed[i : i + n]) * _MIX
        key ^= key >> np.uint64(32)
    return np.unique(key)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes."""
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        least = np.minimum(least, ((low[at : at + 1024, None] ^ _X) * _A).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar_roots(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Root of each set over links of at least that Jaccard similarity; no pair is left out."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    roots = _Roots(n)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    order = np.argsort(codes, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    start = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    for u in range(n - 1):
        mine = codes[ends[u] - size[u] : ends[u]]
        length = start[mine + 1] - start[mine]
        mine, length = mine[length > 1], length[length > 1]
        if not len(mine):
            continue
        shared = np.zeros(n, np.int64)
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(np.cumsum(length) // COUNTED)) + 1):
            m = length[part]
            at = np.repeat(start[mine[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            shared += np.bincount(owner[at], minlength=n)
        hit = np.flatnonzero(shared / (size[u] + size - shared) >= least)
        hit = hit[hit > u]
        roots.link(np.full(len(hit), u), hit)
        if not roots.parent.any():
            break
    return roots.parent


def links(docs: DataFrame, node_of: Callable[[str], int], text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(u, v): nodes of texts that share a band's cell, each linked to the root of its similar ones.

    ``node_of`` gives a text's node, an unsigned 64-bit integer. Null texts
    and those without words have no links. Copies (by XXH64) are merged
    before every shuffle. Only texts that share a band with another one have
    their shingles shuffled, once for each leader of their bands, of which
    there are at most 32. A cell gives fewer rows than it has texts.
    """
    from docweave.llm.exact_dedup import BROADCAST_IDS

    spark = docs.sparkSession
    own = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("th"), "text")

    def sign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                full, keys = [], []
                for i, text in enumerate(part.column(1)):
                    if len(s := shingles(text.as_py())):
                        full.append(i)
                        keys.append(band_keys(s))
                if full:
                    offsets = pa.array(np.arange(len(full) + 1) * BANDS, pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))], names=["th", "keys"])

    signed = cut(own.mapInArrow(sign, "th long, keys array<long>").groupBy("th").agg(F.first("keys").alias("keys")))
    bands = signed.select("th", F.explode("keys").alias("key"))
    led = cut(bands.groupBy("key").agg(F.min("th").alias("leader"), F.max("th").alias("__last")).where("leader <> __last").select("key", "leader"))
    cells = cut(bands.join(led, "key").select("leader", "th").distinct())
    wanted = cut(cells.select("th").distinct())
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def whole(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                nodes = pa.array(np.array([node_of(t) for t in texts], dtype=np.uint64).view(np.int64))
                sets = pa.array([shingles(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), nodes, sets], names=["th", "node", "own"])

    once = own.join(F.broadcast(wanted) if few else wanted, "th", "left_semi").dropDuplicates(["th"])
    sets = cut(once.mapInArrow(whole, "th long, node long, own binary"))
    size = cells.join(sets.select("th", F.octet_length("own").alias("bytes")), "th").groupBy("leader").agg(F.sum("bytes").alias("bytes"))
    large = cut(size.where(F.col("bytes") > CELL_BYTES).select(F.col("leader").alias("__large"), F.ceil(F.col("bytes") / CELL_BYTES).cast("int").alias("blocks")))
    own_block, other = F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    dealt = cells.join(large, F.col("leader") == F.col("__large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("leader", "th", own_block.alias("block"), other)
    dealt = dealt.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "th")
    met = dealt.join(sets, "th").select("leader", "i", "j", "node", "own")

    def solve(batches):
        cell, nodes, held = None, [], []

        def linked():
            if len(held) < 2:
                return []
            root = similar_roots(held, least)
            return [(nodes[i], nodes[r]) for i, r in enumerate(root.tolist()) if i != r]

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names=["u", "v"])

        for b in batches:
            found = []
            for *own_cell, node, s in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                if own_cell != cell:
                    found += linked()
                    cell, nodes, held = own_cell, [], []
                nodes.append(node)
                held.append(np.frombuffer(s.as_py(), np.uint64))
            yield batch(found)
        yield batch(linked())

    return met.repartition(partitions(spark), "leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(solve, "u long, v long")
