"""SimHash fingerprints linked by covering locality-sensitive hashing.

The 64 bits are dealt to the 13 points of the projective plane of order 3.
Each of its 13 lines gives a table whose key leaves out the bits of the
line's four points. Any two points lie on a line, so two fingerprints that
differ in at most two bits agree on the key of some table: no pair within
the radius is missed. A key's free bits number 20 at most, which bounds a
bucket to 2**20 distinct fingerprints (8 MB).
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import cut, partitions
from docweave.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
#: XXH64's seed.
SEED = 42
#: A perfect difference set modulo 13: the first line of the plane.
LINE = (0, 1, 3, 9)
POINTS = 13
#: Runs up to this long are compared within a window; longer ones by flipping bits.
SHORT = 24


def free_masks() -> list[int]:
    """For each table, the bits that its key leaves out."""
    out = []
    for shift in range(POINTS):
        line = {(p + shift) % POINTS for p in LINE}
        out.append(sum(1 << b for b in range(64) if b % POINTS in line))
    return out


def fingerprint(text: str | None) -> int:
    """SimHash of the whole text's 3-word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
        counts = _bit_counts(hashes)
        n = 1
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: -SHINGLE]]
        n = len(starts)
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            counts += _bit_counts([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at + SHINGLE - 1 :])])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): fingerprints as signed 64-bit integers, a row for each input row."""
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return own.mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


class _Roots:
    """Disjoint sets over 0..n-1, the smallest member being the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (up := self.parent[self.parent] != self.parent).any():
                self.parent[up] = self.parent[self.parent[up]]


def bucket_links(fps: np.ndarray, runs: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Root of each fingerprint in its run; fingerprints are sorted and distinct within runs.

    ``runs`` numbers the runs, ``free`` has each row's free bits. All links
    within the radius are found, none is emitted: short runs compare within
    a window, a long run looks up each flip of one or two free bits.
    """
    sets = _Roots(len(fps))
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    size = np.diff(np.append(first, len(runs)))
    length = np.repeat(size, size)
    short = np.flatnonzero((length > 1) & (length <= SHORT))
    for step in range(1, SHORT):
        a = short[short + step < len(fps)]
        a = a[runs[a] == runs[a + step]]
        if not len(a):
            break
        near = np.bitwise_count(fps[a] ^ fps[a + step]) <= RADIUS
        sets.link(a[near], a[near] + step)
    for at, n in zip(first[size > SHORT], size[size > SHORT]):
        own = fps[at : at + n]
        bits = [np.uint64(1 << b) for b in range(64) if int(free[at]) >> b & 1]
        for flip in bits + [a | b for a, b in combinations(bits, 2)]:
            other = own ^ flip
            place = np.minimum(np.searchsorted(own, other), n - 1)
            hit = np.flatnonzero((own[place] == other) & (place > np.arange(n)))
            if len(hit):
                sets.link(at + hit, at + place[hit])
    return sets.parent


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): for each bucket, every member that has a link and the root of its linked part.

    ``distinct`` has one row a fingerprint, column ``fp``. A link between two
    fingerprints within the radius is never lost, and a bucket gives fewer
    rows than it has members.
    """
    masks = free_masks()
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(_signed(~m)).alias("k")) for i, m in enumerate(masks)]))
    wide = distinct.select("fp", tables.alias("__b")).select("__b.t", "__b.k", "fp")
    n = partitions(distinct.sparkSession)
    dealt = wide.repartition(n, "t", "k").sortWithinPartitions("t", "k", "fp")
    free = np.array(masks, dtype=np.uint64)

    def work(batches):
        held = None

        def solve(t, k, fp):
            new = np.concatenate(([False], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            runs = np.cumsum(new)
            size = np.bincount(runs)
            keep = size[runs] > 1
            t, fp, runs = t[keep], fp[keep], runs[keep]
            if not len(fp):
                return None
            fps = fp.view(np.uint64)
            order = np.lexsort((fps, runs))
            fps, t, runs = fps[order], t[order], runs[order]
            root = bucket_links(fps, runs, free[t])
            own = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[root[own]].view(np.int64))], names=["u", "v"])

        for b in batches:
            t, k, fp = (np.asarray(b.column(i)) for i in range(3))
            if held is not None:
                t, k, fp = (np.concatenate(x) for x in zip(held, (t, k, fp)))
            if not len(t):
                continue
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            at = last[-1] + 1 if len(last) else 0
            held = tuple(x[at:].copy() for x in (t, k, fp))  # the last run may go on
            if at and (out := solve(t[:at], k[:at], fp[:at])) is not None:
                yield out
        if held is not None and len(held[0]) and (out := solve(*held)) is not None:
            yield out

    return dealt.mapInArrow(work, "u long, v long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """(id, fp long, component_id, root long), a row for each input row.

    ``root`` is the component's fingerprint that names it; ``component_id`` is the smallest id reachable over links of at most two
    bits; null ids are skipped unless a component has no other. Null and
    empty texts, and those of white space only, have fingerprint 0 and are
    linked like any other. Equal fingerprints are merged before the tables
    are made, so copies cost nothing there; rows meet their component in
    joins of narrow rows that Spark can split. Other columns are ignored.
    With ``similar``, texts whose 5-word shingles have at least that Jaccard
    similarity are linked too, however many bits they differ by.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__id", "__t"))
    distinct = cut(rows.groupBy("fp").agg(F.min("__id").alias("least")))
    found = links(distinct)
    if similar is not None:
        from docweave.llm import shingles

        found = found.union(shingles.links(docs, fingerprint, text_col, similar))
    roots = connected_components(cut(found))
    met = cut(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    labels = cut(met.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component")))
    linked = met.join(labels, F.col("root") == F.col("r")).select(F.col("fp").alias("__fp"), "component", "root")
    alone = distinct.join(roots, F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("__fp"), F.col("least").alias("component"), F.col("fp").alias("root"))
    final = cut(linked.union(alone))
    out = rows.join(final, F.col("fp") == F.col("__fp"))
    return out.select(F.col("__id").alias(id_col), "fp", F.col("component").alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, one of each component: that with the smallest id.

    Of rows that share that id, the one with the smallest fingerprint stays,
    and one of rows equal in both. A component whose ids are all null keeps
    one row.
    """
    from docweave.llm.exact_dedup import keep_rows

    rows = cut(near_duplicates(docs, id_col, text_col, similar)).withColumn("rid", F.monotonically_increasing_id())
    part = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.col(id_col) == F.col("component_id"))
    first = cut(rows.where(part).groupBy("root").agg(F.min(F.struct("fp", "rid")).alias("first")))
    chosen = first.select("first.rid").withColumn("kept", F.lit(True))
    decided = rows.join(chosen, "rid", "left").select(id_col, "fp", F.coalesce("kept", F.lit(False)).alias("kept"))

    @F.pandas_udf("long")
    def fp_of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return keep_rows(docs, decided, "fp", fp_of(F.col(text_col)), id_col)
