"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

A snapshot's distinct digests are cut into buckets; each bucket gets a
binary-fuse filter (three places a key, 8-bit fingerprints, about 9 bits a
key). The new batch is grouped by itself and its digests are screened by
their bucket's filter: negatives are whole groups, positives meet the
snapshot's groups in an exact join on the digest. The texts' bytes are
compared within every group, and the smallest id of a group of equal texts
stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACE, cut, partitions

#: Most keys a bucket is meant to hold; a bucket is built in one task.
BUCKET_KEYS = 500_000
#: Filters up to this many bytes go to every executor; larger ones meet the digests bucket by bucket.
BROADCAST_BYTES = 48 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class BinaryFuse8:
    """Static set of 64-bit keys: no false negative, one false positive in 256 or so."""

    seed: int
    segment: int
    segments: int
    table: np.ndarray

    def _places(self, keys: np.ndarray):
        h = _mix(keys + np.uint64(self.seed))
        mask = np.uint64(self.segment - 1)
        at = ((h >> np.uint64(32)) * np.uint64(self.segment * self.segments)) >> np.uint64(32)
        one = (at + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        two = (at + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack((at, one, two)).astype(np.int64), (h ^ (h >> np.uint64(40))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray, seed: int = 1) -> "BinaryFuse8":
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) if n > 1 else 0
        segments = max(1, -(-int(n * factor) // segment) - 2)
        for attempt in range(200):
            # a small set may need more room after some tries
            out = cls(seed + 0x9E3779B9 * attempt, segment, segments + attempt // 20, np.zeros(segment * (segments + attempt // 20 + 2), np.uint8))
            if out._fill(keys):
                return out
        raise RuntimeError("no seed gave a binary-fuse filter")

    def _fill(self, keys: np.ndarray) -> bool:
        places, prints = self._places(keys)
        size, n = len(self.table), len(keys)
        count = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the keys' numbers in each place
        for row in places:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        alone = np.flatnonzero(count == 1)
        done = 0
        while len(alone):
            peeled, first = np.unique(held[alone], return_index=True)
            rounds.append((peeled, alone[first]))
            done += len(peeled)
            touched = places[:, peeled]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, peeled)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if done < n:
            return False
        for peeled, own in reversed(rounds):
            three = places[:, peeled]
            self.table[own] = 0
            self.table[own] = prints[peeled] ^ np.bitwise_xor.reduce(self.table[three], axis=0)
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(np.asarray(keys, dtype=np.uint64))
        return np.bitwise_xor.reduce(self.table[places], axis=0) == prints


def _key(digests) -> np.ndarray:
    """The first 8 bytes of each binary digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


_FILTER = "bucket int, seed long, segment int, segments int, data binary"


def _load(seed, segment, segments, data) -> BinaryFuse8:
    return BinaryFuse8(int(seed), int(segment), int(segments), np.frombuffer(data, np.uint8))


@dataclass
class Snapshot:
    """Filters of an immutable set of digests, one row a bucket, in the shared folder."""

    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, digests: DataFrame, column: str = "sha") -> "Snapshot":
        """``digests`` need not be distinct; equal ones are merged before the shuffle."""
        spark = digests.sparkSession
        distinct = digests.select(F.col(column).alias("sha")).where(F.col("sha").isNotNull()).distinct()
        n = distinct.agg(F.count(F.lit(1))).first()[0]
        buckets = max(4 * partitions(spark), -(-n // BUCKET_KEYS))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            f = BinaryFuse8.build(_key(pdf["sha"]))
            return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "data": [f.table.tobytes()]})

        rows = distinct.withColumn("bucket", _bucket(F.col("sha"), buckets)).groupBy("bucket").applyInPandas(build, _FILTER)
        return cls(cut(rows), buckets)

    def small(self) -> bool:
        return (self.filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= BROADCAST_BYTES

    def screen(self, digest: Column) -> Column:
        """Whether a digest may be in the snapshot; only if ``small``."""
        from pyspark.sql.functions import pandas_udf

        spark = self.filters.sparkSession
        shared = spark.sparkContext.broadcast([tuple(r) for r in self.filters.collect()])

        @pandas_udf("boolean")
        def maybe(bucket: pd.Series, sha: pd.Series) -> pd.Series:
            filters = {b: _load(*rest) for b, *rest in shared.value}
            out = np.zeros(len(sha), bool)
            places: dict[int, np.ndarray] = pd.Series(np.arange(len(bucket))).groupby(bucket.to_numpy()).indices
            keys = _key(sha)
            for b, rows in places.items():
                if b in filters:
                    out[rows] = filters[b].contains(keys[rows])
            return pd.Series(out)

        return maybe(_bucket(digest, self.buckets), digest)

    def positives(self, digests: DataFrame) -> DataFrame:
        """Distinct ``sha`` of ``digests`` that may be in the snapshot."""
        distinct = digests.select("sha").where(F.col("sha").isNotNull()).distinct()
        if self.small():
            return distinct.where(self.screen(F.col("sha")))

        def meet(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if filters.empty:
                return rows.iloc[:0][["sha"]]
            f = _load(*filters.iloc[0][["seed", "segment", "segments", "data"]])
            return rows.loc[f.contains(_key(rows["sha"])), ["sha"]] if len(rows) else rows[["sha"]]

        rows = distinct.withColumn("bucket", _bucket(F.col("sha"), self.buckets))
        return self.filters.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(meet, "sha binary")


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _rows_of(base: DataFrame, snapshot: Snapshot, digests: DataFrame) -> DataFrame:
    """The rows of ``base`` whose digest ``snapshot`` may hold, screened before any shuffle if possible."""
    if snapshot.small():
        return base.where(snapshot.screen(F.col("sha")))
    return base.join(snapshot.positives(digests), "sha", "left_semi")


def _mixed(rows: DataFrame) -> DataFrame:
    """Digests whose texts' bytes aren't all equal. Merged before the shuffle."""
    return rows.groupBy("sha").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi")


def _groups(thin: DataFrame) -> DataFrame:
    """(__sha, first, group_size) of each group of equal digests.

    The new batch is grouped by itself and screened by the snapshot's
    filters: a negative group is whole, a positive one meets the snapshot's
    exact buckets. Both joins are of rows distinct in the digest.
    """
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("rid").alias("rid"))).alias("first")
    grouped = lambda rows: cut(rows.groupBy("sha").agg(first, F.count(F.lit(1)).alias("group_size")))
    old, new = grouped(thin.where("__old")), grouped(thin.where("NOT __old"))
    snapshot = Snapshot.of(old)
    if snapshot.small():
        screened = cut(new.withColumn("maybe", snapshot.screen(F.col("sha"))))
    else:
        hits = snapshot.positives(new).withColumn("maybe", F.lit(True))
        screened = cut(new.join(hits, "sha", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))))
    negative = screened.where("NOT maybe").select(F.col("sha").alias("__sha"), "first", "group_size")
    positive = screened.where("maybe").select("sha", F.col("first").alias("new_first"), F.col("group_size").alias("new_size"))
    size = F.coalesce("group_size", F.lit(0)) + F.coalesce("new_size", F.lit(0))
    met = old.join(positive, "sha", "full").select(F.col("sha").alias("__sha"), F.least("first", "new_first").alias("first"), size.alias("group_size"))
    return negative.union(met)


def dedup(docs: DataFrame, in_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha binary, rid, keep_id, group_size, kept), a row for each input row.

    ``in_snapshot`` tells the rows of the immutable snapshot from the new
    batch; by default, half of the ids by hash. Null text counts as empty;
    empty texts equal each other. The smallest id stays; null ids come last,
    and of rows equal in id and text one stays. Hot texts are merged by
    partial aggregation before each shuffle; the last join, on narrow rows,
    has shuffles on both sides that Spark can split. Other columns are
    ignored, whatever their names. Should two texts share a digest, digests
    are extended by an MD5 of the text and the grouping starts again.
    """
    if in_snapshot is None:
        in_snapshot = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(in_snapshot, F.lit(False)).alias("__old"), normalised(F.col(text_col)).alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    rid = F.monotonically_increasing_id().alias("rid")
    rows = cut(base.select("__id", "__old", "sha", rid))
    groups = cut(_groups(rows))
    # only rows that share a digest carry texts, wherever their copies lie
    several = cut(groups.where("group_size > 1").select(F.col("__sha").alias("sha")))
    if _mixed(_rows_of(base, Snapshot.of(several), several)).limit(1).count():
        rows = cut(base.select("__id", "__old", F.concat("sha", F.unhex(F.md5(F.col("norm").cast("binary")))).alias("sha"), rid))
        groups = cut(_groups(rows))
    out = rows.join(groups, F.col("sha") == F.col("__sha"))
    return out.select(F.col("__id").alias(id_col), "sha", "rid", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.rid") == F.col("rid")).alias("kept"))


#: Dropped ids up to this many are broadcast (8 bytes each if they are integers, as doc_id is).
BROADCAST_IDS = 1_000_000


def keep_rows(docs: DataFrame, decided: DataFrame, key: str, key_of: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, with their columns.

    ``decided`` has (id, ``key``, kept) for each row; ``key_of`` computes
    ``key`` from a row of ``docs``. With unique ids the dropped ids decide,
    broadcast while they are few; then no text is shuffled. With null or
    repeated ids, rows meet on id and key, and of rows equal in both as many
    stay as were kept.
    """
    decided = cut(decided.select(F.col(id_col).alias("__kid"), F.col(key).alias("__key"), F.col("kept")))
    dropped = decided.where("NOT kept").select("__kid")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if decided.groupBy("__kid").count().where("count > 1 OR __kid IS NULL").limit(1).count() == 0:
        return docs.join(F.broadcast(dropped) if few else dropped, F.col(id_col) == F.col("__kid"), "left_anti")
    from pyspark.sql import Window

    stay = decided.where("kept").groupBy("__kid", "__key").agg(F.count(F.lit(1)).alias("__n"))
    rows = docs.withColumn("__own", key_of)
    met = rows.join(stay, F.col(id_col).eqNullSafe(F.col("__kid")) & F.col("__own").eqNullSafe(F.col("__key")))
    place = F.row_number().over(Window.partitionBy("__kid", "__key").orderBy("__n"))
    return met.withColumn("__place", place).where("__place <= __n").select(*[F.col(f"`{c}`") for c in docs.columns])
