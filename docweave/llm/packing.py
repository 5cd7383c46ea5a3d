"""Packing documents into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths comes to the driver: one count for each
possible length. Lengths are put into coarse bins, all patterns of up to
three bins that fill a sequence are enumerated, and their repeat counts are
fitted to the histogram by non-negative least squares and rounded down. A
pattern is carried out with real lengths, the last one chosen to fill the
sequence best; what is left is packed best-fit decreasing, also into gaps.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import cut, stored

#: Coarse bins that a full sequence is divided into.
BINS = 64
#: Rows of (partition, length) counts up to this many are broadcast (about 24 bytes each).
BROADCAST_ROWS = 400_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b| (active sets)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    for _ in range(rounds):
        gain = right - gram @ x
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-7 * max(1.0, float(b.max(initial=0))):
            break
        active[j] = True
        while True:
            own = np.flatnonzero(active)
            z = np.zeros(n)
            z[own] = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if (z[own] > 0).all():
                x = z
                break
            low = own[z[own] <= 0]
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            x[own[x[own] <= 1e-12]] = 0
            active &= x > 0
            if not active.any():
                break
    return x


def patterns(bins: int = BINS) -> list[tuple[int, ...]]:
    """All multisets of up to three bins, largest first, that fill ``bins``."""
    out = [(bins,)]
    out += [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    out += [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 0 < bins - a - b <= b]
    return out


@dataclass
class Plan:
    """Where the n-th piece of each length goes; rows sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray  # rank of the first piece of the run
    sequence: np.ndarray  # sequence of that piece
    each: np.ndarray  # pieces of the run in a sequence
    offset: np.ndarray  # place of a sequence's first piece of the run
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.first
        row = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        on, each = rank - self.first[row], self.each[row]
        return self.sequence[row] + on // each, self.offset[row] + on % each * length


@dataclass
class _Open:
    """Alike sequences: what they hold as (length, times), and how many there are."""

    holds: tuple[tuple[int, int], ...]
    count: int


@dataclass
class _Packer:
    capacity: int
    left: np.ndarray  # pieces not yet placed, by length
    open: dict[int, list[_Open]] = field(default_factory=dict)  # by gap
    gaps: list[int] = field(default_factory=list)  # sorted

    def add(self, gap: int, holds: tuple[tuple[int, int], ...], count: int) -> None:
        if gap not in self.open:
            self.open[gap] = []
            bisect.insort(self.gaps, gap)
        self.open[gap].append(_Open(holds, count))

    def take(self, gap: int) -> _Open:
        group = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap]
            self.gaps.pop(bisect.bisect_left(self.gaps, gap))
        return group

    def run_pattern(self, parts: tuple[int, ...], repeats: int, width: int) -> None:
        """Sequences with lengths from the pattern's bins, the last one filling best."""
        while repeats > 0:
            room, times = self.capacity, {}
            for i, part in enumerate(parts):
                last = i == len(parts) - 1
                high = room if last else min(room, part * width)
                low = max(0, room - 2 * width if last else (part - 1) * width)
                spare = self.left[low + 1 : high + 1].copy()
                for at, n in times.items():
                    if low < at <= high:
                        spare[at - low - 1] -= n
                found = np.flatnonzero(spare > 0)
                if not len(found):
                    return
                pick = int(low + 1 + found[-1])
                times[pick] = times.get(pick, 0) + 1
                room -= pick
            k = min(repeats, *(int(self.left[at]) // n for at, n in times.items()))
            for at, n in times.items():
                self.left[at] -= k * n
            self.add(room, tuple(times.items()), k)
            repeats -= k

    def rest(self) -> None:
        """Best-fit decreasing over whole counts, into open gaps first."""
        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                at = bisect.bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    each = self.capacity // length
                    full, more = divmod(n, each)
                    if full:
                        self.add(self.capacity - each * length, ((length, each),), full)
                    if more:
                        self.add(self.capacity - more * length, ((length, more),), 1)
                    break
                gap = self.gaps[at]
                group = self.take(gap)
                each = min(gap // length, n)
                k = min(group.count, n // each)
                if k < group.count:
                    self.add(gap, group.holds, group.count - k)
                self.add(gap - each * length, (*group.holds, (length, each)), k)
                n -= k * each
            self.left[length] = 0


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for pieces of the given lengths (1 to ``capacity``) and counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    packer = _Packer(capacity, left)
    if left[capacity]:
        packer.add(0, ((capacity, 1),), int(left[capacity]))
        left[capacity] = 0
    bins = min(BINS, capacity)
    width = -(-capacity // bins)
    bins = -(-capacity // width)
    target = np.bincount((np.arange(1, capacity + 1) - 1) // width, weights=left[1:], minlength=bins)
    shapes = patterns(bins)
    matrix = np.zeros((bins, len(shapes)))
    for j, parts in enumerate(shapes):
        for p in parts:
            matrix[p - 1, j] += 1
    repeats = np.floor(nnls(matrix, target) + 1e-6).astype(np.int64)
    for j in sorted(np.flatnonzero(repeats), key=lambda j: (-shapes[j][0], j)):
        if len(shapes[j]) > 1:
            packer.run_pattern(shapes[j], int(repeats[j]), width)
    packer.rest()
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for gap in sorted(packer.open):
        for group in packer.open[gap]:
            offset = 0
            for length, each in group.holds:
                rows.append((length, used[length], sequence, each, offset))
                used[length] += each * group.count
                offset += each * length
            sequence += group.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Plan(*table, sequence)


_tokenizers: dict[str, object] = {}


def _encoder(path: str):
    """Whole-text ids by byte-level BPE: the vocabulary of a tokenizers file, run by tiktoken.

    Both libraries give equal ids for such a file; tiktoken takes a third of
    the time. Texts that hold an added token of the file, and files of
    another kind, go to the tokenizers library itself.
    """
    if path not in _tokenizers:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("end_of_word_suffix") and not spec["normalizer"] and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        added = [t["content"] for t in spec["added_tokens"]]

        def slow(text: str) -> np.ndarray:
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")

        encode = slow
        if plain:
            byte = byte_letters()
            ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
            fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> np.ndarray:
                if any(a in text for a in added):
                    return slow(text)
                return np.array(fast.encode_ordinary(text), dtype="<u4")

        _tokenizers[path] = encode
    return _tokenizers[path]


#: Fixed value: how byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else the next from U+0100."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids binary, part, rank): whole texts as pieces of at most ``capacity`` ids.

    Null text counts as empty and is the end id alone. Only documents beyond
    ``capacity`` are cut; their first piece takes what whole pieces leave.
    ``rank`` numbers the pieces of a length within their partition ``part``.
    """
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def work(batches):
        from pyspark import TaskContext

        encode = _encoder(tokenizer)
        number = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, piece, start, length, ids, rank = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    all_ids = np.concatenate((encode(text or ""), end))
                    cut_at = len(all_ids) % capacity or capacity
                    begin = 0
                    for j, stop in enumerate(range(cut_at, len(all_ids) + 1, capacity)):
                        n = stop - begin
                        rows.append(i)
                        piece.append(j)
                        start.append(begin)
                        length.append(n)
                        ids.append(all_ids[begin:stop].tobytes())
                        rank.append(int(seen[n]))
                        seen[n] += 1
                        begin = stop
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([number] * len(rows), pa.int32()), pa.array(rank, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids", "part", "rank"],
                )

    return own.mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary, part int, rank long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, piece, start, length, ids binary, sequence_id, offset), a row for each piece.

    ``carry`` names columns that take the place of ``ids`` and are computed
    from it where the pieces are read, so that what a join has to move when
    the counts are too many to broadcast is as narrow as the caller's needs.

    Pieces are written once to the shared folder. The driver gets one count a
    length and makes the plan; a piece finds its place from its rank among
    all pieces of its length. Ranks are those within the partition plus the
    counts of earlier partitions, so a length that a third of all pieces
    have is never brought together. An empty table packs into nothing; other
    columns are ignored; repeated rows are packed one by one.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    carry = {"ids": F.col("ids")} if carry is None else carry
    made = stored(pieces(own, tokenizer, end_id, capacity, "__id", "__t"), "pieces")
    counts = made.groupBy(F.col("part").alias("p"), F.col("length").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    histogram = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut(counts.select("p", "l", before.alias("base")))
    few = bases.count() <= BROADCAST_ROWS
    thin = made.select("__id", "piece", "start", "length", "part", "rank", *[c.alias(n) for n, c in carry.items()])
    ranked = thin.join(F.broadcast(bases) if few else bases, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = shared.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("__at", place(F.col("length"), F.col("base") + F.col("rank")))
    return out.select(F.col("__id").alias(id_col), "piece", "start", "length", *carry, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
