"""Token ids as length-delimited binary records with an offset index.

A record file is a run of frames. A frame is

    length of the data, 8 bytes | masked crc of those 8 bytes, 4 bytes
    data                        | masked crc of the data, 4 bytes

all little endian, the checksum being CRC-32 rotated right by 15 bits plus a
constant, so that data that hold checksums of themselves don't hit. The data
are a flag byte (1: the id is null), the width of a token id in bytes (2 if
all of the vocabulary's ids fit, else 4), the document id (8 bytes), and the
token ids as unsigned integers of that width. Beside each file lies an index: the
offset of each frame, unsigned 64 bits, for reads in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import open_fs, partitions, scratch
from docweave.llm.words import DOCS, encode_words

#: Fixed value of the masking rule.
MASK_DELTA = 0xA282EAD8
_HEAD, _CRC, _KEY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = _HEAD.pack(len(data))
    return b"".join((head, _CRC.pack(masked_crc(head)), data, _CRC.pack(masked_crc(data))))


def pack_record(key: int | None, ids: np.ndarray) -> bytes:
    """A frame around one document's ids, an array of unsigned integers of 2 or 4 bytes."""
    return frame(_KEY.pack(key is None, ids.itemsize, key or 0) + ids.tobytes())


def unpack_record(data: bytes) -> tuple[int | None, np.ndarray]:
    null, width, key = _KEY.unpack_from(data)
    return None if null else key, np.frombuffer(data, f"<u{width}", offset=_KEY.size).astype("<u4")


def read_frame(file, offset: int | None = None) -> bytes | None:
    """The data of the next frame, or of the one at ``offset``; None at the end. ValueError if it's damaged."""
    if offset is not None:
        file.seek(offset)
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or _CRC.unpack_from(head, 8)[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    (n,) = _HEAD.unpack_from(head)
    body = file.read(n + 4)
    if len(body) < n + 4 or _CRC.unpack_from(body, n)[0] != masked_crc(body[:n]):
        raise ValueError("damaged record data")
    return body[:n]


_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Whole-text ids by the tokenizers library for vocabularies that drop white space.

    Such a vocabulary never joins bytes across white space, so a text's ids
    are its words' ids in a row. New words are encoded by the library, many
    in one text, and kept; the word-end mark of the vocabulary tells where
    each ends.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        mark = spec["model"].get("end_of_word_suffix")
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if not mark or split.get("behavior") != "Removed" or not split.get("invert"):
            raise ValueError(f"{path} doesn't drop white space")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(mark)]] = True
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, words: list[str]) -> list[bytes]:
        # of Latin letters it is certain how the library splits them; other words are encoded alone
        ids: list[bytes | None] = [None] * len(words)
        everything = " ".join(words)
        sure = everything.isascii() and not any(a in everything for a in self.added)
        plain = [i for i, w in enumerate(words) if w and (sure or self._plain(w))]
        runs = [plain[i : i + 400] for i in range(0, len(plain), 400)]
        for run, e in zip(runs, self.library.encode_batch_fast([" ".join([words[i] for i in r]) for r in runs], add_special_tokens=False)):
            got = np.array(e.ids, dtype="<u4")
            parts = np.flatnonzero(self.ends[got]) + 1
            own = [words[i] for i in run]
            count = np.cumsum([1 if w.isalpha() else len(self.pattern.findall(w)) for w in own])
            if count[-1] != len(parts) or parts[-1] != len(got):
                continue  # encoded one by one below
            data, stops = got.tobytes(), (4 * parts[count - 1]).tolist()
            at = 0
            for i, stop in zip(run, stops):
                ids[i] = data[at:stop]
                at = stop
        rest = [i for i, v in enumerate(ids) if v is None]
        for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, dtype="<u4").tobytes()
        return ids

    def _plain(self, word: str) -> bool:
        return (word.isascii() or max(word) < "\u0250" and "\u0130" not in word) and not any(a in word for a in self.added)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; null counts as empty."""
        return encode_words(texts, self.known, self._learn)


@dataclass
class Part:
    """A record file: its path, number of records and tokens, and the tokens before it."""

    path: str
    records: int
    tokens: int
    start: int = 0


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[Part]:
    """Writes all documents' ids in ascending id order (null ids first) and returns the files in order.

    Null text counts as empty and still gives the end id. Repeated ids stay
    separate records, in the order of their texts' hashes and texts; by that
    order rows of one id, or without an id, may lie in many files. Files get names of their own for each attempt and only
    those that a finished task reports count, so a repeated or lost task
    does no harm. Counts of one row a file come to the driver.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def work(batches):
        from pyspark import TaskContext

        encoder = WordEncoder.of(tokenizer)
        kind = "<u2" if max(len(encoder.ends), end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], kind)
        number = TaskContext.get().partitionId()
        path = f"{folder}/part-{number:05d}-{uuid.uuid4().hex}.rec"
        system, local = open_fs(path)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        offset, tokens, offsets = 0, 0, []
        with system.open_output_stream(local) as out:
            for b in batches:
                for at in range(0, b.num_rows, DOCS):
                    part = b.slice(at, DOCS)
                    frames = []
                    ids, first = encoder.encode(part.column(1))
                    ids = ids.astype(kind)
                    for i, key in enumerate(part.column(0).to_pylist()):
                        f = pack_record(key, np.concatenate((ids[first[i] : first[i + 1]], end)))
                        offsets.append(offset)
                        offset += len(f)
                        frames.append(f)
                    tokens += len(ids) + part.num_rows
                    out.write(b"".join(frames))
        with system.open_output_stream(local + ".idx") as out:
            out.write(np.array(offsets, dtype="<u8").tobytes())
        if offsets:
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "path": [path], "records": [len(offsets)], "tokens": [tokens]})

    found = rows.mapInArrow(work, "part int, path string, records long, tokens long").collect()
    parts, start = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        parts.append(Part(r["path"], r["records"], r["tokens"], start))
        start += r["tokens"]
    return parts


def read(spark: SparkSession, parts: list[Part], id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids binary) from the files, every frame checked; a task a file."""
    schema = f"`{id_col}` long, start long, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)

    def work(batches):
        for b in batches:
            for path, records, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, local = open_fs(path)
                with system.open_input_stream(local, buffer_size=1 << 20) as file:
                    keys, starts, ids, size = [], [], [], 0
                    seen = 0
                    while (data := read_frame(file)) is not None:
                        key, own = unpack_record(data)
                        keys.append(key)
                        starts.append(start)
                        ids.append(own.tobytes())
                        start += len(own)
                        size += len(data)
                        seen += 1
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "start", "ids"])
                            keys, starts, ids, size = [], [], [], 0
                    if seen != records:
                        raise ValueError(f"{path} has {seen} records, not {records}")
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "start", "ids"])

    files = spark.createDataFrame([(p.path, p.records, p.start) for p in parts], "path string, records long, start long")
    return files.repartition(len(parts)).mapInArrow(work, schema)


def read_at(part: Part, record: int) -> tuple[int | None, np.ndarray]:
    """(id, ids) of one record, found by the index."""
    system, local = open_fs(part.path)
    with system.open_input_file(local + ".idx") as f:
        f.seek(8 * record)
        (offset,) = _HEAD.unpack(f.read(8))
    with system.open_input_file(local) as f:
        data = read_frame(f, offset)
    return unpack_record(data)
