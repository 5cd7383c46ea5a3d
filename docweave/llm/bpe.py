"""BPE encoding and decoding by a pair occurrence index.

All distinct words of a batch are laid out in one symbol array. An index
maps each pair of neighbours that has a rank to all its positions. Ranks are
applied in ascending order, each to all of its positions at once, and the
lists of the pairs that change are updated. Words are encoded once and kept.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.packing import byte_letters
from docweave.llm.words import CACHE, DOCS, binary, encode_words


class PairIndexBPE:
    """Encoder and decoder for a tokenizers file of the kind that drops white space.

    That is: NFC, white space to one space, lower case; a pattern whose
    matches are the words; bytes as letters; merges with a word-end suffix;
    no decoder, so tokens are joined by spaces. Other files are refused.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = pre.get("pretokenizers", [{}])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert") or spec["decoder"] or model["type"] != "BPE":
            raise ValueError(f"{path} is of another kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: w for w, i in self.vocab.items()} | {i: w for w, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.bytes = byte_letters()
        self.letters = {b: c for c, b in self.bytes.items()}
        self.path, self.library = path, None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = r
            self.made.append(self.vocab[a + b])
        self.plain = [self.vocab[self.letters[b]] for b in range(256)]
        self.final = [self.vocab[self.letters[b] + self.suffix] for b in range(256)]
        self.known: dict[str, bytes] = {}  # by chunk between white space
        self.words: dict[str, bytes] = {}  # by normalised word

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (its bytes), all words at once."""
        rank, made = self.rank, self.made
        symbols: list[int] = []
        for w in words:
            symbols.extend(map(self.plain.__getitem__, w[:-1]))
            if w:
                symbols.append(self.final[w[-1]])
            symbols.append(-1)  # no pair reaches over a word's end
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            if (r := rank.get(pair)) is not None:
                index.setdefault(r, []).append(at)
        active = list(index)
        heapq.heapify(active)
        get = rank.get
        pair_of = list(rank)
        while active:
            r = heapq.heappop(active)
            left, right = pair_of[r]
            new = made[r]
            # positions in order, so that of overlapping pairs the first is merged
            for at in sorted(index.pop(r)):
                nxt = after[at]
                if symbols[at] != left or nxt >= n or symbols[nxt] != right:
                    continue  # merged meanwhile
                symbols[at] = new
                symbols[nxt] = -2
                far = after[nxt]
                after[at] = far
                if far < n:
                    before[far] = at
                    if (q := get((new, symbols[far]))) is not None:
                        if q in index:
                            index[q].append(at)
                        else:
                            index[q] = [at]
                            heapq.heappush(active, q)
                prev = before[at]
                if prev >= 0 and (q := get((symbols[prev], new))) is not None:
                    if q in index:
                        index[q].append(prev)
                    else:
                        index[q] = [prev]
                        heapq.heappush(active, q)
        out: list[list[int]] = []
        own: list[int] = []
        for s in symbols:
            if s >= 0:
                own.append(s)
            elif s == -1:
                out.append(own)
                own = []
        return out

    def _words(self, chunk: str) -> list[str | int]:
        """Normalised words of a chunk without white space, and ids of added tokens."""
        out: list[str | int] = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                out.extend(self._split_by_library(part))
            elif part:
                low = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                out.extend(self.pattern.findall(low))
        return out

    def _split_by_library(self, part: str) -> list[str]:
        """Words of a part with characters that Python's Unicode tables lack and the library's may have."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.bytes.__getitem__, p)).decode("utf-8") for p, _ in pieces]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; words that no chunk had before are merged together."""
        parts = [self._words(c) for c in chunks]
        new = list({p for ps in parts for p in ps if isinstance(p, str)}.difference(self.words))
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = list({p for ps in parts for p in ps if isinstance(p, str)})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.words.update(zip(some, (array("I", ids).tobytes() for ids in self.merge([w.encode("utf-8", "surrogatepass") for w in some]))))
        return [b"".join(array("I", (p,)).tobytes() if isinstance(p, int) else self.words[p] for p in ps) for ps in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; null counts as empty."""
        return encode_words(texts, self.known, self._learn)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as without a decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_loaded: dict[str, PairIndexBPE] = {}


def load(path: str) -> PairIndexBPE:
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string), a row for each input row.

    Whole texts are encoded and their ids decoded again. Null and empty texts
    give no ids and an empty string. Rows are worked on in batches of a
    partition; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def work(batches):
        bpe = load(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                ids, first = bpe.encode(part.column(1))
                decoded = [bpe.decode(ids[i:j]) for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids, first), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return own.mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
