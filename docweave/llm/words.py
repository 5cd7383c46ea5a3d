"""Batches of whole texts encoded word by word, each distinct word once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words that a worker keeps the ids of.
CACHE = 600_000
#: Letters of the longest words that are kept.
LONG = 64
#: Documents that are worked on at a time.
DOCS = 2048


def _lowered(texts: pa.Array) -> pa.Array:
    """ASCII letters in lower case, where that can't change how a lower-casing vocabulary sees the text.

    It could beside combining marks, whose bytes all lie above those of
    U+0280, and in names of added tokens.
    """
    start, end = texts.offset, texts.offset + len(texts)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)
    data = texts.buffers()[2]
    used = np.frombuffer(data, np.uint8)[offsets[start] : offsets[end]] if data is not None else np.empty(0, np.uint8)
    if (used >= 0xCA).any() or pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    return pc.ascii_lower(texts)


def encode_words(texts: pa.Array, known: dict[str, bytes], learn) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each text's ids begin and the end).

    For vocabularies that drop white space, so that a text's ids are those of
    its words in a row. ``known`` keeps words' ids as bytes of unsigned
    32-bit integers; ``learn`` gives those of a list of new words. Null
    counts as empty.
    """
    if not len(texts):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    lists = pc.ascii_split_whitespace(_lowered(pc.fill_null(texts, "")))
    first = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    ids = list(map(known.get, words))
    new = [w for w, v in zip(words, ids) if v is None]
    if new:
        if len(known) + len(new) > CACHE:
            known.clear()
        fresh = learn(new)
        left = iter(fresh)
        ids = [next(left) if v is None else v for v in ids]
        if max(map(len, new)) <= LONG:
            known.update(zip(new, fresh))
        else:
            known.update((w, v) for w, v in zip(new, fresh) if len(w) <= LONG)
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    blob = np.frombuffer(b"".join(ids), np.uint32)
    count = size[index]
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    picked = np.repeat(begin[index] - at[:-1], count)
    picked += np.arange(len(picked))
    return blob[picked], at[first - first[0]]


def binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of each text's ids; ValueError beyond 2 GB, which its offsets can't tell."""
    if len(offsets) and int(offsets[-1]) * 4 >= 1 << 31:
        raise ValueError("ids of a batch take 2 GB or more; give fewer rows at a time")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])
