"""Sharding, language ID, media, toxicity, records, BPE against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docweave.llm import bpe, language_id, media, queries, sharding, token_records, toxicity

WORD = public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = sharding.Feistel(n, 3)
    p = f.position(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert (f.row(p) == np.arange(n)).all()
    assert n < 100 or (p != np.arange(n)).mean() > 0.9


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(odd_docs, no_docs):
    rows = sharding.shard_rows(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_shards(rows, 16)
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts
    assert sharding.shard_rows(no_docs).collect() == []
    for r in rows[:5]:
        assert sharding.row_at(len(rows), 16, r["shard"], r["slot"]) == r["row_number"]


def test_row_numbers_follow_the_sorted_list(odd_docs):
    """Numbers are places in the list of all rows by (id, size, crc), nulls first."""
    rows = sorted(sharding.shard_rows(odd_docs).collect(), key=lambda r: r["row_number"])
    own = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    want = sorted(((i is not None, i or 0), len(t) + 1, zlib.crc32(t)) for i, t in own)
    assert [r["row_number"] for r in rows] == list(range(len(rows)))
    assert [((r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows] == want
    f = sharding.Feistel(len(rows), 0)
    assert [r["slot"] * 16 + r["shard"] for r in rows] == f.position(np.arange(len(rows))).tolist()


def test_shards_are_reproducible(odd_docs):
    key = lambda df: sorted((r["row_number"], r["shard"], r["slot"]) for r in df.collect())
    assert key(sharding.shard_rows(odd_docs)) == key(sharding.shard_rows(odd_docs.repartition(3)))


# language ID


def plain_ngrams(text):
    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = " " + word + " "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    if padded[i : i + n].strip():
                        out[padded[i : i + n]] += 1
            word = ""
    return out


def test_ngrams_equal_brute_force(odd_docs):
    for r in odd_docs.collect():
        text = (r["text"] or "")[:5000]
        got = Counter(language_id.ngrams(text).tolist())
        want = Counter()
        for g, n in plain_ngrams(text).items():
            code = 0
            for c in g:
                code = code << 21 | ord(c)
            want[code] += n
        assert got == want


def test_out_of_place_distance():
    p = language_id.Profiles.of({"x": language_id.ranked("aab", 4).tolist(), "y": language_id.ranked("bba", 4).tolist()}, 4)
    mine = language_id.ranked("ab ab a", 4).tolist()
    lists = {"x": language_id.ranked("aab", 4).tolist(), "y": language_id.ranked("bba", 4).tolist()}
    distance = {k: sum(abs(v.index(g) - i) if g in v else 4 for i, g in enumerate(mine)) for k, v in lists.items()}
    best = min(sorted(distance), key=distance.get)
    assert p.predict("ab ab a") == (best, pytest.approx(1 - distance[best] / (4 * len(mine))))


def test_language_edge_cases(odd_docs, no_docs):
    profiles = language_id.fit_profiles(odd_docs)
    rows = language_id.identify(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (0, 1, 2, 3):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(no_docs, language_id.fit_profiles(no_docs)).collect() == []


def test_language_accuracy(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.95


def test_language_query_equals_brute_force(spark, sf):
    """Profiles, ranks and distances of the whole query in plain Python."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    key = lambda g: [0] * (3 - len(g)) + [ord(c) for c in g]
    top = lambda counts: sorted(counts, key=lambda g: (-counts[g], key(g)))[: language_id.PROFILE]
    grams, totals = {i: plain_ngrams(t or "") for i, t, _ in docs}, {}
    for i, t, lang in docs:
        if t is not None and lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(grams[i])
    profiles = {lang: {g: place for place, g in enumerate(top(c))} for lang, c in totals.items()}
    n = language_id.PROFILE
    for r in queries.op2_language_id(spark, sf).collect():
        mine = top(grams[r["doc_id"]])
        apart = {lang: sum(abs(p[g] - i) if g in p else n for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        want = (best, pytest.approx(1 - apart[best] / (n * len(mine)))) if mine else ("und", 0.0)
        assert (r["lang_pred"], r["score"]) == want and r["held_out"] == held(r["doc_id"])


# media


def test_media_round_trip(odd_docs, no_docs):
    rows = media.digests(media.store_texts(odd_docs)).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    want = Counter()
    for (i, t), n in texts.items():
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += n
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert media.digests(media.store_texts(no_docs)).collect() == []


def test_media_digests_and_features(odd_docs):
    """The stored bytes' own digest and length; frames counted and placed by hand."""
    stored = media.store_texts(odd_docs).cache()
    files = {hashlib.sha256(r["media"]).hexdigest(): bytes(r["media"]) for r in stored.collect()}
    seen = {}
    for r in media.digests(stored).collect():
        data = files[r["media_sha256"]]
        n, start = r["payload_bytes"] // 576, len(data) - r["payload_bytes"]
        assert r["media_bytes"] == len(data) and hashlib.sha256(data[start:]).hexdigest() == r["payload_sha256"]
        ranges = ",".join(f"{start + 576 * i}+576" for i in range(n))
        want = f"codec=raw;size=32x18;duration={n * media.TICKS}/{media.TIMESCALE};samples={n};keyframes={n};ranges={hashlib.sha256(ranges.encode()).hexdigest()}"
        assert r["feature"] == want
        # equal payloads, equal containers and features
        assert seen.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    stored.unpersist()


def test_walk_other_layouts():
    """A second track, interleaved chunks, sizes of their own, stss, 64-bit box size and offsets, unknown boxes."""
    box, full = media._box, media._full
    mdat = bytes(range(200))
    head = box(b"ftyp", b"isom", b"\0" * 4) + box(b"free", b"junk") + struct.pack(">I4sQ", 1, b"mdat", 16 + len(mdat))
    base = len(head)
    sizes = [10, 20, 30, 5]
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 24, struct.pack(">HH", 64, 48), b"\0" * 50)),
        full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 7)),
        full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)),
        full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)),
        full(b"co64", struct.pack(">I2Q", 2, base + 100, base + 7)),
        full(b"stss", struct.pack(">I2I", 2, 1, 3)),
    )
    mdia = box(b"mdia", full(b"mdhd", b"\0" * 16 + struct.pack(">IQ", 90, 37) + b"\0" * 4, version=1), full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), box(b"minf", stbl))
    data = head + mdat + box(b"moov", box(b"trak", mdia), box(b"trak", box(b"mdia", full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13))))
    first, second = media.inspect(data)
    assert (first.codec, first.width, first.height, first.timescale, first.duration) == ("avc1", 64, 48, 90, 37)
    assert first.keyframes() == [(base + 100, 10), (base + 27, 30)]
    assert first.read(data) == mdat[100:110] + mdat[7:62]
    assert second.kind == "soun" and second.keyframes() == []
    for broken in (data[:-9], data[:40], b"\0\0\0\x04abcd"):
        with pytest.raises(ValueError):
            media.inspect(broken)
    assert media.inspect(b"") == []


def test_sample_sizes_are_checked():
    """A count beyond the file is refused before memory is taken; small sizes are unpacked; fragments are refused."""
    good = media.build(media.pad(b"x" * 1200))
    at = good.index(b"stsz")
    with pytest.raises(ValueError):
        media.inspect(good[: at + 12] + struct.pack(">I", 0xFFFFFFFF) + good[at + 16 :])
    full = lambda kind, body: struct.pack(">I4sI", 12 + len(body), kind, 0) + body
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    for bits, packed in ((4, b"\x31\x20"), (8, b"\x03\x01\x02"), (16, b"\0\x03\0\x01\0\x02")):
        head = box(b"mdat", b"abcdef")
        tables = full(b"stz2", struct.pack(">xxxBI", bits, 3) + packed) + full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)) + full(b"stco", struct.pack(">II", 1, 8))
        (track,) = media.inspect(head + box(b"trak", box(b"stbl", tables)))
        assert track.sizes.tolist() == [3, 1, 2] and track.read(head) == b"abcdef"
    with pytest.raises(ValueError):
        media.inspect(box(b"trak", b"") + box(b"moof", box(b"traf", full(b"trun", b"\0" * 8))))


# toxicity


def test_toxicity_held_out(spark, sf):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    found = sum(r["predicted"] and labels[r["doc_id"]] for r in held)
    assert found >= 0.9 * sum(labels[r["doc_id"]] for r in held)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    for lang in {langs[r["doc_id"]] for r in held if labels[r["doc_id"]]}:
        own = [r["predicted"] for r in held if labels[r["doc_id"]] and langs[r["doc_id"]] == lang]
        assert sum(own) >= 0.75 * len(own), lang
    assert sum(r["predicted"] and not labels[r["doc_id"]] for r in held) <= 0.03 * len(held)


def test_only_near_copies_count_once(spark):
    """Texts that share a passage count each when the lexicon is learned; near copies of one text count once."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, copied = some(36), some(80)
    rows = [(i, f"{shared} {some(11)} {'zuzuk' if i % 2 else word()} {some(12)}", i % 2) for i in range(24)]
    rows += [(100 + i, f"{copied} vuvuk {word()}", 1) for i in range(24)] + [(200 + i, some(40), 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    lexicon = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).lexicon
    assert any("zuzuk".startswith(e.rstrip("*")) for e in lexicon)
    assert not any("vuvuk".startswith(e.rstrip("*")) for e in lexicon)
    alone = toxicity._alone(docs.withColumnRenamed("doc_id", "__id").coalesce(1).checkpoint()).collect()
    assert sorted(r["text"] for r in alone) == sorted(t for i, t, _ in rows if not 100 < i < 200)


def test_toxicity_edge_cases(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(23)] + [(None, 1, None), (3, None, None), (5, 1, "t")], "doc_id long, toxic int, text string")
    for own in (none, labels):
        rows = toxicity.score_rows(odd_docs, toxicity.fit(odd_docs, own)).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score_rows(no_docs, toxicity.fit(no_docs, labels)).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y)
    poor = np.where(rng.random(4000) < 0.6, y, ~y)
    votes = np.column_stack((good, good, poor)).astype(float)
    q, rates, corr = toxicity.label_model(votes, np.where(rng.random(4000) < 0.97, y, ~y).astype(int), np.ones(4000))
    assert abs(rates[0, 1] - 0.9) < 0.05 and abs(rates[2, 1] - 0.6) < 0.06
    assert corr[0, 1] > 0.9 > 0.3 > corr[0, 2]
    assert ((q > 0.5) == y).mean() > 0.95


def test_posteriors_correct_labels():
    """With several independent voters the posteriors are nearer to the truth than the labels that started them."""
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y)
    votes, labels = np.column_stack([noisy(0.9) for _ in range(5)]).astype(float), noisy(0.9)
    q, rates, _ = toxicity.label_model(votes, labels.astype(int), np.ones(4000))
    assert ((q > 0.5) != labels).sum() > 200
    assert ((q > 0.5) == y).mean() > 0.97 > 0.92 > (labels == y).mean()
    assert np.abs(rates[:5] - 0.9).max() < 0.04


def test_lexicon_counts_equal_brute_force(spark):
    """A beginning that few texts use for many words gets a voter; words are counted once a text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(80)]
    texts[0] += "".join(f" zuzuk{word()}" for _ in range(6))
    texts[1] += "".join(f" zuzuk{word()}" for _ in range(6))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(80)], "doc_id long, toxic int")
    want = set()
    pairs = [(e, i, n) for i, t in enumerate(texts) for e, n in toxicity.entries(t).items()]
    total = [sum(len(set(t.split())) for t in texts[4:]), sum(len(set(t.split())) for t in texts[:4])]
    count = {}
    for e, i, n in pairs:
        c = count.setdefault(e, [0, 0, 0])
        c[2 if i >= 4 else 1] += n
        c[0] += i < 4
    often = {e: c for e, c in count.items() if c[0] > 1}
    for e, (_, toxic, clean) in often.items():
        part, expected = toxic / (toxic + clean), total[1] / sum(total)
        gain = 2 * (toxic * np.log(part / expected) + (clean * np.log((1 - part) / (1 - expected)) if clean else 0))
        if part > expected and gain > 2 * np.log(len(often)):
            want.add(e)
    lexicon = set(toxicity.fit(docs, labels).lexicon) - set(toxicity.SEEDS)
    assert lexicon and lexicon <= want and any(e.startswith("zuzu") for e in lexicon)


def test_voters_match_words_and_beginnings():
    m = toxicity.Model(["idiot", "lowei*", "low"], np.zeros(7), 0.0)
    assert m.hits("Idiot, idiots; loweihr lowei Low flow.")[0] == {0: 1, 1: 1, 2: 1}
    assert m.hits(None) == ({}, 0) and m.hits("") == ({}, 0)


# records


def test_records(spark, odd_docs, no_docs):
    parts = token_records.write(odd_docs, WORD, 2)
    rows = sorted(token_records.read(spark, parts).collect(), key=lambda r: r["start"])
    lib = library(WORD)
    want = Counter((r["doc_id"], np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for r in odd_docs.collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    k, n = 0, 0
    for p in parts:
        for i in range(p.records):
            key, one = token_records.read_at(p, i)
            assert key == rows[n]["doc_id"] and one.tobytes() == bytes(rows[n]["ids"])
            n += 1
    assert token_records.write(no_docs, WORD, 2) == [] and token_records.read(spark, []).collect() == []


def test_records_of_repeated_and_null_ids(spark):
    """Rows of one id, or without one, lie in several files, in an order that doesn't depend on partitions."""
    rng = random.Random(6)
    rows = [(None if i % 3 else 7, "".join(rng.choice("abc d") for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    found = []
    for n in (3, 8):
        parts = token_records.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), WORD, 2)
        assert len(parts) > 2 and max(p.records for p in parts) < 2000
        found.append([(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_records.read(spark, parts).orderBy("start").collect()])
    assert found[0] == found[1] and [r[0] for r in found[0]] == [None] * 2000 + [7] * 1000


def test_encoders_equal_library_on_random_texts():
    """Added tokens, combining marks, dotted capital I, unassigned and private code points, odd spaces."""
    from docweave.llm import packing

    rng = random.Random(8)
    odd = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "\u0301", "\u0307", "\u0130", "\u0131", "\u1e9e", "\u03a3", "\u0378", "\ue000", "\U000e0001", "\u00a0", "\u200b", "\u2028", "\x1c", "\x85", "'s", "'LL", "\u00bd", "\u0661", "\ud55c", "\u1112\u1161", "e\u0301", "\ufb01", "\u212b", "12", "Az", "!?", " ", "\n", "\t "]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    lib = library(WORD)
    ids, first = token_records.WordEncoder.of(WORD).encode(pa.array(texts))
    wrong = [t for t, a, b in zip(texts, first, first[1:]) if ids[a:b].tolist() != lib.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]
    byte = public_tokenizers.path("byte_bpe_50k.json")
    lib, encode = library(byte), packing._encoder(byte)
    wrong = [t for t in texts if encode(t).tolist() != lib.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]


def test_damage_is_found(spark, odd_docs):
    import io

    good = token_records.frame(b"abcdef")
    assert token_records.read_frame(io.BytesIO(good)) == b"abcdef"
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(good[:-1]))


# BPE


def test_bpe_equals_library(odd_docs, no_docs):
    lib, own = library(WORD), bpe.PairIndexBPE(WORD)
    for r in bpe.round_trip(odd_docs, WORD).collect():
        pass
    rows = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.round_trip(odd_docs, WORD).collect())
    want = Counter()
    for r in odd_docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], np.array(ids, dtype="<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)] += 1
    assert rows == want
    assert bpe.round_trip(no_docs, WORD).collect() == []
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x370, 0x1FFF), rng.randint(0x4E00, 0x4EFF)])) for _ in range(30)) for _ in range(2000)]
    texts += ["aaaaaaaaaaaaaaaaaaaaaaa", "ababababab", "lololololol" * 9]
    texts += ["H\u0331 E\u0301 \u212b", "<|ENDOFTEXT|>", "\x1c\x1f a\u2003b\u3000c", None, ""]
    for encode in (own.encode, token_records.WordEncoder(WORD).encode):
        got, first = encode(pa.array(texts))
        bad = [t for i, t in enumerate(texts) if lib.encode(t or "", add_special_tokens=False).ids != got[first[i] : first[i + 1]].tolist()]
        assert not bad, bad[:3]


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.PairIndexBPE(public_tokenizers.path("byte_bpe_50k.json"))
