"""URL rules, exact dedup, SimHash, packing and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
from docweave.llm import components, exact_dedup, packing, queries, simhash, url_filter

BYTE = public_tokenizers.path("byte_bpe_50k.json")


# URL rules


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return (host, path, *(best or (None, "allow")))


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Net/", "http://a.b.EXAMPLE.net/en/x?y#z", "http://a.example.net/enx", "ftp://org/fr/", "http://x.org/fr", "http://sub.example.com/de/1", "http://example.com?/de/",
        "http://x.net", "http://x.net?q=/", "http://x.net#/a", "://net/a", "a://b.net/://c.org/fr/", "http://notnet/", "http://xexample.com/de/", "http://É.Ä.net/ß", "http://..net/", "http://a.net/\nb", "http://" + "a." * 500 + "net/" + "p/" * 5000,
    ]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(4, "http://Net/", "h", "r")] * 2 + [(None, "http://b.net/", None, None), (None, None, None, None), (4, "http://other.org/fr/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, queries.RULES)).collect()
    want = Counter((r[0], *plain_judge(r[1], queries.RULES)) for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, queries.RULES)).collect() == []
    none = url_filter.judge(pages, spark.createDataFrame([], url_filter.rules_table(spark, queries.RULES).schema)).collect()
    assert len(none) == len(rows) and {r["verdict"] for r in none} == {"allow"}


# exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 20000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact_dedup.BinaryFuse8.build(np.concatenate((keys, keys[: n // 3])))
    assert f.contains(keys).all()
    if n:
        assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.02
    if n == 20000:
        assert len(f.table) < 1.4 * n


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


@pytest.mark.parametrize("by_bucket", [False, True])
def test_exact_dedup(spark, odd_docs, no_docs, by_bucket, monkeypatch):
    if by_bucket:
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", -1)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    groups = plain_groups(rows)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_dedup.dedup(odd_docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["sha"]).hex()) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.dedup(no_docs).collect() == []


def test_filters_decide(spark, monkeypatch):
    """Without positives no new text meets the snapshot; copies of the new batch alone are grouped all the same."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b"), (5, "b"), (4, "c")], "doc_id long, text string")
    old = F.col("doc_id") % 2 == 0
    groups = lambda: {(r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(docs, old).collect()}
    assert groups() == {(0, 3), (3, 2), (4, 1)}
    monkeypatch.setattr(exact_dedup.Snapshot, "screen", lambda self, digest: digest.isNull())
    monkeypatch.setattr(exact_dedup, "_rows_of", lambda base, *_: base)
    assert groups() == {(0, 2), (1, 1), (3, 2), (4, 1)}


@pytest.mark.parametrize("old", [0, 1, 2])
def test_bytes_are_compared_in_every_group(spark, old, monkeypatch):
    """Texts that share a digest stay apart, both in the snapshot, both new, or one in each."""
    from pyspark.sql import functions as F

    sha2 = F.sha2
    monkeypatch.setattr(F, "sha2", lambda col, bits: sha2(F.substring(col, 1, 1), bits))
    docs = spark.createDataFrame([(0, "a1"), (1, "a2"), (2, "b"), (3, "b")], "doc_id long, text string")
    got = exact_dedup.dedup(docs, F.col("doc_id") < old).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {0: (0, 1), 1: (1, 1), 2: (2, 2), 3: (2, 2)}


@pytest.mark.parametrize("few", [1_000_000, -1])
def test_keep_rows(spark, odd_docs, few, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", few)
    key = exact_dedup.digest_of(odd_docs["text"])
    left = exact_dedup.keep_rows(odd_docs, exact_dedup.dedup(odd_docs), "sha", key)
    groups = plain_groups((r["doc_id"], r["text"]) for r in odd_docs.collect())
    assert left.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(min((i for i in v if i is not None), default=None) for v in groups.values())
    plain = spark.createDataFrame([(i, f"t{i // 2}", "k") for i in range(40)], "doc_id long, text string, kept string")
    left = exact_dedup.keep_rows(plain, exact_dedup.dedup(plain), "sha", exact_dedup.digest_of(plain["text"]))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 40, 2))


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Root of each fingerprint by comparing all pairs."""
    fps = sorted(set(fps))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {fp: fps[find(i)] for i, fp in enumerate(fps)}


def test_every_pair_within_the_radius_meets():
    masks = simhash.free_masks()
    assert len(masks) == 13 and max(m.bit_count() for m in masks) <= 20
    for a in range(64):
        for b in range(64):
            assert any(m >> a & 1 and m >> b & 1 for m in masks)


def test_fingerprints_and_components(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_docs.collect()]
    roots = plain_components(fp for _, fp in rows)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[roots[fp]] = min(least.get(roots[fp], i), i)
    got = simhash.near_duplicates(odd_docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter((i, fp, least.get(roots[fp])) for i, fp in rows)
    assert simhash.near_duplicates(no_docs).collect() == []
    left = simhash.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == Counter(least.values())


def test_links_of_dense_clusters(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        own = rng.sample(range(64), 14)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in rng.sample(own, rng.randint(0, 5))))
    chain = rng.getrandbits(64)
    for b in rng.sample(range(64), 40):
        chain ^= 1 << b
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    want = plain_components(fps)
    distinct = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = components.connected_components(simhash.links(distinct)).collect()
    root = {r["node"]: r["root"] for r in found}
    assert len(root) == len(found)
    mine = defaultdict(set)
    for f in fps:
        mine[root.get(simhash._signed(f), simhash._signed(f))].add(f)
    theirs = defaultdict(set)
    for f, r in want.items():
        theirs[r].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def plain_similar(a, b):
    """Jaccard similarity of the lower-cased 5-word shingles."""
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def plain_survivors(texts):
    """The smallest id of each group linked by two bits or by 5-word shingles of Jaccard similarity 0.8."""
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, fps = sorted(texts), {i: plain_fingerprint(t) for i, t in texts.items()}
    for at, i in enumerate(ids):
        for j in ids[:at]:
            if (fps[i] ^ fps[j]).bit_count() <= 2 or (texts[i] or "").split() and (texts[j] or "").split() and plain_similar(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


@pytest.mark.parametrize("cell", [1 << 24, 4000])
def test_near_copies_beyond_the_radius(spark, cell, monkeypatch):
    """Loose groups, short texts and copies, in whole cells and in grids: groups equal those of comparing all pairs."""
    import corpus_pipeline
    from docweave.llm import shingles

    monkeypatch.setattr(shingles, "CELL_BYTES", cell)

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = ["two words", "Two  words", "other words", "", " "]
    for _ in range(4):
        base = [word() for _ in range(150)]
        for edits in (0, 1, 2, 3, 4, 6, 8, 12, 3, 2):
            own = list(base)
            for at in rng.sample(range(150), edits):
                own[at] = word()
            texts.append(" ".join(own))
    texts.append(texts[-1])
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [plain_fingerprint(t) for t in texts]
    beyond = 0
    for i, t in enumerate(texts):
        for j in range(i):
            alike, near = bool(t.split()) and bool(texts[j].split()) and plain_similar(t, texts[j]) >= 0.8, (fps[i] ^ fps[j]).bit_count() <= 2
            beyond += alike and not near
            if alike or near:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert beyond > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(docs, similar=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}
    left = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({find(i) for i in range(len(texts))})


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# packing


def check_packed(rows, docs, capacity=2048):
    t = Tokenizer.from_file(BYTE)
    t.no_padding()
    t.no_truncation()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
    want = Counter()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, j, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"])) if "ids" in r else r["ids_crc32"]) for r in (x.asDict() for x in rows)) == want
    return len(by)


@pytest.mark.parametrize("few", [1_000_000, -1])
def test_packing(spark, odd_docs, no_docs, few, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", few)
    rows = packing.pack(odd_docs, BYTE).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert packing.pack(no_docs, BYTE).collect() == []


def test_packing_of_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op9_packing(spark, sf).collect()
    n = check_packed(rows, docs)
    assert n <= best_fit([r["length"] for r in rows], 2048) * 1.01 + 1


def test_large_joins_move_no_ids(spark, sf, monkeypatch):
    """Where the counts aren't broadcast, the query's join has the digest in place of the ids."""
    monkeypatch.setattr(packing, "BROADCAST_ROWS", -1)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = queries.op9_packing(spark, sf)
    check_packed(made.collect(), docs)
    plan = made._jdf.queryExecution().optimizedPlan()
    found = []
    walk = [plan]
    while walk:
        node = walk.pop()
        if node.nodeName() == "Join":
            found += [str(node.output().apply(i).dataType().typeName()) for i in range(node.output().size())]
        walk += [node.children().apply(i) for i in range(node.children().size())]
    assert found and "binary" not in found


def best_fit(lengths, capacity):
    gaps = Counter()
    n = 0
    for length in sorted(lengths, reverse=True):
        gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
        if gap is None:
            gap, n = capacity, n + 1
        else:
            gaps[gap] -= 1
        gaps[gap - length] += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    n = [1, 50, 3000, 3000, 20000, 400][seed]
    lengths = np.clip(rng.lognormal(6, [1, 1, 1, 0.2, 1.4, 0.01][seed], n), 1, 2048).astype(int)
    plan = packing.plan(dict(Counter(lengths.tolist())), 2048)
    rank = np.zeros(len(lengths), np.int64)
    seen = Counter()
    for i, x in enumerate(lengths):
        rank[i] = seen[x]
        seen[x] += 1
    seq, off = plan.place(lengths, rank)
    order = np.lexsort((off, seq))
    at, last = 0, -1
    for i in order:
        at = 0 if seq[i] != last else at
        last = seq[i]
        assert off[i] == at
        at += lengths[i]
        assert at <= 2048
    assert len(set(seq.tolist())) == plan.sequences
    assert plan.sequences <= max(best_fit(lengths.tolist(), 2048) * 1.01 + 1, -(-int(lengths.sum()) // 2048))


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((8, 20))
    truth = np.where(rng.random(20) < 0.2, rng.random(20), 0)
    x = packing.nnls(a, a @ truth)
    assert (x >= 0).all() and np.allclose(a @ x, a @ truth, atol=1e-5)


def test_fast_encoder_equals_library():
    t = Tokenizer.from_file(BYTE)
    encode = packing._encoder(BYTE)
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([32, 32, 10, rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x370, 0x1FFF), rng.randint(0x4E00, 0x4EFF)])) for _ in range(40)) for _ in range(1500)]
    for text in [*texts, "<|endoftext|>a", "a  \n b\t\tc   ", "x" * 3000]:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


# pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"] for r in docs.collect()}
        gone = set(before) - now
        if name == "toxicity":
            assert sum(labels.get(i, 0) == 0 for i in gone if i in labels) <= 1
        elif name == "language_id":
            assert not gone
        elif name == "exact_dedup":
            groups = plain_groups((i, r["text"]) for i, r in before.items())
            assert now == {min(v) for v in groups.values()}
        else:
            assert now == plain_survivors({i: r["text"] for i, r in before.items()})
        before = {i: r for i, r in before.items() if i in now}
    check_packed(stages["packing"](spark, docs, sf).collect(), [(i, r["text"]) for i, r in before.items()])


def test_unlike_languages_go(spark, sf):
    """Texts in languages and scripts that no profile has are rejected; all others stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由 在尊严和权利上一律平等",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar", "123 !", None,
    ]
    odd = spark.createDataFrame([(-1 - i, t, None, "s", 0) for i, t in enumerate(other)], docs.schema)
    left = corpus_pipeline.drop_unknown_language(spark, docs.union(odd), sf)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, sf):
    import corpus_pipeline

    own = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (own, no_docs.select(own.columns)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, got.select(cols).toPandas().astype(str).values.tolist())) == sorted(map(str, want.df()[cols].astype(str).values.tolist()))
