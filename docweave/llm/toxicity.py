"""Toxicity scores by weak supervision.

Many lexicon and pattern voters look at a text; a generative label model
estimates each voter's accuracy and the correlations between voters by EM;
a linear classifier is trained on the posterior labels and scores whole
texts. Labelled rows (a bounded sample) only suggest lexicon entries and act
as one more voter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import cut

#: Expected labelled rows of each class that a model is fitted on.
TRAIN_ROWS = 5000
#: Most lexicon voters that labels may suggest: the size of the model. Those of greatest surprise are taken.
VOTERS = 96
#: Letters of the word beginnings that may become voters, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Least share of the words that an entry matches that toxic texts hold, so that marks of a language aren't taken for marks of toxicity.
PURE = 2 / 3
#: Jaccard similarity of 5-word shingles from which rows of a class count once for the lexicon: loose copies repeat words too.
ALIKE = 0.5
#: Voters that are there before any label is seen; the label model finds what they are worth.
SEEDS = "idiot moron stupid dumb loser pathetic worthless scum trash disgusting clown fool jerk ugly hate imbecile vermin filth".split()
_WORD = re.compile(r"[^\W\d_]+")


def entries(text: str, prefixes: tuple[int, ...] = PREFIXES) -> Counter:
    """Lexicon candidates of a text with the different words that each matches: its words, and ``xxxx*`` for longer words' beginnings."""
    words = set(_WORD.findall(text.lower()))
    out = Counter(words)
    for n in prefixes:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    lexicon: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -4.0
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None
    _automaton: object = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def hits(self, text: str | None) -> tuple[dict[int, int], int]:
        """(occurrences by lexicon voter, length of the text)."""
        if not text or not self.lexicon:
            return {}, len(text or "")
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            ends: dict[str, list[tuple[int, bool]]] = {}
            for i, w in enumerate(self.lexicon):
                ends.setdefault(w.rstrip("*"), []).append((i, w.endswith("*")))
            for w, v in ends.items():
                self._automaton.add_word(w, (len(w), v))
            self._automaton.make_automaton()
        low = text.lower()
        found: dict[int, int] = {}
        for end, (n, voters) in self._automaton.iter(low):
            before = low[end - n] if end >= n else " "
            after = low[end + 1] if end + 1 < len(low) else " "
            if not before.isalpha():
                for i, prefix in voters:
                    if prefix == after.isalpha():
                        found[i] = found.get(i, 0) + 1
        return found, len(low)

    @staticmethod
    def features(found: dict[int, int], length: int, voters: int) -> np.ndarray:
        """Lexicon votes, then pattern votes: any entry, several entries, dense entries, none."""
        x = np.zeros(voters + 4)
        x[list(found)] = 1
        total = sum(found.values())
        x[voters:] = total > 0, total > 2, total * 400 > length > 0, total == 0
        return x

    def score(self, text: str | None) -> float:
        found, length = self.hits(text)
        z = float(self.features(found, length, len(self.lexicon)) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 20):
    """Generative model of binary voters, fitted by EM from the annotators' votes.

    Returns (posteriors, accuracies [voter, class], correlations). A voter
    fires given the class with its own rate; correlated voters, as seen in
    residuals within classes, share their evidence: each counts as one over
    the sum of its correlations. The annotators are the last voter.
    """
    v = np.column_stack((votes, labels)).astype(float)
    q = np.where(labels > 0, 0.98, 0.02)
    for _ in range(rounds):
        rates = []
        for c in (1 - q, q):
            w = c * weight
            rates.append(((v * w[:, None]).sum(0) + 0.05) / (w.sum() + 0.1))
        clean, toxic = (np.clip(r, 1e-4, 1 - 1e-4) for r in rates)
        prior = np.clip((q * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        residual = v - (q[:, None] * toxic + (1 - q[:, None]) * clean)
        residual = residual * np.sqrt(weight)[:, None]
        scale = np.sqrt((residual**2).sum(0)) + 1e-9
        corr = np.abs((residual.T @ residual) / np.outer(scale, scale))
        np.fill_diagonal(corr, 1)
        share = 1 / np.where(corr > 0.1, corr, 0).sum(0).clip(1)
        share[-1] = 1
        log_odds = np.log(prior / (1 - prior)) + (v * (np.log(toxic / clean) * share) + (1 - v) * (np.log((1 - toxic) / (1 - clean)) * share)).sum(1)
        q = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return q, np.column_stack((1 - clean, toxic)), corr


def linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (p - q)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _alone(rows: DataFrame) -> DataFrame:
    """(text, toxic): of each class's rows that are near copies of each other, the one with the smallest id.

    Near copies are those that exact similarity of 5-word shingles links,
    from ``ALIKE`` on; a single pair at 0.5 is missed in one case of eight.
    ``rows`` has text, toxic and __id, and is bounded, as are the links and
    ids that come to the driver.
    """
    from docweave.llm import shingles
    from docweave.llm.simhash import _Roots

    placed = rows.withColumn("rid", F.monotonically_increasing_id())
    own = placed.select("__id", "rid", "toxic", F.xxhash64("text").alias("node")).collect()
    pairs = shingles.links(rows.select("text"), text_hash, least=ALIKE).distinct().collect()
    place = {node: i for i, node in enumerate(sorted({r["node"] for r in own}))}
    roots = _Roots(len(place))
    roots.link(*np.array([(place[r["u"]], place[r["v"]]) for r in pairs], dtype=np.int64).reshape(-1, 2).T)
    first: dict[tuple[int, int], tuple] = {}
    for r in own:
        at, mine = (int(roots.parent[place[r["node"]]]), r["toxic"]), (r["__id"], r["node"], r["rid"])
        first[at] = min(first.get(at, mine), mine)
    kept = rows.sparkSession.createDataFrame([(v[2],) for v in first.values()], "rid long")
    return placed.join(F.broadcast(kept), "rid", "left_semi").select("text", "toxic")


def text_hash(text: str) -> int:
    """XXH64 of the text, as ``F.xxhash64`` gives it, without sign."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, voters: int = VOTERS, prefixes: tuple[int, ...] = PREFIXES) -> Model:
    """A model from labelled rows (``labels`` holds those that may be learned from).

    An entry that at least two toxic texts have may vote if its share of
    toxic words is a surprise: counted are pairs of a text and a different
    word in it that the entry matches, against all such pairs, and toxic
    texts must hold ``PURE`` of those it matches. So a few texts are enough
    where each has many words of one beginning.

    About ``train_rows`` rows of each class, drawn by a hash of the id, are
    joined with their texts; the drawn ids, whose number that parameter
    bounds, are broadcast. Null labels, ids and texts are left out. Without
    a labelled row of each class the model scores every text alike, low.
    """
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model()
    space = 1 << 24
    share = {k: min(1.0, train_rows / n) for k, n in totals.items()}
    limit = F.when(F.col("toxic") == 1, F.lit(int(space * share[1]) + 1)).otherwise(F.lit(int(space * share[0]) + 1))
    drawn = labels.where(F.pmod(F.xxhash64("__id"), F.lit(space)) < limit).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    rows = cut(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(drawn), "__id").select("text", "toxic", "__id"))

    def count(batches):
        seen: dict[str, list[int]] = {}  # clean and toxic texts, clean and toxic words
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                own = entries(text.as_py(), prefixes)
                own[""] = sum(n for e, n in own.items() if not e.endswith("*"))  # all of the text's words
                for e, n in own.items():
                    at = seen.setdefault(e, [0, 0, 0, 0])
                    at[toxic] += 1
                    at[2 + toxic] += n
        columns = {name: pa.array([v[i] for v in seen.values()], pa.int64()) for i, name in enumerate(("clean", "toxic", "clean_words", "toxic_words"))}
        yield pa.RecordBatch.from_pydict({"entry": pa.array(seen.keys(), pa.string())} | columns)

    # near copies of a text say no more about its words than the text does
    alone = _alone(rows)
    n = {r["toxic"]: r["count"] for r in alone.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "clean_words", "toxic_words")]
    found = cut(alone.mapInArrow(count, "entry string, clean long, toxic long, clean_words long, toxic_words long").groupBy("entry").agg(*sums).where("toxic > 1 OR entry = ''"))
    whole = found.where("entry = ''").first()
    found = found.where("entry <> ''")
    if not whole["toxic_words"] or not whole["clean_words"]:
        found = found.limit(0)
    expected = whole["toxic_words"] / max(whole["toxic_words"] + whole["clean_words"], 1)
    share_toxic = n[1] / (n[0] + n[1])
    # log-likelihood ratio against chance, beyond what the best of so many candidates reaches by chance
    part = F.col("toxic_words") / (F.col("toxic_words") + F.col("clean_words"))
    surprise = 2 * (F.col("toxic_words") * F.log(part / expected) + F.when(F.col("clean_words") > 0, F.col("clean_words") * F.log((1 - part) / (1 - expected))).otherwise(0.0))
    least = 2 * float(np.log(max(found.count(), 1)))
    often = F.col("toxic") / (F.col("toxic") + F.col("clean")) > 3 * share_toxic / (1 + 2 * share_toxic)
    best = found.where(often & (part > expected) & (part >= PURE)).select("entry", "toxic", surprise.alias("gain")).where(F.col("gain") > least)
    # no more than the bounded sample's texts hold
    best = best.orderBy(F.desc("gain"), F.col("entry").endswith("*"), F.desc(F.length("entry")), "entry").collect()
    chosen: dict[str, int] = dict.fromkeys(SEEDS, 0)
    for r in best:
        entry, word = r["entry"], r["entry"].rstrip("*")
        if entry in chosen:
            chosen[entry] = r["toxic"]
            continue
        # one that chosen beginnings cover, or whose own words are mostly chosen, adds no voter
        covered = any(e.endswith("*") and word.startswith(e[:-1]) for e in chosen)
        within = sum(k for e, k in chosen.items() if entry.endswith("*") and e.rstrip("*").startswith(word))
        if len(chosen) < voters + len(SEEDS) and not covered and within < 0.8 * r["toxic"]:
            chosen[entry] = r["toxic"]
    lexicon = list(chosen)
    model = Model(lexicon)

    def look(batches):
        for b in batches:
            found = [model.hits(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"voter": pa.array([list(f) for f, _ in found], pa.list_(pa.int32())), "n": pa.array([list(f.values()) for f, _ in found], pa.list_(pa.int32())), "length": pa.array([m for _, m in found], pa.int64()), "toxic": b.column(1)})

    seen = rows.mapInArrow(look, "voter array<int>, n array<int>, length long, toxic int").collect()
    x = np.array([Model.features(dict(zip(r["voter"], r["n"])), r["length"], len(lexicon)) for r in seen])
    y = np.array([r["toxic"] for r in seen])
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    weight = weight * len(y) / weight.sum()
    q, model.accuracies, model.correlations = label_model(x, y, weight)
    model.weights, model.bias = linear(x, q, weight)
    return model


def score_of(model: Model, text):
    """Column with the score of a text column; null and empty texts are scored by the patterns alone."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), a row for each input row; other columns are ignored.

    Equal texts get equal scores; ``predicted`` is 1 from ``THRESHOLD`` on.
    """
    out = docs.select(F.col(id_col).alias(id_col), score_of(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
