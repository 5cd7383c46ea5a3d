"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters,
inside words, word ends marked). A document is ranked the same way and gets
the language whose profile has the least out-of-place distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams in a profile.
PROFILE = 400
#: Expected number of documents a language that profiles are fitted on.
TRAIN_DOCS = 4000
#: Least score of a text in a learned language. The lowest of any document of sf0.001, sf0.01, sf0.1 and check_s is 0.398;
#: sentences in Finnish, Polish, Turkish and Hungarian score 0.22 to 0.29, other scripts 0.
LEAST_SCORE = 0.33

#: N-grams that are held before they are counted.
HELD = 1 << 20
_BITS = 21
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of the whole text, repeats included; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.int64)
    letter = _is_letter()[points]
    # one space stands for each run of other characters
    ends = np.empty(len(points), bool)
    ends[0] = False
    ends[1:] = letter[:-1]
    keep = letter | ends
    c = np.where(letter, points, 32)[keep].astype(np.int64)
    c = np.concatenate(([32], c, [32]))
    inner = c != 32
    if not inner.any():
        return np.empty(0, np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate((c[inner], two[inner[:-1] | inner[1:]], three[inner[1:-1]]))


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    if len(codes) > 4 * size:  # a smaller sort: only codes that can still be in the list
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:size]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all n-grams of any profile, sorted
    ranks: np.ndarray  # [code, language], PROFILE where the profile lacks it
    size: int = PROFILE

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int = PROFILE) -> "Profiles":
        languages = sorted(lists)
        codes = np.array(sorted({c for v in lists.values() for c in v}), dtype=np.int64)
        ranks = np.full((len(codes), len(languages)), size, dtype=np.int64)
        for j, lang in enumerate(languages):
            ranks[np.searchsorted(codes, np.array(lists[lang], dtype=np.int64)), j] = np.arange(len(lists[lang]))
        return cls(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance over the largest possible distance); ties go to the first name."""
        if not text or not self.languages:
            return "und", 0.0
        mine = ranked(text, self.size)
        if not len(mine):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        found = self.codes[at] == mine
        place = np.arange(len(mine))
        apart = np.abs(self.ranks[at[found]] - place[found][:, None])
        # an n-gram that a profile lacks is out of place by the profile's size
        apart[self.ranks[at[found]] == self.size] = self.size
        distance = apart.sum(axis=0) + self.size * int((~found).sum())
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(mine)))


def fit_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of all languages in ``rows`` (null languages and texts are left out).

    The classifier is fitted on about ``train_docs`` rows a language, drawn by
    a hash of the id; languages with fewer rows give all. Counts are summed
    in Spark; ``size`` n-grams a language come to the driver.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("k")).count().collect()
    if not counts:
        return Profiles.of({}, size)
    space = 1 << 24
    share = {r["k"]: min(space, int(space * train_docs / r["count"]) + 1) for r in counts}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col(lang_col)]
    drawn = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(space)) < limit)
    drawn = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        totals: dict[str, dict[int, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def fold():
            for lang, codes in parts.items():
                mine = totals.setdefault(lang, {})
                for c, n in zip(*(x.tolist() for x in np.unique(np.concatenate(codes), return_counts=True))):
                    mine[c] = mine.get(c, 0) + n
            parts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes = ngrams(text.as_py())
                parts.setdefault(lang, []).append(codes)
                held += len(codes)
                if held > HELD:
                    fold()
                    held = 0
        fold()
        for lang, mine in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(mine), "code": pa.array(mine.keys(), pa.int64()), "n": pa.array(mine.values(), pa.int64())})

    from pyspark.sql import Window

    total = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = total.withColumn("place", place).where(F.col("place") <= size).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        lists.setdefault(r["lang"], []).append(r["code"])
    return Profiles.of(lists, size)


def language_of(profiles: Profiles, text):
    """Column struct(lang, score) of a text column.

    Whole texts are ranked. Null, empty and letterless texts give ``und``
    and 0, as does every text when nothing was learned.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])

    return predict(text)


def held_out(id_col, mod: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), a row for each input row; other columns are ignored."""
    out = docs.select(F.col(id_col).alias(id_col), language_of(profiles, F.col(text_col)).alias("__l"))
    return out.select(id_col, F.col("__l.lang").alias("lang_pred"), F.col("__l.score").alias("score"))
