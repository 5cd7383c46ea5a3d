import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size string, fp int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    base = [words(rng, n) for n in (3, 40, 200, 5)]
    texts = [
        None, "", " ", "\n\t ", "a", "A  b", "A b", "a b", "É é ß İ Σας ΑΣ 你好，世界 ½ ² Ⅷ", "x\x1cy \x1f z\x85w\u00a0v", "<|endoftext|> and <|startoftext|>x",
        "it's they'll 're 12345 a1b2", "🙂 👩‍👩‍👧 a\u0301e\u0301", *base, base[1], base[1], base[2] + " more", base[2].upper(), base[1].replace(" ", "\n "), words(rng, 60000),
    ]
    rows = [(i, t, "en" if i % 3 else None, "s", None, 0.5, True, "big", 3) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], (None, base[1], None, None, None, None, None, None, None), (None, "only null id", "de", None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, "same id, other text", "en", "s", 3, 0.1, False, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
