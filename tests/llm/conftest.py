import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, kept string, bucket int, size long, key string, begin long, a long, shard long"


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ab", "cde", "ing", "é", "ß", "stupid", "X", "##"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    base = prose(300)
    texts = [None, "", " \n\t", "a", "x y z", "one two three four five", base, base, base.upper(), base + " tail", base[: len(base) // 2], prose(20000), "the same " * 700, "é" * 500, "\x00\x1c \U0001f600 <|endoftext|> token=abcdefgh", "same line\n" * 50]
    texts += [prose(rng.randrange(1, 200)) for _ in range(24)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 0.5, "n", "k", i, 1, "key", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all", None, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
