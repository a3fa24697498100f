"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, doc long, kept boolean, size long"


def odd_rows(seed: int = 0) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "idiot", "a@b.org"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [prose(rnd.randint(1, 80)) for _ in range(60)]
    line = "one line that very many of these documents hold in the same words, over fifty bytes of it"
    texts += [f"{prose(20)}\n{line}\n{prose(20)}" for _ in range(20)]
    texts += [texts[3]] * 6
    for k in (5, 8, 9):  # near copies
        w = texts[k].split(" ")
        texts += [" ".join(w[:i] + ["changed"] + w[i + 1 :]) for i in (0, len(w) - 1)]
    long = prose(4000)
    texts += [long, long + " tail", None, "", " ", "\n\t", "x", "😀 é", "x" * 3000, "A a A a A a"]
    rows = [(i, t, "en", f"s{rnd.choice('abc')}" if i % 3 else "hot", len(t or ""), -1, -2, False, 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], None, None, None, None, None, None, None), (500, "only null source", None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
