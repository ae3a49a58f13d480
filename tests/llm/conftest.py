import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with null ids and texts, empty and very long texts, repeats, ties, and extra columns with clashing names."""
    rng = random.Random(7)
    words = [a + b for a in ("th", "on", "er", "re", "st", "la", "vo") for b in ("an", "ed", "ing", "o", "ur", "is")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    same = line(40)
    texts = [None, "", " ", "\n\n", "a", "One.", same, same, same, line(30_000), "x" * 100_000, "İ ΣΑΣ ﬁ é 日本 😀 \u0000   z", "tab\there  two   spaces \n end",
             "<|endoftext|> a<|startoftext|>b", *[line(rng.randint(5, 120)) for _ in range(30)]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, line(20), None, None, None), (6, same, "en", "src0", 5), (6, same, "en", "src0", 5)]
    extra = [(*r, "x", 1.5, r[0], "y", 3, True) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, k string, score double, fp long, t string, "
                                        "component int, y boolean")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
