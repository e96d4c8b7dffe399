import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, part int, shard int, kept boolean, n int"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "ti", "on", "wh", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Ordinary texts, null and empty ones, a very long one, ties, repeated rows and null ids. The further columns have names that
    operators might use themselves."""
    rng = random.Random(7)
    base = words(rng, 60)
    texts = [base, base, base.replace("an", "on", 1), words(rng, 80), None, "", "  \n\t ", "one", "Übung für Ärzte, ½ ☃ 汉字.", words(rng, 40_000), "a\nb\na\n" + words(rng, 30), "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, ("en", None, "de")[i % 3], ("s", None)[i % 5 == 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, None), (None, words(rng, 25), None, "s", 3), (None, None, None, None, None)]
    return [(*r, "k", "i", 3, 5, True, 9) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    """The odd rows as a table of files, and an empty table of the same columns."""
    base = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(odd_rows, DOCS)
    df.repartition(3).write.parquet(f"{base}/docs")
    df.limit(0).write.parquet(f"{base}/none")
    return spark.read.parquet(f"{base}/docs"), spark.read.schema(df.schema).parquet(f"{base}/none")
