"""Small documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size long"


def make_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "rot", "blau", "grün", "maison", "café", "Über", "niño", "agua"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        if i % 6 == 0:
            text += "\n" + text.split("\n")[0]
        rows.append((i, text, ["en", "de", "fr"][i % 3], f"s{i % 4}", len(text), 0.5, 3, 9))
    base = " ".join(rng.choices(words, k=80))
    rows += [(100 + k, base, "en", "s0", 1, None, None, None) for k in range(12)]
    rows += [(200 + k, base + " extra" * (k % 2) + f" {words[k % 12]}", "en", "s0", 1, None, None, None) for k in range(12)]
    rows += [
        (300, None, None, None, None, None, None, None), (301, "", "en", "s1", 0, None, None, None), (302, " \t\n\r", None, None, 4, None, None, None),
        (303, "one", "en", "é", 3, None, None, None), (304, "one", "en", "é", 3, None, None, None), (304, "one", "en", "é", 3, None, None, None),
        (305, "other text of the same id", "en", "z", 3, None, None, None), (305, "something else with the id", "en", "z", 3, None, None, None),
        (None, "no id at all here", "en", "z", 3, None, None, None), (306, "long " * 30_000, "en", "s0", 150_000, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
