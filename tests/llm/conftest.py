import random

import pytest

WORDS = "the of and river stone light window garden seven quiet morning letter paper under over bridge water silver house early never winter".split()


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture()
def prose(rng):
    return lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture()
def documents(spark, rng, prose):
    """Copies, near copies, shared passages, nulls, empty and long texts, in a table with clashing and extra columns."""
    base = [prose(rng.randrange(3, 150)) for _ in range(40)]
    passage = prose(60)
    texts = list(base)
    texts += [base[0]] * 5 + [base[1] + " tail"] * 2
    for k in range(12):
        words = base[2 + k % 3].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(10)} {passage} {prose(10)}" for _ in range(6)]
    texts += ["", "  \n ", "one two", "é" * 300 + "x" + "é" * 300, "aaaa " * 200, prose(3000), "a" * 5000, "12 34 !!", None, None]
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 2}", len(t or ""), f"shard{k}", k * 2, k / 7) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, kept long, score double")


@pytest.fixture()
def rows(documents):
    return sorted(documents.select("doc_id", "text").toPandas().itertuples(index=False, name=None))


@pytest.fixture()
def no_documents(documents):
    return documents.limit(0)
