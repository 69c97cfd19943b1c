"""Near vectors of shapes that codes tell little about, held against brute force: the search ends, and finds the links."""

import numpy as np
import pytest

from sitewright.llm import embeddings


def shapes():
    rng = np.random.default_rng(3)
    unit = embeddings.unit_vectors
    direction = rng.standard_normal(64)
    around = lambda n, norm: norm * direction / np.linalg.norm(direction) + np.sqrt(1 - norm**2) * unit(rng.standard_normal((n, 64)))
    isotropic = rng.standard_normal((400, 64))
    return {
        "multiples of one vector": np.arange(1, 241)[:, None] * direction,
        "a narrow cone in the plane": np.stack([np.ones(600), rng.uniform(-0.3, 0.3, 600)], 1),
        "numbers": np.append(rng.uniform(1, 2, 195), -rng.uniform(1, 2, 5))[:, None],
        "components above zero": np.abs(rng.standard_normal((500, 64))),
        "a common direction of 0.6": around(500, 0.6),
        "a common direction of 0.9": around(500, 0.9),
        "a common direction of 0.97": around(300, 0.97),
        "many more axes than bits": np.concatenate([x := rng.standard_normal((150, 200)), x + 0.3 * rng.standard_normal(x.shape)]),
        "all directions alike": np.concatenate([isotropic, isotropic[:100] + 0.04 * rng.standard_normal((100, 64)), isotropic[:60] + 0.3 * rng.standard_normal((60, 64))]),
        "five vectors": rng.standard_normal((5, 8)) + 1,
    }


def brute(vectors):
    u = embeddings.unit_vectors(vectors)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    root = np.arange(len(u))
    while True:
        low = np.minimum(root, np.where(links, root, len(u)).min(1))
        if (low == root).all():
            return links.sum(1), root
        root = low


@pytest.mark.parametrize("name", list(shapes()))
def test_shapes(spark, name):
    vectors = shapes()[name]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_vectors(df, block_vectors=150).collect())
    links, root = brute(vectors)
    have = np.array([r[1] for r in got])
    assert (have <= links).all() and have.sum() >= 0.97 * links.sum()
    if embeddings.learn(embeddings.unit_vectors(vectors), len(vectors), 0.9) is None:  # compared whole
        assert [r[1:] for r in got] == [(int(n), int(c), bool(c == k)) for k, (n, c) in enumerate(zip(links, root, strict=True))]


def test_learning_is_bounded():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50):
        for vectors in (np.ones((n, 4)) + np.arange(n)[:, None], rng.standard_normal((n, 3))):
            index = embeddings.learn(embeddings.unit_vectors(vectors), n, 0.9)
            assert index is None or index.tables <= embeddings.MOST_TABLES
    wide = embeddings.learn(embeddings.unit_vectors(rng.standard_normal((3000, 64))), 1 << 40, 0.9)
    assert wide is None or wide.tables <= embeddings.MOST_TABLES
