"""Vantage-point trees where distances tie, against brute force."""

import numpy as np
import pytest

from fidelis.llm import neighbours


def _depth(node):
    return 0 if node.ids is not None else 1 + max(_depth(node.inside), _depth(node.outside))


def _brute(ids, x, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def _one_hot(values, size, rng):
    x = np.zeros((len(values), size))
    x[np.arange(len(values)), values] = 1
    return x


@pytest.mark.parametrize("case", ["one-hot", "one-hot with copies", "copies of one", "simplex and dense"])
def test_ties_at_production_parameters(case):
    rng = np.random.default_rng(5)
    x = {
        "one-hot": lambda: np.eye(2000),
        "one-hot with copies": lambda: _one_hot(rng.integers(0, 300, 3000), 300, rng),
        "copies of one": lambda: np.ones((3000, 8)),
        "simplex and dense": lambda: np.concatenate([np.eye(600), rng.normal(size=(600, 600)) * 0.05]),
    }[case]()
    ids = rng.permutation(len(x)).astype(np.int64)
    tree = neighbours.build(ids, x)
    assert _depth(tree) <= np.ceil(np.log2(len(x) / neighbours.LEAF)) + 1
    asked = np.arange(0, len(x), 100)
    search = neighbours.Search(ids[asked], x[asked], neighbours.K, neighbours.FACTOR)
    search.visit(tree, np.arange(len(asked)))
    want = _brute(ids, x, asked, neighbours.K)
    for row, q in enumerate(ids[asked]):
        assert search.ids[row].tolist() == [i for i, _ in want[int(q)]]
        assert search.distances[row] == pytest.approx([d for _, d in want[int(q)]], rel=1e-12)


def test_one_hot_table_with_clashing_columns(spark):
    rows = [(i, [1.0 if j == i % 1200 else 0.0 for j in range(1200)], "x", 1, 0.5) for i in range(1300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _shard string, rank int, score double")
    got = neighbours.nearest(table, every=650).collect()
    found = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 650)}
    assert found[0][0] == (1200, 0.0) and [v for v, _ in found[0][1:]] == list(range(1, 10))
    assert [v for v, _ in found[650]] == list(range(10)) and {s for _, s in found[650]} == {float(np.sqrt(2.0))}
