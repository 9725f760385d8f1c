"""Hard negatives against a plain loop over all pairs."""

import itertools
import math
import random

import pytest

from fidelis.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, _tag string, rank int"


def plain(rows, every, p, n, low, high):
    """All pairs, in lists."""
    whole = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a, label, v in whole:
        if a % every:
            continue
        met = [(sum(x * y for x, y in zip(v, w, strict=True)), j, own) for j, own, w in whole if j != a and len(w) == len(v)]
        met = sorted((max(-(2**63), min(2**63 - 1, s)), j, own) for s, j, own in met)
        met.sort(key=lambda m: (-m[0], m[1]))
        for score, j, _ in [m for m in met if m[2] == label][:p]:
            fit = [m for m in met if m[2] != label and low * score <= 100 * m[0] <= high * score][:n]
            out += [(a, j, r, m[1], score, m[0]) for r, m in enumerate(fit, 1)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)


def _odd(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(4)], rng.randrange(3)) for i in range(160)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(200, 260)]  # ties
    rows += [(i, [0.0] * 4, i % 3) for i in range(300, 320)]  # windows of nothing but zero
    rows += [(400, [1.0, 2.0], 0), (401, [1.0, 2.0], 0), (402, [0.5, 1.4], 1), (410, [], 0), (411, [], 0), (412, [], 1)]
    rows += [(None, [1.0] * 4, 0), (420, None, 0), (430, [1.0] * 4, None), (440, [1.0, None, 1.0, 1.0], 0), (450, [float("nan")] * 4, 0), (460, [float("inf")] * 4, 0)]
    rows += [(500, [1e30, 0.0, 0.0, 0.0], 0), (501, [1e30, 0.0, 0.0, 0.0], 1), (510, [1e12, 1e12, -1e12, 1.0], 0), (511, [7e11, 7e11, 1.0, 1.0], 1)]
    return rows + rows[:3] + [(10, [9.0, 9.0, 9.0, 9.0], 1)]  # repeated rows; an id again with another vector


@pytest.mark.parametrize("shard_rows", [16, 10_000])
def test_against_all_pairs(spark, shard_rows):
    rows = _odd(1)
    got = negatives.mine(_frame(spark, rows), every=10, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 10, 5, 3, 50, 95)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("p,n,low,high", [(1, 1, 0, 100), (3, 40, 10, 60)])
def test_other_parameters(spark, p, n, low, high):
    rows = _odd(2)
    got = negatives.mine(_frame(spark, rows), every=20, positives=p, negatives=n, low=low, high=high, shard_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 20, p, n, low, high)


def test_small_tables(spark):
    assert negatives.mine(_frame(spark, []).limit(0)).collect() == []
    assert negatives.mine(_frame(spark, [(0, [1.0], 0)])).collect() == []
    assert negatives.mine(_frame(spark, [(0, [1.0], 0), (1, [1.0], 0)])).collect() == []
    with pytest.raises(ValueError):
        negatives.mine(_frame(spark, []), high=120)


def test_keys_sort_as_told():
    parts = [(a, t, s, p, o) for a, t, s, p, o in itertools.product((-5, 0, 7), (-1, 3), (-(2**63), -1, 0, 2**63 - 1), (True, False), (-2, 4))]
    random.Random(1).shuffle(parts)
    assert sorted(parts, key=lambda k: negatives.pack(*k)) == sorted(parts, key=lambda k: (k[0], k[1], -k[2], not k[3], k[4]))
