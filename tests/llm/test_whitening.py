"""Whitening against numpy in one piece."""

import gc
import math
import time

import numpy as np
import pytest

from fidelis.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, _index long, component string"


def plain(vectors, components=32):
    """(n, deviations, whitened, explained) of a list of vectors of one length."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return n, deviations, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def _held(rows, ids, vectors):
    n, deviations, whitened, explained = plain(vectors)
    size = whitened.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * size
    table = np.array([[got[i, k + 1]["whitened"] for k in range(size)] for i in ids])
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table * signs - whitened).max() < 1e-8
    assert np.abs(table.T @ table / n - np.eye(size)).max() < 1e-8
    for i, d in zip(ids, deviations, strict=True):
        assert {got[i, k + 1]["deviation"] for k in range(size)} == {d}
    assert np.allclose([got[ids[0], k + 1]["explained"] for k in range(size)], explained, rtol=1e-9)
    assert {r["n"] for r in rows} == {n} and 0 <= rows[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in rows}) == 1


def test_query_on_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    _held(queries.op13_whitening(spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks_and_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 1)
    rng = np.random.default_rng(3)
    mixed = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    short = [(i, (rng.normal(size=2) * [4, 1]).tolist()) for i in range(100, 120)]
    left_out = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("-inf")] * 5), (204, [])]
    rows = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in mixed + short + left_out], SCHEMA).repartition(5)
    got = whitening.whiten(rows).collect()
    _held([r for r in got if r["vec_id"] < 100], *map(list, zip(*mixed, strict=True)))
    _held([r for r in got if r["vec_id"] >= 100], *map(list, zip(*short, strict=True)))


def test_no_variance_repeated_rows_and_empty_tables(spark):
    alike = spark.createDataFrame([(1, [1.0, 2.0], 1, 1, "x"), (1, [1.0, 2.0], 1, 1, "x"), (None, [1.0, 2.0], 1, 1, "x")], SCHEMA)
    got = whitening.whiten(alike).collect()
    assert len(got) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(3, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 0.0], 1, 1, "x") for i in (0, 2)], SCHEMA)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(line).collect()}
    assert abs(got[0, 1]["whitened"]) == pytest.approx(1) and got[0, 1]["explained"] == pytest.approx(1) and got[0, 2]["whitened"] is None
    assert whitening.whiten(line.limit(0)).collect() == []
    assert whitening.whiten(line.limit(0)).columns == list(whitening.WHITENED)
    huge = spark.createDataFrame([(i, [x, 0.0], 1, 1, "x") for i, x in enumerate((1e300, -1e300, 3.0))], SCHEMA)
    assert len(whitening.whiten(huge).collect()) == 6


def test_deviations_beyond_a_long_are_null(spark):
    rows = spark.createDataFrame([(i, [1e10 * i], 1, 1, "x") for i in range(3)], SCHEMA)
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows).collect()} == {0: None, 1: 0, 2: None}


def test_matrices_stay_named_while_the_jvm_reads_them(spark, monkeypatch):
    """A matrix whose Python wrapper is collected is dropped by the JVM a little later: the call here comes after that."""
    call = whitening.callMLlibFunc

    def late(*args):
        gc.collect()
        time.sleep(2)
        return call(*args)

    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    vectors = np.random.default_rng(4).normal(0, 3, (12, 3)).tolist()
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    _held(rows, list(range(12)), vectors)
