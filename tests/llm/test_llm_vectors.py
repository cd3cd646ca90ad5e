"""Whitening against numpy in whole numbers, and on rows that take no part."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from alignframe.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, id string, x int, block int"


def vectors(spark, rows):
    """Extra columns bear names that the operator uses inside."""
    return spark.createDataFrame([(i, v, "y", 1, 2) for i, v in rows], SCHEMA)


def check(rows, got, components=32):
    whole = [(i, np.floor(64 * np.array(v, dtype="f4").astype(float)).astype(int) + 1_000_000) for i, v in rows]
    x = np.stack([v for _, v in whole])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    e, u = e[order], u[:, order]
    assert len(got) == n * len(order)
    by_component = {c: sorted((r["whitened"], r["deviation"]) for r in got if r["component"] == c + 1) for c in range(len(order))}
    for c in range(len(order)):
        z = centred @ u[:, c] / math.sqrt(e[c])
        options = [sorted(zip(s * z, ((n * x - sums) ** 2).sum(axis=1))) for s in (1, -1)]
        assert any(np.allclose([a for a, _ in o], [a for a, _ in by_component[c]], atol=1e-8) for o in options)
        assert sorted(d for _, d in by_component[c]) == sorted(d for _, d in options[0])
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-9)


def test_whitened_as_by_numpy(spark):
    rng = np.random.default_rng(3)
    good = [(int(i % 70) if i % 9 else None, (rng.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(90)]
    bad = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0]), (3, [math.nan] + [0.0] * 4), (4, [math.inf] + [0.0] * 4), (5, []), (6, [1.0, 2.0]), (7, [1e30] + [0.0] * 4)]
    table = vectors(spark, good + bad)
    # Many blocks, the last of each task filled up, and several slabs.
    got = whitening.whiten(table, block_entries=35, slab=4).collect()
    check(good, got)
    check(good, whitening.whiten(table, components=3).collect(), 3)


def test_rows_without_variance_and_empty_tables(spark):
    empty = whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(2, 0, None, None, None)] * 4
    # The second component has no variance.
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 7.0]) for i in range(8)])).collect()
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True}
    assert all(r["whitened"] is not None and r["identity_error"] < 1e-9 for r in flat if r["component"] == 1)


def test_query_over_all_vectors(spark, tiny):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding").collect()
    whole = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(whole, entry.queries()["op11_whitening"](spark, tiny).collect())
