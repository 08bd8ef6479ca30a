"""Whitening against exact arithmetic and numpy's own eigenvectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relfold.llm.queries import QUERIES
from relfold.llm.whitening import Centre, fit_whitening, triangular_solve, whiten

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows):
    """{(vec_id, place): (deviation, x - S/n)}, n and covariance, from exact sums over the distinct x."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = lambda x: [(n * x[j] - sums[j]) / n for j in range(d)]
    z = np.array([centred(x) for x in fit])
    return [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), np.array(centred(x))) for i, x in kept], n, z.T @ z / n, z


def check(rows, found, components=16, tolerance=1e-8):
    kept, n, v, z = plain(rows)
    size = min(components, len(v))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == len(kept) * size
    assert {r["n"] for r in found} == {n}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] <= 1e-6
    fits = lambda v: v if v < 1 << 63 else -1
    assert sorted((r["vec_id"], -1 if r["deviation"] is None else r["deviation"]) for r in found) == sorted((i, fits(dev)) for i, dev, _ in kept for _ in range(size))
    by_component = {}
    for r in found:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6, abs=1e-12)
        by_component.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
    for c, pairs in by_component.items():
        gap = min([abs(values[c - 1] - e) for k, e in enumerate(values) if k != c - 1], default=1)
        if values[c - 1] <= 1e-14 * values[0]:
            assert all(w is None for _, w in pairs)
        elif gap > 1e-6 * values[0]:  # within equal values any basis will do
            expected = sorted((i, float(x @ axes[:, c - 1] / np.sqrt(values[c - 1]))) for i, _, x in kept)
            mirrored = sorted((i, -w) for i, w in expected)
            assert any(np.allclose([w for _, w in sorted(pairs)], [w for _, w in e], atol=tolerance) for e in (expected, mirrored))


def test_whitening_against_exact_sums(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1 + j) + (j == 3) * 50 for j in range(20)]) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)]  # repeated vectors weigh once
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [1.0] * 19 + [float("inf")])]
    df = spark.createDataFrame(rows + [(2004, [1.0]), (2005, [])], SCHEMA).withColumns({"x": F.lit(1), "component": F.lit("a"), "m": F.lit(2)}).repartition(5)
    check(rows, whiten(df).collect())


def test_few_dimensions_and_columns_that_depend_on_each_other(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        a, b = rng.randint(-900, 900) / 64, rng.randint(-40, 40) / 64
        rows.append((k, [a, b, a, 7.0, a + b]))
    check(rows, whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_badly_conditioned_rows(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) * 10.0 ** (5 - j) for j in range(6)]) for k in range(300)]
    check(rows, whiten(spark.createDataFrame(rows, SCHEMA)).collect(), tolerance=1e-6)


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(1, [0.5, -1.0]), (2, [0.5, -1.0]), (None, [0.5, -1.0])], SCHEMA)
    found = whiten(one).collect()
    assert len(found) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(1, 0, None, None, 0.0)}
    assert whiten(one.limit(0)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0


def test_exact_deviations_beyond_machine_integers():
    centre = Centre(3, (3 * 10**9 + 1, 5))
    x = np.array([[10**9, 2], [10**9 + 4 * 10**8, 1]])
    expected = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, centre.sums)) for row in x]
    assert centre.deviations(x) == expected
    assert centre.deviations(np.array([[1 << 60, 0]])) == [None]


def test_triangular_solve_and_factors(spark):
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(7, 7))) + 5 * np.eye(7)
    rows = rng.normal(size=(30, 7))
    assert np.allclose(triangular_solve(rows, r) @ r, rows)
    fit = spark.createDataFrame([([int(v) for v in row],) for row in rng.integers(0, 1000, (500, 7))], "x array<bigint>").distinct()
    model = fit_whitening(fit, 7)
    assert 3 <= model.passes <= 4 and np.allclose(model.components.T @ model.components, np.eye(7), atol=1e-12)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, QUERIES["op11_whitening"](spark, SF_DIR).collect())
