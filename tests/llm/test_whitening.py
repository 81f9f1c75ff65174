"""Whitening against exact integer moments and a dense eigensolver; the solver on matrices of known spectrum."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sofralytics.llm import whitening
from sofralytics.llm.queries import QUERIES


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def on_lattice(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def plain(vectors):
    """(n, sums, eigenvalues, eigenvectors, trace) of the distinct lattice vectors."""
    x = sorted({on_lattice(v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    return n, sums, values[::-1], turn[:, ::-1], float((apart * apart).sum() / n)


def test_query_against_a_dense_solver(spark, small):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if usable(r["embedding"])}
    n, sums, values, turn, trace = plain(rows.values())
    found = QUERIES["op12_whitening"](spark, small).collect()
    assert len(found) == 16 * len(rows)
    by_component = defaultdict(dict)
    for r in found:
        x = on_lattice(rows[r["vec_id"]])
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
        by_component[r["component"]][r["vec_id"]] = r["whitened"]
    assert sorted(by_component) == list(range(1, 17))
    for k, got in by_component.items():
        want = {i: float(np.dot([a - s / n for a, s in zip(on_lattice(v), sums, strict=True)], turn[:, k - 1]) / math.sqrt(values[k - 1])) for i, v in rows.items()}
        sign = math.copysign(1, sum(got[i] * want[i] for i in rows))
        assert max(abs(sign * got[i] - want[i]) for i in rows) < 1e-7


@pytest.mark.parametrize(
    "spectrum",
    [
        np.r_[np.linspace(100, 50, 9), 1 + 0.001 * np.arange(191)[::-1]],
        1 / np.arange(1, 301.0),
        np.r_[[5.0] * 7, np.ones(93)],
        np.r_[np.ones(3), np.zeros(27)],
        np.array([3.0, 2.0, 1.0]),
        np.array([2.0]),
    ],
    ids=["bulk", "decaying", "multiple", "low rank", "three", "one"],
)
def test_solver_on_known_spectra(spectrum):
    size = len(spectrum)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((size, size)))[0]
    dense = (basis * spectrum) @ basis.T
    values, vectors, _ = whitening.jacobi_davidson(lambda block: dense @ block, size, 16)
    want = np.sort(spectrum)[::-1][:16]
    assert np.abs(values - want).max() < 1e-11 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(dense @ vectors - vectors * values, axis=0).max() < 1e-12 * want[0]


def test_minres_solves_indefinite_systems_together():
    random = np.random.default_rng(3)
    basis = np.linalg.qr(random.standard_normal((12, 12)))[0]
    dense = (basis * np.r_[np.linspace(-3, -1, 5), np.linspace(1, 4, 7)]) @ basis.T
    right = random.standard_normal((12, 3))
    right[:, 1] = 0
    found = whitening.minres(lambda t: dense @ t, right, 60, 1e-13)
    assert np.abs(dense @ found - right).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, _x string, whitened int")


def test_odd_rows(spark):
    random = np.random.default_rng(5)
    good = [(i, random.standard_normal(6).tolist(), "a", i) for i in range(40)]
    odd = [(100, None, None, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], "b", 1), (102, [float("nan")] * 6, "b", 1), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], "b", 1), (104, [], "b", 1), (105, [1.0, 2.0], "b", 1), (106, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0], "b", 1)]
    rows = frame(spark, [*good, good[0], (None, good[1][1], None, None), *odd])
    model = whitening.fit(rows, "embedding", 16)
    assert model.n == 40 and len(model.values) == 6 and model.identity_error < 1e-9
    found = whitening.whitened(rows, "embedding", model)
    assert found.columns == ["vec_id", "embedding", "_x", "deviation", "whitened"]
    got = found.collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted([*map(str, range(40)), "0", "None"])
    assert len({tuple(r["whitened"]) for r in got if r["vec_id"] == 0}) == 1


def test_flat_directions_equal_vectors_and_empty_tables(spark):
    flat = frame(spark, [(i, [float(i), 2.0 * i, 7.0], "a", i) for i in range(20)])
    model = whitening.fit(flat, "embedding", 16)
    assert len(model.values) == 1 and model.identity_error < 1e-9
    for rows in ([(i, [1.0, 2.0], "a", 1) for i in range(5)], []):
        table = frame(spark, rows)
        model = whitening.fit(table, "embedding", 16)
        assert model.explained == []
        assert [len(r["whitened"]) for r in whitening.whitened(table, "embedding", model).collect()] == [0] * len(rows)


def test_exact_sums_beyond_machine_words():
    rows = np.array([[2**49, 5], [-(2**49), 6], [3, 7]], dtype=np.int64)
    sums = tuple(int(s) for s in rows.sum(axis=0))
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows]
    assert whitening.deviations(rows, 3, sums) == [w if w < 2**63 else None for w in want]


def test_hot_vector_counts_once(spark):
    random = np.random.default_rng(6)
    base = [(i, random.standard_normal(4).tolist(), "a", i) for i in range(30)]
    once = whitening.fit(frame(spark, base), "embedding", 4)
    hot = whitening.fit(frame(spark, base + [base[0]] * 500), "embedding", 4)
    assert hot.n == once.n and hot.sums == once.sums and np.allclose(hot.values, once.values)


def test_more_components_than_rank(spark):
    rows = frame(spark, [(i, [float(i % 2), 0.0, float(i % 3)], "a", i) for i in range(12)])
    model = whitening.fit(rows, "embedding", 16)
    assert len(model.values) == 2
    assert rows.select(F.max(F.size(whitening.lattice(F.col("embedding"))))).first()[0] == 3
