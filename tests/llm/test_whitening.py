"""Whitening against whole numbers and fractions of Python's own."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    """{vec_id: (deviation, x)}, n, sums and the exact covariance."""
    kept = [(i, [math.floor(Fraction(float(np.float32(c))) * 256) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums)] for x in fit], object)
    cov = centred.T @ centred / n
    return {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums)), x) for i, x in kept}, n, sums, cov


def check(spark, rows, k=4):
    got = whitening.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], ROWS)).collect()
    want, n, sums, cov = by_hand(rows)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i in want for c in range(1, k + 1))
    values, axes = np.linalg.eigh(cov.astype(float))
    values, axes = values[::-1], axes[:, ::-1]
    signs = {}
    for r in got:
        deviation, x = want[r["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 2**63 else None)
        w = sum((float(Fraction(a) - Fraction(s, n)) * b for a, s, b in zip(x, sums, axes[:, c]))) / math.sqrt(values[c])
        sign = signs.setdefault(c, 1 if w * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign * w, rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(values[c] / float(sum(cov[j, j] for j in range(len(sums)))), rel=1e-9) and r["identity_error"] < 1e-9


def test_brute_force(spark):
    r = np.random.default_rng(13)
    for scale in (0.3, 40.0, 3e6, 1e13):
        base = r.normal(size=(150, 7)) * np.array([9, 5, 3, 2, 1, 0.7, 0.5]) * scale + scale
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
        rows += [(500 + i, v) for i, v in rows[:40]] + [(600, None), (601, []), (602, [1.0] * 6 + [None]), (603, [float("nan")] + [1.0] * 6), (604, [1.0] * 6 + [float("-inf")])]
        check(spark, rows)


def test_exact_products():
    r = np.random.default_rng(1)
    for most in (1, 2**15, 2**20 - 1, 2**20, 2**41, 2**62, 2**90):
        z = np.array([[int(r.integers(-(2**62), 2**62)) * most // 2**62 for _ in range(5)] for _ in range(64)], object)
        z[0], z[1] = most, -most
        given = z.astype(np.int64) if most < 2**63 else z
        made = sum(part.astype(object) << (whitening.LIMB * s) for s, part in whitening.gram(given, whitening.limb_count(most)).items())
        assert (made == z.T @ z).all()
    z = np.full((whitening.ROWS, 3), -(2**40) + 1, np.int64)  # the greatest sums of limbs
    made = sum(part.astype(object) << (whitening.LIMB * s) for s, part in whitening.gram(z, 2).items())
    assert (made == whitening.ROWS * (2**40 - 1) ** 2).all()


def test_numbers():
    given = np.array([-0.0, 0.001, -0.001, 1.5, -2.00390626, 1e300, -1e300, 2.0**55, 3.6028797018963967e16])
    assert whitening.whole_numbers(given).tolist() == [0, 0, -1, 384, -514, 2**63 - 1, -(2**63), 2**63 - 1, math.floor(3.6028797018963967e16 * 256) if 3.6028797018963967e16 * 256 < 2**63 else 2**63 - 1]
    x = np.array([[1, -2], [40000, -32769], [2**31, 5], [-(2**63), 2**63 - 1], [-32768, 32767]])
    packed = whitening._packed(x)
    assert [len(p) for p in packed] == [4, 8, 16, 16, 4] and (whitening._unpacked(packed, 2) == x).all()


def test_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [None], 1), (3, [], 1)], ROWS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], ROWS)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)], ROWS)).collect()
    assert len(line) == 15 and all((r["whitened"] is not None) == (r["component"] == 1) for r in line) and {round(r["explained"], 9) for r in line if r["component"] == 1} == {1.0}
    mixed = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [3.0, 0.5], 1), (4, [1.0], 1), (5, [1.0, 2.0, 3.0], 1)]
    clash = spark.createDataFrame(mixed, ROWS).withColumns({c: F.lit(1) for c in ("key", "vector", "x", "i", "n", "component")})
    assert sorted({r["vec_id"] for r in whitening.whiten(clash).collect()}) == [1, 2, 3]
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [0.0, 0.0], 1)], ROWS)).collect()
    assert len(huge) == 6 and {r["deviation"] is None for r in huge} >= {True} and all(math.isfinite(r["whitened"]) for r in huge if r["component"] == 1)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    want, n, _, _ = by_hand(rows)
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got} == {(i, c, n, d) for i, (d, _) in want.items() for c in range(1, 5)}
    assert len(got) == 4 * len(want) and {r["identity_error"] < 1e-9 for r in got} == {True}
