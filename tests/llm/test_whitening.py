"""Whitening against whole numbers of Python and numpy, and on odd rows."""

import math
import random

import numpy as np
import pytest

from quillgraph.llm import whitening
from quillgraph.llm.queries import QUERIES
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, n long, deviation string, v int"


def brute(vectors, components=32):
    """{vec_id: (deviation, whitened up to sign)}, explained, by exact sums of Python's whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors.values()]
    n, dims = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dims)]
    cov = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / n**2 for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x]) @ u / np.sqrt(e)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return dict(zip(vectors, zip(deviation, w, strict=True), strict=True)), e / np.trace(cov)


def test_against_whole_numbers(spark):
    raw = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, explained = brute(raw)
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(rows) == 32 * len(raw) and {r["component"] for r in rows} == set(range(1, 33))
    sign = {}
    for r in rows:
        deviation, w = want[r["vec_id"]]
        k = r["component"] - 1
        if abs(w[k]) > 0.1:
            sign.setdefault(k, np.sign(w[k] * r["whitened"]))  # either sign, but the same for all rows
        assert r["deviation"] == deviation and r["n"] == len(raw)
        assert abs(r["whitened"] * sign.get(k, np.sign(w[k] * r["whitened"]) or 1) - w[k]) < 1e-7
        assert abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-8


def test_residues_give_back_whole_numbers():
    r = random.Random(5)
    for bits in (1, 20, 64, 150, 300):
        moduli = whitening.primes(2 << bits)
        assert all(all(p % d for d in range(2, math.isqrt(p) + 1)) for p in moduli)
        for x in (0, 1, -1, (1 << bits) - 1, 1 - (1 << bits), r.randrange(1 << bits), -r.randrange(1 << bits)):
            assert whitening.from_residues({p: x % p for p in moduli}) == x


def test_scatter_of_large_entries_is_exact(spark):
    """Entries near 2^61 in more than a block of rows, where no float and no 64-bit sum is exact."""
    r = np.random.default_rng(2)
    v = r.choice([-1.0, 1.0], (whitening.BLOCK + 300, 3)) * r.integers(1 << 50, 1 << 53, (whitening.BLOCK + 300, 3)).astype(float)
    rows = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    x = [[int(a) for a in row] for row in whitening.whole(v)]
    products, sums = whitening.scatter(rows, 3, len(x), max(abs(a) for row in x for a in row))
    assert products == [[sum(row[i] * row[j] for row in x) for j in range(3)] for i in range(3)] and sums == [sum(row[i] for row in x) for i in range(3)]


def test_what_is_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, 1.5], [0.5, 0.25], [-2.0, 7.0]]
    bad = [None, [], [None, 1.0], [nan, 1.0], [1.0, inf], [-inf, 1.0], [1.0], [1.0, 2.0, 3.0]]
    ids = [1, 2, 2, None]
    df = spark.createDataFrame([(i, v, None, "x", 1) for i, v in zip(ids, good, strict=True)] + [(9, v, 1, None, None) for v in bad], KIND)
    got = whitening.whitened(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in got) == sorted((i is None, i, k) for i in ids for k in (1, 2))
    want, _ = brute(dict(enumerate(good)))
    assert sorted(r["deviation"] for r in got) == sorted(2 * [d for d, _ in want.values()]) and got[0]["identity_error"] < 1e-9


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(df).collect()}
    assert len(got) == 15 and got[0, 1]["whitened"] is not None and got[0, 1]["explained"] == pytest.approx(1)
    assert all(got[i, k]["whitened"] is None for i in range(5) for k in (2, 3)) and got[0, 1]["identity_error"] < 1e-9
    one = whitening.whitened(df.where("vec_id = 0")).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, 0.0, 0.0)] * 3
    assert whitening.whitened(df.where("vec_id < 0")).count() == 0
    assert whitening.whitened(df.where("vec_id < 0")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_entries_without_bound(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 3) and all(np.isfinite(r["whitened"]) for r in got if r["component"] == 1)
