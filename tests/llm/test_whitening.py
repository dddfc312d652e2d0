import numpy as np
import pytest
from pyspark.sql import functions as F

from scene_analytics.llm import whitening as wh


def brute(vectors, most=32):
    """n, deviations, eigenvalues, eigenvectors by the covariance matrix itself."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, deviation, e[::-1][:most], v[:, ::-1][:, :most], e.sum(), c


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]).tolist()


def result(spark, tmp_path, rows, schema="vec_id long, embedding array<double>"):
    spark.createDataFrame(rows, schema).withColumn("x", F.lit(1)).withColumn("whitened", F.lit("a")).write.parquet(f"{tmp_path}/embeddings.parquet")
    return wh.op13_whitening(spark, str(tmp_path)).collect()


def test_against_the_covariance(spark, tmp_path):
    v = vectors(700, 40)
    bad = [(9001, None), (9002, []), (9003, [1.0] * 39 + [None]), (9004, [float("nan")] * 40), (9005, [float("inf")] + [0.0] * 39), (9006, [1.0] * 3)]
    rows = [(i, x) for i, x in enumerate(v)] + bad + [(None, v[3]), (5, v[5])]
    got = result(spark, tmp_path, rows)
    n, deviation, e, comp, trace, c = brute(v + [v[3], v[5]])
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    ids = [*range(700), None, 5]
    white = c @ comp / np.sqrt(e)
    table = {}
    for r in got:
        table.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for k in range(1, 33):
        mine = np.array([table[k][i][0]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, k - 1])
        assert np.allclose(mine * sign, white[:, k - 1], atol=1e-7)
        assert table[k][0][0]["explained"] == pytest.approx(e[k - 1] / trace, rel=1e-9)
    assert len(table[1][5]) == 2 and [table[1][i][0]["deviation"] for i in ids] == deviation
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_no_rows_no_variance_few_rows(spark, tmp_path):
    assert result(spark, tmp_path / "a", [(1, None)]) == []
    assert result(spark, tmp_path / "b", [(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    got = result(spark, tmp_path / "c", [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 0.0])])
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1)] and abs(abs(got[0]["whitened"]) - 1) < 1e-12
    assert got[0]["explained"] == pytest.approx(1)


def test_rotations_keep_small_singular_values():
    rng = np.random.default_rng(3)
    u, v = (np.linalg.qr(rng.normal(size=(12, 12)))[0] for _ in "uv")
    scale = 10.0 ** -np.arange(12)
    s, w = wh.jacobi_svd((u @ v.T) * scale)  # columns of very different lengths
    exact = wh.jacobi_svd(np.linalg.qr((u @ v.T) * scale)[1])[0]
    assert np.allclose(s, exact, rtol=1e-12) and np.allclose(w.T @ w, np.eye(12), atol=1e-14)
    for shape in ((1, 1), (2, 2), (7, 7)):
        a = rng.normal(size=shape)
        assert np.allclose(wh.jacobi_svd(a)[0], np.linalg.svd(a)[1])
    assert wh.jacobi_svd(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_triangles_of_many_parts(spark):
    x = [(i, [int(v) for v in r]) for i, r in enumerate(np.random.default_rng(1).integers(-90, 90, (900, 5)))]
    rows = spark.createDataFrame(x, "vec_id long, x array<long>")
    one, many = wh.fit(rows.coalesce(1), 5), wh.fit(rows.repartition(40), 5)
    assert np.allclose(one.variances, many.variances, rtol=1e-12) and np.allclose(np.abs(one.components.T @ many.components), np.eye(5), atol=1e-9)


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1 << 40, 0]), (2, [0, 1 << 40])], "vec_id long, x array<long>")
    with pytest.raises(Exception, match="beyond a long"):
        wh.whiten(rows, "vec_id", wh.fit(rows, 2)).collect()
