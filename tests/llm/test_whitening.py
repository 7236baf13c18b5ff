import numpy as np
import pytest

from spokeworks.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, n string, whitened string"


def table_of(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "clash", "clash") for k, v in enumerate(vectors)], ROWS)


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 0.5).astype(np.float32).tolist()


def check(rows, given, components):
    """Against plain eigenvectors of the covariance of the distinct whole-number vectors."""
    x = {k: np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(np.int64) for k, v in given.items()}
    fits = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fits), fits.sum(axis=0)
    cov = np.cov(fits.T, bias=True).reshape(len(sums), -1)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == len(x) * components
    for c in range(components):
        own = np.array([found[k, c + 1].whitened for k in x])
        plain = np.array([(v - sums / n) @ axes[:, c] / np.sqrt(values[c]) for v in x.values()])
        assert min(np.abs(own - plain).max(), np.abs(own + plain).max()) < 1e-8
    for k, v in x.items():
        r = found[k, 1]
        assert (r.n, int(r.deviation)) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)))
        assert abs(r.explained - values[0] / values.sum()) < 1e-9 and r.identity_error < 1e-8


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_whitened_rows_equal_plain_eigenvectors(spark, d):
    given = vectors(200, d, d)
    given += given[:70] + [given[3]] * 150 + [[-0.0] * d, [0.0] * d]  # a hot vector, counted once
    df = table_of(spark, given)
    check(whitening.whiten(df, whitening.fit(df)).collect(), dict(enumerate(given)), min(d, 4))


def test_odd_rows_are_left_out_and_repeated_ones_stay(spark):
    given = vectors(60, 6, 1)
    odd = [None, [], [1.0] * 5, [None, *[1.0] * 5], [float("nan"), *[1.0] * 5], [float("inf"), *[1.0] * 5], [1.0] * 7]
    df = table_of(spark, given + odd)
    twice = df.unionByName(df)
    model = whitening.fit(twice)
    rows = whitening.whiten(df, model).collect()
    check(rows, dict(enumerate(given)), 4)
    assert whitening.whiten(twice, model).count() == 2 * len(rows)


def test_empty_tables_and_equal_vectors_have_no_components(spark):
    for given in ([], [None, []], [[1.0, 2.0]] * 5):
        df = table_of(spark, given)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_vectors_of_a_smaller_rank_have_fewer_components(spark):
    given = [[float(a), 2.0 * a, float(b), 0.0] for a in range(6) for b in range(5)]
    df = table_of(spark, given)
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    check(rows, dict(enumerate(given)), 2)


def test_huge_entries_keep_exact_deviations_or_none(spark):
    given = [[1e12, 1e11], [-3e12, 2e12], [5.0, 7e10]]
    df = table_of(spark, given)
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    check(rows, dict(enumerate(given)), 2)
    beyond = table_of(spark, [[3e38, 1.0], [-3e38, 2.0], [1.0, 3.0]])
    rows = whitening.whiten(beyond, whitening.fit(beyond)).collect()
    assert all(np.isfinite(r.whitened) and (r.deviation is None) == (r.vec_id < 2) for r in rows)


@pytest.mark.parametrize("rank", [1, 3, 8])
def test_factor_and_rotation_of_matrices(rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(8, rank)) * 10.0 ** -np.arange(rank)
    a = b @ b.T
    l, order = whitening.pivoted_cholesky(a)
    assert l.shape[1] == rank and np.allclose(l @ l.T, a[order][:, order], atol=1e-13) and np.allclose(np.triu(l, 1), 0)
    values, axes = whitening.eigen(a)
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and np.allclose(axes * values @ axes.T, a, atol=1e-13)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9)
