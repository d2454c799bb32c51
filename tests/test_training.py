import numpy as np
import pytest
from pyspark.sql import functions as F

from newtonmill.plans import solvers
from newtonmill.plans.compressors import packed, unpacked
from newtonmill.plans.training import TrainConfig, client_sums, mean_losses, smoothness, train

LAM, D, CLIENTS, ROWS = 1e-2, 6, 5, 40


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    a = rng.normal(size=(CLIENTS, ROWS, D))
    y = np.sign(a @ rng.normal(size=D) + rng.normal(size=(CLIENTS, ROWS)))
    return a * y[..., None]


@pytest.fixture(scope="module")
def samples(spark, data):
    rows = [(c, row.tolist()) for c in range(CLIENTS) for row in data[c]]
    return spark.createDataFrame(rows, "client_id int, features array<double>").repartition(7).cache()


def value(data, x):
    m = data.reshape(-1, D) @ x
    return np.mean(np.logaddexp(0, -m)) + LAM / 2 * x @ x


def test_sums_equal_numeric_derivatives(samples, data):
    x = np.linspace(-0.5, 0.5, D)
    rows = client_sums(samples, x).collect()
    assert sorted(r.client_id for r in rows) == list(range(CLIENTS)) and all(r.n == ROWS for r in rows)
    grad = np.mean([np.frombuffer(r.g) / r.n for r in rows], axis=0) + LAM * x
    hess = unpacked(np.mean([np.frombuffer(r.h) / r.n for r in rows], axis=0), D) + LAM * np.eye(D)
    f = lambda z: value(data, z)
    assert np.allclose(grad, solvers.numeric_gradient(f, x), atol=1e-6)
    assert np.allclose(hess, solvers.numeric_hessian(f, x), atol=1e-4)
    assert np.allclose(mean_losses(samples, [x, 0 * x], LAM), [f(x), np.log(2)])


@pytest.fixture(scope="module")
def best(data):
    x = np.zeros(D)
    for _ in range(30):
        m = data.reshape(-1, D) @ x
        s = 1 / (1 + np.exp(-m))
        g = -((1 - s) @ data.reshape(-1, D)) / len(m) + LAM * x
        h = (data.reshape(-1, D) * (s * (1 - s))[:, None]).T @ data.reshape(-1, D) / len(m) + LAM * np.eye(D)
        x = x - np.linalg.solve(h, g)
    return x


@pytest.mark.parametrize(("compressor", "extra"), [("identical", {}), ("topk", {}), ("natural", {}), ("toplek", {"rounds": 24}), ("topk", {"option": "a", "line_search": True}), ("topk", {"option": "a", "project": True})])
def test_newton_reaches_the_optimum(samples, best, compressor, extra):
    r = train(samples, TrainConfig(**{"rounds": 14, "lam": LAM, "compressor": compressor, "k_mult": 2.0} | extra))
    assert r.clients == CLIENTS and r.d == D
    assert np.linalg.norm(r.x - best) < 2e-3, r.log
    assert r.log[0][2] == pytest.approx(np.log(2))


def test_full_random_compressors_equal_identical(samples):
    full = (D + 1) / 2
    runs = {name: train(samples, TrainConfig(rounds=3, lam=LAM, compressor=name, k_mult=full)) for name in ("identical", "randk", "seqk", "topk")}
    for name in ("randk", "seqk", "topk"):
        assert np.allclose(runs[name].x, runs["identical"].x, atol=1e-10)


def test_order_of_update_and_solve_matters(samples):
    runs = [train(samples, TrainConfig(rounds=4, lam=LAM, compressor="topk", k_mult=1.0, update_then_solve=u)) for u in (True, False)]
    assert not np.allclose(runs[0].x, runs[1].x)
    assert runs[0].log[1][1] == pytest.approx(runs[1].log[1][1])  # nothing is corrected in the first round


def test_partial_participation_converges(samples, best):
    r = train(samples, TrainConfig(rounds=25, lam=LAM, compressor="topk", k_mult=3.0, clients_per_round=3))
    assert np.linalg.norm(r.x - best) < 0.05 and r.log[-1][1] < r.log[0][1] / 5
    assert r.log[1][4] < 3 * (8 * 21 + 8 * (D + 2)) + 1


def test_gradient_descent_and_smoothness(samples, data):
    a = data.reshape(-1, D)
    assert smoothness(samples, LAM) == pytest.approx(np.linalg.eigvalsh(a.T @ a).max() / (4 * len(a)) + LAM, rel=1e-6)
    r = train(samples, TrainConfig(rounds=8, lam=LAM, algorithm="gd"))
    assert all(x[2] > y[2] for x, y in zip(r.log, r.log[1:]))


def test_logistic_regression_of_spark_agrees(spark, samples, best):
    from newtonmill.plans import comparators

    assert np.allclose(comparators.mllib(samples, LAM), best, atol=1e-4)
    assert np.allclose(comparators.newton(samples, LAM), best, atol=1e-8)


def test_unknown_names_are_refused():
    with pytest.raises(ValueError):
        TrainConfig(rounds=1, lam=1.0, compressor="none")


def test_packed_matches_positions():
    assert packed(np.array([[1, 2], [2, 3]])).tolist() == [1, 2, 3]
