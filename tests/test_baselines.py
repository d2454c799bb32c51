import numpy as np
import pytest
from pyspark.sql import functions as F

from newtonmill.plans import baselines as B
from newtonmill.plans import solvers
from newtonmill.plans.problems import Logistic, Quadratic

LAM, D, CLIENTS, ROWS = 0.1, 4, 4, 30


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(CLIENTS, ROWS, D))
    return a * np.sign(a @ rng.normal(size=D) + rng.normal(size=(CLIENTS, ROWS)))[..., None]


@pytest.fixture(scope="module")
def problem(spark, rows):
    data = [(c, r.tolist()) for c in range(CLIENTS) for r in rows[c]]
    return Logistic(spark.createDataFrame(data, "client_id int, features array<double>").coalesce(1).cache(), LAM, D)


@pytest.fixture(scope="module")
def best(problem):
    return B.newton(problem, 8).x


def test_oracles(problem, best):
    x = np.array([0.3, -0.1, 0.2, 0.5])
    assert np.allclose(problem.gradient(x), solvers.numeric_gradient(problem.value, x), atol=1e-6)
    assert np.linalg.norm(problem.gradient(best)) < 1e-9
    q = Quadratic(np.array([[3.0, 1], [0, 2]]), np.array([1.0, -1]), 4)
    z = np.array([0.5, 2.0])
    assert np.allclose(q.gradient(z), solvers.numeric_gradient(q.value, z), atol=1e-6)
    assert np.allclose(q.hessian(z), solvers.numeric_hessian(q.value, z), atol=1e-4)


def test_second_order_methods_reach_the_optimum(problem, best, rows):
    top = B.matrix_compressor("topk", D, 4)
    runs = {
        "star": B.newton_star(problem, best, 6),
        "zero": B.newton_zero(problem, 12),
        "learned": B.learned_newton(problem, 10, top),
        "rank": B.learned_newton(problem, 10, B.matrix_compressor("rank", D, 1)),
        "cubic": B.learned_newton(problem, 12, top, cubic=1.0),
        "both ways": B.learned_newton(problem, 25, top, down=B.Vectors("topk", D, 2), chance=0.8),
        "nl1": B.nl1(problem, 10, 10, np.full((CLIENTS, ROWS), 0.25), rows),
        "dingo": B.dingo(problem, 8),
    }
    for name, run in runs.items():
        assert np.linalg.norm(run.x - best) < 2e-2, name


def test_first_order_methods_go_down(problem, best):
    start = np.linalg.norm(best)
    rand, nat = B.Vectors("randk", D, 2), B.Vectors("natural", D)
    for run in (B.gradient_descent(problem, 15), B.gradient_descent(problem, 6, line_search=True), B.diana(problem, 25, rand), B.dore(problem, 25, rand, nat), B.artemis(problem, 40, nat, nat, part=0.8), B.adiana(problem, 20, nat)):
        assert np.linalg.norm(run.x - best) < 0.6 * start


@pytest.mark.parametrize("name", ["none", "randk", "bernoulli", "natural", "dithering"])
def test_vector_compressors_are_unbiased(name):
    rng, v = np.random.default_rng(1), np.random.default_rng(2).normal(size=12)
    c = B.Vectors(name, 12, 3)
    draws = np.array([c(v, rng) for _ in range(20_000)])
    assert np.allclose(draws.mean(axis=0), v, atol=0.08)
    assert np.mean(np.sum((draws - v) ** 2, axis=1)) <= (c.omega * 1.05 + 1e-12) * (v @ v)
    assert c.bits() > 0


def test_biased_rounding_contracts():
    v = np.random.default_rng(3).normal(size=500)
    out, delta = B.biased_rounding(v)
    assert np.all(np.isin(np.abs(out), 2.0 ** np.arange(-40, 5))) and np.sum((out - v) ** 2) <= (1 - delta + 0.05) * (v @ v)
    assert B.biased_rounding(np.zeros(2))[0].tolist() == [0, 0]


def test_stream_replay_counts_once(spark, tmp_path, rows):
    from newtonmill.streaming.warm_start import WarmStart, windowed_loss

    t = spark.createDataFrame([(r.tolist(),) for r in rows.reshape(-1, D)], "features array<double>").withColumn("ts", F.lit("2024-01-01 00:03:00").cast("timestamp"))
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    warm = WarmStart(D, LAM, str(tmp_path / "history"))
    warm.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert len(warm.steps) == 3 and max(s["n"] for s in warm.steps.values()) == CLIENTS * ROWS
    again = WarmStart(D, LAM, str(tmp_path / "history"))
    last = max(again.steps)
    x = again.steps[last]["x"]
    again.take(t.limit(0), last + 1)
    assert again.steps[last + 1]["x"] == x
    q = windowed_loss(stream, [0.0] * D).writeStream.format("memory").queryName("losses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("losses").first()
    assert r.n == CLIENTS * ROWS and r.loss == pytest.approx(np.log(2))
