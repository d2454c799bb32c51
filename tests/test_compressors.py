import numpy as np
import pytest

from newtonmill.plans import compressors as C


def triangle(d=20, seed=123):
    rng = np.random.default_rng(seed)
    r = rng.uniform(-1, 1, (d, d))
    return C.packed((r + r.T) / 2)


def test_packing_round_trip():
    v = triangle(7)
    assert np.array_equal(C.packed(C.unpacked(v, 7)), v)
    assert np.isclose(C.frobenius(v, 7), np.linalg.norm(C.unpacked(v, 7)))
    m = np.arange(9).reshape(3, 3)
    assert C.packed(m).tolist() == [0, 1, 4, 2, 5, 8]


def test_generator_golden():
    rng = C.Lcg(123)
    assert [rng.integer() for _ in range(3)] == [28854610, 3396176589, 1512272476]


@pytest.mark.parametrize("name", ["randk", "seqk"])
def test_random_compressors_are_unbiased_with_their_variance(name):
    v, d, trials = triangle(), 20, 4000
    comp, rng = C.compressor(name, d, 1.5), C.Lcg(456)
    assert comp.k == 30 and comp.n == 210
    mean, error = np.zeros(comp.n), 0.0
    for _ in range(trials):
        out = np.zeros(comp.n)
        at, value = comp.apply(v, rng)
        assert len(set(at.tolist())) == 30
        out[at] = value
        mean, error = mean + out / trials, error + np.sum((out - v) ** 2) / trials
    omega = comp.n / comp.k - 1
    assert abs(error / np.sum(v * v) / omega - 1) < 0.05
    assert np.linalg.norm(mean - v) < 0.1 * np.linalg.norm(v)
    assert np.isclose(comp.alpha, 1 / (omega + 1))


def test_top_k_contracts_and_breaks_ties_by_position():
    for seed in range(200):
        v = triangle(seed=seed)
        at = C.top_k(v, 30)
        out = v.copy()
        out[at] = 0
        assert np.sum(out * out) <= (1 - 30 / 210) * np.sum(v * v) + 1e-12
        assert np.all(np.diff(at) > 0)
    assert C.top_k(np.array([1.0, -1, 1, 0]), 2).tolist() == [0, 1]
    assert C.top_k(np.arange(3.0), 9).tolist() == [0, 1, 2]


def test_top_lek_meets_its_residual_on_average():
    d, k = 20, 30
    n, ratios = 210, []
    for seed in range(100):
        v = triangle(seed=seed)
        rng = np.random.default_rng(seed)
        whole, rest = C.frobenius(v, d) ** 2, []
        for _ in range(100):
            at = C.top_lek(v, d, k, k / n, rng.random(), slack=0.0)
            assert len(at) <= k
            out = v.copy()
            out[at] = 0
            rest.append(C.frobenius(out, d) ** 2 / whole)
        ratios.append(np.mean(rest))
    assert abs(np.mean(ratios) / (1 - k / n) - 1) < 0.1


def test_natural_and_pair_packing():
    v = np.array([0.0, 1, -1, 1.5, -3.99, 2.0**-1030, 1e300, -1e-300])
    cut = C.power_of_two(v)
    assert cut.tolist()[:6] == [0, 1, -1, 1, -2, 0]
    for n in (7, 8):
        assert np.array_equal(C.unpack_pairs(C.pack_pairs(cut[:n]), n), cut[:n])
    assert len(C.pack_pairs(cut)) == 12
    u = np.random.default_rng(1).random((20_000, 1))
    assert abs(np.mean([C.power_of_two_randomly(np.array([1.5]), x)[0] for x in u]) - 1.5) < 0.02


def test_rules_and_bounds():
    assert C.compressor("identical", 10).k == 55 and C.compressor("identical", 10).alpha == 1
    assert C.compressor("natural", 10).alpha == 8 / 9
    assert np.isclose(C.compressor("topk", 10, 2.0, option=1).alpha, 1 - np.sqrt(1 - 20 / 100))
    assert C.compressor("topk", 10, 2.0).alpha == 1
    with pytest.raises(ValueError):
        C.compressor("topk", 10, 6.0)
    assert C.compressor("topk", 10, 2.0).message_bytes(20) == (160, 80)
    assert C.compressor("randk", 10, 2.0).message_bytes(20) == (160, 0)
    assert C.compressor("natural", 10).message_bytes(55) == (84, 0)


def test_low_rank_dithering_and_power_step():
    m = C.unpacked(triangle(8), 8)
    assert np.allclose(C.low_rank(m, 8), m)
    q = np.random.default_rng(0).normal(size=(8, 8))
    assert np.allclose(C.power_sgd(m, q), m)
    v, rng = m[0], np.random.default_rng(3)
    mean = np.mean([C.dithering(v, 4, rng.random(8)) for _ in range(20_000)], axis=0)
    assert np.allclose(mean, v, atol=0.02)


def test_matrix_compressors_keep_the_mean_or_contract():
    from newtonmill.plans.baselines import contraction, matrix_compressor

    rng = np.random.default_rng(3)
    m = rng.normal(size=(8, 8))
    m = m + m.T
    drawn = [matrix_compressor("randk", 8, 9)(m, rng) for _ in range(4000)]
    assert np.abs(np.mean(drawn, axis=0) - m).max() < 0.6 and all(np.array_equal(x, x.T) for x in drawn[:5])
    whole = np.sum(m * m)
    for name, k in (("topk", 9), ("rank", 3)):
        left = np.sum((matrix_compressor(name, 8, k)(m, rng) - m) ** 2)
        assert left <= (1 - contraction(name, m, k)) * whole * (1 + 1e-9)
    assert np.mean([np.sum((matrix_compressor("powersgd", 8, 3)(m, rng) - m) ** 2) for _ in range(50)]) <= (1 - contraction("powersgd", m, 3)) * whole
    assert contraction("randk", m, 9) == 3
    with pytest.raises(ValueError):
        matrix_compressor("none", 8, 1)
