import numpy as np
import pytest

from shelfcast.operators import stats
from shelfcast.plans.catalogue import QUERIES

from helpers import daily


def closed_form(y, period):
    n, half = len(y), period // 2
    weights = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, weights, "valid")
    raw = np.array([np.nanmean((y - trend)[i::period]) for i in range(period)])
    seasonal = np.resize(raw - raw.mean(), n)
    return trend, seasonal, y - trend - seasonal


@pytest.mark.parametrize("period", [12, 7])
def test_decomposition(spark, period):
    y = np.random.default_rng(2).uniform(10, 100, 47) + 30 * np.sin(np.arange(47) * 2 * np.pi / period)
    got = stats.decompose(daily(spark, y), period=period).orderBy("Date").toPandas()
    for name, expected in zip(["Trend", "Seasonal", "Residual"], closed_form(y, period)):
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), expected, rtol=1e-9, atol=1e-9)


def test_decomposition_per_key(spark):
    a = daily(spark, range(24), key="a")
    b = daily(spark, [v % 12 for v in range(36)], key="b")
    got = stats.decompose(a.unionByName(b), ["Region"]).toPandas()
    assert got[got.Region == "a"].Seasonal.abs().max() < 1e-9
    assert got[got.Region == "b"].Residual.abs().max() < 1e-9


def test_decomposition_needs_two_periods(spark):
    with pytest.raises(Exception, match="needs 24 rows"):
        stats.decompose(daily(spark, range(23))).collect()


def adf_by_normal_equations(y, lags):
    """The t-value of the level from the textbook formula."""
    dy = np.diff(y)
    rows, target = [], []
    for t in range(lags, len(dy)):
        rows.append([1.0, y[t], *[dy[t - k] for k in range(1, lags + 1)]])
        target.append(dy[t])
    x, z = np.array(rows), np.array(target)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ z
    e = z - x @ beta
    return beta[1] / np.sqrt(e @ e / (len(z) - x.shape[1]) * inverse[1, 1])


def lags_by_criterion(y):
    n = len(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dy = np.diff(y)
    criteria = []
    for lags in range(most + 1):
        x = np.array([[1.0, y[t], *[dy[t - k] for k in range(1, lags + 1)]] for t in range(most, len(dy))])
        z = dy[most:]
        e = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        criteria.append((len(z) * np.log(e @ e / len(z)) + 2 * (lags + 2), lags))
    return min(criteria)[1]


def test_adf_against_the_textbook(spark):
    """Series of several lengths and levels in one job; each has its own number of lags."""
    series = {}
    for seed, (n, level) in enumerate([(150, 1000), (80, 4e7), (24, 0), (61, -5), (400, 10)]):
        rng = np.random.default_rng(seed)
        series[f"s{seed}"] = level + (np.cumsum(rng.normal(size=n)) + 3 * rng.normal(size=n)) * max(level / 1000, 1)
    frame = None
    for name, y in series.items():
        one = daily(spark, y, key=name)
        frame = one if frame is None else frame.unionByName(one)
    got = {r["Region"]: r for r in stats.adf_test(frame, ["Region"]).collect()}
    for name, y in series.items():
        r = got[name]
        assert r["Lags"] == lags_by_criterion(y - y.mean())
        assert r["Observations"] == len(y) - 1 - r["Lags"]
        assert r["Statistic"] == pytest.approx(adf_by_normal_equations(y - y.mean(), r["Lags"]), rel=1e-6)
        assert r["P_Value"] == pytest.approx(stats.adf_p_value(r["Statistic"]))
        assert r["Critical_5"] == pytest.approx(stats.adf_critical(r["Observations"])["Critical_5"])
        assert r["Stationary"] == (r["P_Value"] < 0.05)


def test_adf_sends_no_series_to_python(spark):
    plan = stats.adf_test(daily(spark, np.random.default_rng(1).normal(size=60), key="a"), ["Region"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and "ArrowEvalPython" in text


def test_adf_of_no_series_and_of_a_flat_one(spark):
    assert stats.adf_test(daily(spark, [])).count() == 0
    flat = stats.adf_test(daily(spark, [5.0] * 30)).collect()
    assert len(flat) == 1 and flat[0]["Statistic"] is None


def test_adf_tables():
    assert stats.adf_p_value(-3.43) == pytest.approx(0.01, abs=5e-4)
    assert stats.adf_p_value(-2.86) == pytest.approx(0.05, abs=1e-3)
    assert stats.adf_p_value(-2.57) == pytest.approx(0.10, abs=1e-3)
    assert stats.adf_p_value(-20) == 0.0 and stats.adf_p_value(3) == 1.0
    critical = stats.adf_critical(10**9)
    assert list(critical.values()) == pytest.approx([-3.43035, -2.86154, -2.56677])


def test_adf_per_key(spark):
    rng = np.random.default_rng(9)
    frame = daily(spark, rng.normal(size=200), key="noise").unionByName(
        daily(spark, np.cumsum(1 + rng.normal(size=200)), key="walk")
    ).unionByName(daily(spark, [5.0] * 40, key="flat")).unionByName(daily(spark, [1.0, 2.0], key="short"))
    got = {r["Region"]: r for r in stats.adf_test(frame, ["Region"]).collect()}
    assert got["noise"]["Stationary"] and not got["walk"]["Stationary"]
    assert got["flat"]["Statistic"] is None and got["short"]["Stationary"] is None
    alone = stats.adf_test(daily(spark, rng.normal(size=100))).collect()
    assert len(alone) == 1 and alone[0]["P_Value"] < 0.05


def test_adf_reads_its_series_once(spark, root):
    """What is left to run reads the written series, not the lines."""
    plan = QUERIES["adf_test_by_region"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
