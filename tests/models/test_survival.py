"""Survival models against plain fits, closed forms, known truth and all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from permrisk.models import survival


def draw(n, seed, shape=1.6, ties=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.gamma(2.0, size=n)])
    scale = np.exp(2.3 - 0.5 * x[:, 0] + 0.8 * x[:, 1])
    t, c = scale * rng.weibull(shape, n), rng.uniform(2, 40, n)
    months = np.minimum(t, c)
    if ties:
        months = np.maximum(np.round(months), 1.0)
    return x, months, (t <= c).astype(float)


def frame(spark, x, months, event, parts=4):
    rows = [(float(m), float(e), *map(float, r)) for r, m, e in zip(x, months, event, strict=True)]
    return spark.createDataFrame(rows, "months double, event double, u double, v double, w double").repartition(parts)


def plain_cox(x, t, d, penalty):
    """Efron's likelihood, one event at a time."""
    n, p = x.shape
    beta = np.zeros(p)
    for _ in range(40):
        theta = np.exp(x @ beta)
        gradient, hessian = -n * penalty * beta, -n * penalty * np.eye(p)
        for time in np.unique(t[d == 1]):
            risk, dead = t >= time, (t == time) & (d == 1)
            for k in range(dead.sum()):
                w = theta * (risk - k / dead.sum() * dead)
                mean = w @ x / w.sum()
                gradient -= mean
                hessian -= (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
            gradient += x[dead].sum(axis=0)
        step = np.linalg.solve(-hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return beta
    raise AssertionError


def plain_concordance(t, d, risk):
    won = every = 0.0
    for i, j in itertools.permutations(range(len(t)), 2):
        if d[i] and (t[i] < t[j] or t[i] == t[j] and not d[j]):
            every += 1
            won += (risk[i] > risk[j]) + 0.5 * (risk[i] == risk[j])
    return won / every


@pytest.mark.parametrize(("ties", "ranges"), [(True, 8), (False, 64)])
def test_cox_is_the_plain_cox(spark, ties, ranges):
    x, months, event = draw(500, 1, ties=ties)
    model = survival.cox(frame(spark, x, months, event), ["u", "v", "w"], ranges=ranges)
    order = [["u", "v", "w"].index(n) for n in model.covariates.names]
    scaled = x[:, order] / np.array(model.covariates.scale)
    assert np.allclose(model.coefficients, plain_cox(scaled, months, event, 0.1), atol=1e-6)
    assert model.effects["u"] > 0 > model.effects["v"]


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_concordance_is_the_count_of_pairs(spark, ranges):
    rng = np.random.default_rng(7)
    for levels, n in ((4, 300), (1000, 200)):
        x, months, event = draw(n, 3 + levels)
        risk = np.round(rng.normal(size=n) * levels) / levels - 0.05 * np.round(months)
        months[: n // 3], event[: n // 3] = 5.0, rng.integers(0, 2, n // 3)  # one time holds a third
        risk[n // 2 :: 3] = 0.25
        df = spark.createDataFrame([tuple(map(float, r)) for r in zip(months, event, risk, strict=True)], "months double, event double, risk double")
        assert survival.concordance(df, ranges) == pytest.approx(plain_concordance(months, event, risk), abs=1e-12)


def test_concordance_without_pairs(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (2.0, 0.0, 2.0)], "months double, event double, risk double")
    assert survival.concordance(df) == 0.5 == survival.concordance(df.limit(0))


def test_weibull_closed_form_without_covariates(spark):
    x, months, event = draw(400, 5)
    m = survival.weibull(frame(spark, x, months, event))
    k, scale = m.shape, np.exp(m.intercept)
    # at the maximum: scale^k = sum t^k / events, and the equation of the shape
    assert scale**k == pytest.approx((months**k).sum() / event.sum(), rel=1e-6)
    assert 1 / k == pytest.approx((months**k @ np.log(months)) / (months**k).sum() - (event @ np.log(months)) / event.sum(), rel=1e-6)
    q = m.quantiles(np.zeros((1, 0)))[0]
    assert np.allclose(1 - np.exp(-((q / scale) ** k)), [0.1, 0.5, 0.9])


def test_weibull_recovers_two_covariates_and_shrinks(spark):
    x, months, event = draw(6000, 6, ties=False)
    df = frame(spark, x, months, event)
    free, held = survival.weibull(df, ["u", "v"], penalty=0.0), survival.weibull(df, ["u", "v"])
    effect = {n: b / s for n, b, s in zip(free.covariates.names, free.coefficients, free.covariates.scale, strict=True)}
    assert effect["u"] == pytest.approx(-0.5, abs=0.05) and effect["v"] == pytest.approx(0.8, abs=0.06) and free.shape == pytest.approx(1.6, abs=0.06)
    assert all(abs(a) < abs(b) for a, b in zip(held.coefficients, free.coefficients, strict=True))


def test_censoring_is_not_optimistic(spark):
    x, months, event = draw(1500, 8, ties=False)
    m = survival.weibull(frame(spark, x, months, event))
    at, stay, km = np.argsort(months), 1.0, None
    for rank, i in enumerate(at):
        stay *= 1 - event[i] / (len(at) - rank)
        if stay <= 0.5:
            km = months[i]
            break
    fitted = m.quantiles(np.zeros((1, 0)))[0][1]
    assert np.median(months[event == 1]) < fitted and abs(fitted - km) / km < 0.3


def test_few_events_and_missing_covariates(spark):
    few = frame(spark, *draw(7, 9))
    m = survival.weibull(few, ["u"])
    assert not m.fitted and np.allclose(m.quantiles(np.zeros((2, 1))), m.median * np.array([[0.42, 1.0, 2.35]] * 2))
    assert survival.weibull(few.limit(0)).median == 12.0
    x, months, event = draw(300, 10)
    df = frame(spark, x, months, event).withColumn("gone", F.lit(None).cast("double")).withColumn("flat", F.lit(3.0)).withColumn("u", F.when(F.col("w") > 1, F.col("u")))
    m = survival.weibull(df, ["u", "gone", "flat", "v"])
    assert set(m.covariates.names) <= {"u", "v"} and "v" in m.covariates.names
    rows = survival.quantiles(df.withColumn("k", F.monotonically_increasing_id()), m, ["k"]).collect()
    assert len(rows) == 300 and all(0.1 <= r.p10 <= r.p50 <= r.p90 <= 240 for r in rows)
    assert survival.cox(few, ["u"]).effects == {}


def test_incidence_is_monotone_and_adds_up(spark):
    rng = np.random.default_rng(11)
    a, b = 10 * rng.weibull(1.5, 900), 18 * rng.weibull(1.2, 900)
    months = np.minimum(np.minimum(a, b), 30)
    arms = {name: survival.weibull(frame(spark, np.zeros((900, 3)), months, own.astype(float))) for name, own in (("approval", (a < b) & (a < 30)), ("denial", (b <= a) & (b < 30)))}
    last = None
    for t in (6, 12, 24, 36, 60):
        now = survival.cumulative_incidence(arms, t)
        assert sum(now.values()) == pytest.approx(1.0, abs=0.06)
        assert last is None or now["approval"] >= last["approval"] and now["denial"] >= last["denial"] and now["pending"] <= last["pending"]
        last = now
    assert last["approval"] == pytest.approx((a < b).mean(), abs=0.05) and survival.cumulative_incidence({}, 6) == {}


def test_prepared(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2020-01-01', DATE '2020-06-01', 'approval'), (2, DATE '2020-01-01', NULL, NULL), (3, DATE '2020-01-01', DATE '2022-01-01', 'approval'), (4, DATE '2020-01-01', DATE '2020-03-01', 'denial'), (5, DATE '2022-01-01', NULL, NULL) AS t(id, filed, gone, risk)")
    rows = {r.id: (round(r.months * 30.44), r.event) for r in survival.prepared(df, F.col("risk") == "approval", "filed", "gone", "2021-01-01").collect()}
    assert rows == {1: (152, 1.0), 2: (366, 0.0), 3: (366, 0.0), 4: (60, 0.0)}
