"""Estimators on few columns: calibrators, rule-change hazard, incidence, and county rates pooled without covariates.

What is fitted is small: aggregates, or one row for each cell. Each query
returns rows the tests check against closed forms or known truth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.evaluation import hazard_panel as panel_sql
from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import frame, query, statement

LEAST_PLATT, LEAST_ISOTONIC = 20, 100
APPROVALS = ("approved", "approved_with_conditions")


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def platt(scored: DataFrame, p: str = "p", y: str = "y") -> tuple[float, float]:
    """Slope and offset on the logit; (1, 0), which changes nothing, on few rows or one class."""
    n, classes = scored.agg(F.count(F.lit(1)), F.count_distinct(y)).first()
    if n < LEAST_PLATT or classes < 2:
        return 1.0, 0.0
    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(scored.select(_logit(F.col(p).cast("double")).alias("x"), F.col(y).cast("double").alias("label")))
    m = LogisticRegression(featuresCol="v", regParam=0.0, standardization=False, maxIter=100).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic from a hundred rows on, else Platt; fitted on the first three quarters, applied to the rest."""
    rows = frame(spark, sf_dir, "scored").select("doc_id", F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("label"))
    cut = rows.agg(F.percentile("doc_id", F.lit(0.75))).first()[0]
    fit, rest = rows.where(F.col("doc_id") <= cut), rows.where(F.col("doc_id") > cut)
    n, classes = fit.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n >= LEAST_ISOTONIC and classes > 1:
        return IsotonicRegression(featuresCol="p", labelCol="label").fit(fit).transform(rest).select("doc_id", "p", F.round("prediction", 6).alias("calibrated"), F.lit("isotonic").alias("method"))
    slope, offset = platt(fit, y="label")
    return rest.select("doc_id", "p", F.round(1 / (1 + F.exp(-(slope * _logit(F.col("p")) + offset))), 6).alias("calibrated"), F.lit("platt").alias("method"))


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly hazard of a first restriction by ridge logistic regression, and the chance within a year."""
    names = ["neighbours_restricted", "objection_pressure", "election_within_12m"]
    rows = query(panel_sql)[0](spark, sf_dir).select("county_id", "month", F.col("event").cast("double").alias("label"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]).cache()
    n, events = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if events < 4:
        return rows.select("county_id", "month", F.lit(float(events / max(n, 1))).alias("hazard"), (1 - F.pow(F.lit(1 - events / max(n, 1)), 12)).alias("within_a_year"))
    v = VectorAssembler(inputCols=names, outputCol="v").transform(rows)
    m = LogisticRegression(featuresCol="v", regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(v)
    h = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), vector_to_array("probability")[1]))
    return m.transform(v).select("county_id", "month", F.round(h, 6).alias("hazard"), F.round(1 - F.pow(1 - h, 12), 6).alias("within_a_year"))


def incidence(d):
    """Cumulative incidence of the competing outcomes on a grid of months (Aalen-Johansen), monotone and summing to at most one."""
    months = f"CAST(floor({d.days('coalesce(decided_on, DATE ' + chr(39) + '2001-08-01' + chr(39) + ')', 'filed_on')} / 30.44) AS INT)"
    return f"""
    WITH timed AS (SELECT {months} AS m, CASE WHEN decided_on IS NULL THEN 'censored' WHEN outcome IN ('approved', 'approved_with_conditions') THEN 'approval' WHEN outcome = 'denied' THEN 'denial' ELSE 'withdrawal' END AS risk FROM application),
    grid AS (SELECT m, count(*) AS n, count(*) FILTER (WHERE risk = 'approval') AS a, count(*) FILTER (WHERE risk = 'denial') AS b, count(*) FILTER (WHERE risk = 'withdrawal') AS c FROM timed GROUP BY m),
    risk AS (SELECT *, CAST(sum(n) OVER (ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS at_risk FROM grid),
    stay AS (SELECT *, CASE WHEN a + b + c >= at_risk THEN NULL ELSE ln(1 - (a + b + c) / at_risk) END AS l FROM risk),
    kept AS (SELECT *, exp(coalesce(sum(l) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS s FROM stay)
    SELECT m, round(sum(s * a / at_risk) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS approval, round(sum(s * b / at_risk) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS denial,
           round(sum(s * c / at_risk) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS withdrawal, CAST(at_risk AS BIGINT) AS at_risk FROM kept"""


CALIBRATED_SQL = statement("""
    WITH r AS (SELECT doc_id, CAST(p AS DOUBLE) AS p, CAST(y AS DOUBLE) AS y FROM scored), cut AS (SELECT quantile_cont(doc_id, 0.75) AS c FROM r), fit AS (SELECT r.* FROM r, cut WHERE doc_id <= c),
    v AS (SELECT p, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM fit GROUP BY p),
    u AS (SELECT i, p, sum(s) OVER (ORDER BY i) AS s, sum(n) OVER (ORDER BY i) AS n, s AS s0, n AS n0 FROM v),
    m AS (SELECT a.i AS a, b.i AS b, (b.s - a.s + a.s0) / (b.n - a.n + a.n0) AS mean FROM u a JOIN u b ON b.i >= a.i),
    low AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least_mean FROM m),
    g AS (SELECT i, max(least_mean) AS y FROM low GROUP BY i), knot AS (SELECT u.p, g.y, lead(u.p) OVER (ORDER BY u.p) AS p2, lead(g.y) OVER (ORDER BY u.p) AS y2 FROM g JOIN u ON u.i = g.i),
    rest AS (SELECT r.doc_id, r.p FROM r, cut WHERE r.doc_id > c)
    SELECT t.doc_id, t.p, round(coalesce(CASE WHEN k.p2 IS NULL OR t.p = k.p THEN k.y ELSE k.y + (k.y2 - k.y) * (t.p - k.p) / (k.p2 - k.p) END, (SELECT min(y) FROM knot)), 6) AS calibrated, 'isotonic' AS method
    FROM rest t ASOF LEFT JOIN knot k ON t.p >= k.p""", Oracle)

DRAWS, WARMUP, CHAINS = 600, 600, 2


def _chain(n: np.ndarray, s: np.ndarray, cluster: np.ndarray, seed: int) -> np.ndarray:
    """Hamiltonian Monte Carlo over (mean, log scales, non-centred cluster and county effects); counts are sufficient."""
    rng = np.random.default_rng(seed)
    k, c = len(n), int(cluster.max()) + 1
    size = 3 + c + k

    def up(q):
        mu, tau, sigma = q[0], np.exp(q[1]), np.exp(q[2])
        z, e = q[3 : 3 + c], q[3 + c :]
        eta = mu + tau * z[cluster] + sigma * e
        p = 1 / (1 + np.exp(-eta))
        logp = (s * eta - n * np.logaddexp(0, eta)).sum() - mu * mu / 4.5 - (tau**2 + sigma**2) / (2 * 0.75**2) + q[1] + q[2] - (z @ z + e @ e) / 2
        r = s - n * p
        by = np.bincount(cluster, r, c)
        g = np.empty(size)
        g[0] = r.sum() - mu / 2.25
        g[1] = tau * (by @ z) - tau**2 / 0.75**2 + 1
        g[2] = sigma * (r @ e) - sigma**2 / 0.75**2 + 1
        g[3 : 3 + c], g[3 + c :] = tau * by - z, sigma * r - e
        return logp, g

    q = np.concatenate([[0.0, -1.0, -1.0], rng.normal(size=c + k) * 0.1])
    logp, grad = up(q)
    step, out = 0.05, []
    for i in range(WARMUP + DRAWS):
        p = rng.normal(size=size)
        start = logp - p @ p / 2
        q1, p1, l1, g1 = q.copy(), p.copy(), logp, grad
        for _ in range(int(rng.integers(8, 25))):
            p1 = p1 + step / 2 * g1
            q1 = q1 + step * p1
            l1, g1 = up(q1)
            p1 = p1 + step / 2 * g1
        accept = np.exp(min(0.0, l1 - p1 @ p1 / 2 - start)) if np.isfinite(l1) else 0.0
        if rng.random() < accept:
            q, logp, grad = q1, l1, g1
        if i < WARMUP:
            step *= np.exp(0.05 * (accept - 0.8))
        else:
            tau, sigma = np.exp(q[1]), np.exp(q[2])
            out.append(np.concatenate([[q[0], tau, sigma], q[0] + tau * q[3 : 3 + c][cluster] + sigma * q[3 + c :]]))
    return np.array(out)


def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partially pooled approval rates: county within structural cluster, posterior mean, 80 % interval, share borrowed, R-hat and whether the chains agree.

    A county without a settled decision has what its cluster tells, with the spread of counties around
    it. Decisions are reduced to one row for each county (a sufficient statistic); chains run in parallel tasks.
    """
    county = frame(spark, sf_dir, "county").select("county_id", F.coalesce("framework", F.lit("unknown")).alias("framework"))
    cells = frame(spark, sf_dir, "application").where(~F.col("outcome").isin("pending", "withdrawn")).groupBy("county_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome").isin(*APPROVALS)).alias("s"))
    rows = county.join(cells, "county_id", "left").fillna(0, ["n", "s"]).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("county_id")
        cluster = pd.factorize(pdf.framework, sort=True)[0]
        every = _chain(pdf.n.to_numpy(float), pdf.s.to_numpy(float), cluster, int(pdf.chain.iloc[0]) + 11)
        draws, sigma = every[:, 3:], float(every[:, 2].mean())
        half = np.split(draws, 2)
        return pd.DataFrame({"county_id": np.repeat(pdf.county_id.to_numpy(), 2), "part": np.tile([0, 1], len(pdf)), "chain": pdf.chain.iloc[0], "n": np.repeat(pdf.n.to_numpy(), 2), "sigma": sigma, "draws": [h[:, j].tolist() for j in range(draws.shape[1]) for h in half]})

    drawn = rows.groupBy("chain").applyInPandas(run, "county_id bigint, part int, chain bigint, n bigint, sigma double, draws array<double>")
    m = DRAWS // 2
    stats = drawn.withColumn("mean", F.aggregate("draws", F.lit(0.0), lambda a, x: a + x) / m)
    stats = stats.withColumn("var", F.aggregate("draws", F.lit(0.0), lambda a, x: a + x * x) / m - F.col("mean") * F.col("mean"))
    p = F.transform(F.flatten(F.collect_list("draws")), lambda x: 1 / (1 + F.exp(-x)))
    got = stats.groupBy("county_id").agg(F.array_sort(p).alias("p"), F.avg("var").alias("within"), F.var_pop("mean").alias("between"), (1 / (0.25 * F.pow(F.avg("sigma"), 2))).alias("k"), F.max("n").alias("n"))
    at = lambda q: F.col("p")[int(q * CHAINS * DRAWS)]
    r_hat = F.round(F.sqrt(1 + F.col("between") / F.col("within")), 3)
    return got.select("county_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / (CHAINS * DRAWS), 3).alias("probability"), F.round(at(0.1), 3).alias("p10"), F.round(at(0.9), 3).alias("p90"), F.round(F.col("k") / (F.col("k") + F.col("n")), 3).alias("pooling_weight"), r_hat.alias("r_hat"), (r_hat <= 1.01).alias("converged"))


QUERIES = {f"model_{f.__name__}": (f, None) for f in (hazard, hierarchical)} | {"model_incidence": query(incidence), "model_calibrated": (calibrated, CALIBRATED_SQL)}
