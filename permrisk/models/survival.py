"""Time to a decision: penalised Weibull regression, proportional hazards, and concordance.

All are fitted by Newton's method on sums over the rows. The risk sets of the
partial likelihood are running totals in two steps: rows are added up by time,
ranges of times pass their totals to the driver, and each range goes on from
what the later ranges hold. Ties follow Efron. Concordance counts pairs by
ranges of time and of risk: pairs that differ in both ranges are products of
counts, the rest is counted within one range. No pair of rows is ever formed.

Durations are months, events 1 or 0. Rows without a positive duration are left
out; a covariate's missing values are its median, which is remembered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permrisk.models.levels import Levels, matrix
from permrisk.models.sums import newton, packed, summed, unpacked

# fixed values: the penalty, the least events of a fit, events for each covariate, and the spread around the median where nothing is fitted
PENALTY, LEAST_EVENTS, EVENTS_EACH, SPREAD = 0.1, 8, 10, (0.42, 1.0, 2.35)
LEAST_MONTHS, MOST_MONTHS = 0.1, 240.0
RANGES = 64
DAYS_A_MONTH = 30.44


def prepared(rows: DataFrame, event: Column, filed: str, left: str, as_of: str) -> DataFrame:
    """Rows with ``months`` and ``event``: those that have not left by ``as_of`` are censored then, those that left otherwise when they did."""
    until = F.when(F.col(left) <= F.to_date(F.lit(as_of)), F.col(left)).otherwise(F.to_date(F.lit(as_of)))
    months = F.datediff(until, F.col(filed)) / DAYS_A_MONTH
    happened = (event & (F.col(left) <= F.to_date(F.lit(as_of)))).cast("double")
    return rows.withColumn("months", months).withColumn("event", F.coalesce(happened, F.lit(0.0))).where("months > 0")


@dataclass(frozen=True)
class Covariates:
    """Covariates a fit admits, with medians for missing values and the deviations by which they are scaled."""

    names: tuple[str, ...]
    fill: tuple[float, ...]
    scale: tuple[float, ...]

    @classmethod
    def admit(cls, rows: DataFrame, names, budget: int) -> Covariates:
        """The most complete and most varied covariates, ``budget`` at most; none that half of the rows lack or that does not vary."""
        x = [F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in names]
        if not names or budget < 1:
            return cls((), (), ())
        got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("sd"), F.percentile_approx(c, 0.5, 100_000).alias("median")).alias(f"c{k}") for k, c in enumerate(x)]).first()
        ranked = sorted(((own.n / max(got.n, 1) * min(own.sd or 0.0, 1.0), name) for k, name in enumerate(names) if (own := got[f"c{k}"]).n >= 0.5 * got.n and (own.sd or 0.0) > 0), reverse=True)
        chosen = [name for _, name in ranked[:budget]]
        fill = [float(got[f"c{list(names).index(c)}"].median) for c in chosen]
        if not chosen:
            return cls((), (), ())
        sd = rows.agg(*[F.stddev_pop(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(f))).alias(f"s{k}") for k, (c, f) in enumerate(zip(chosen, fill, strict=True))]).first()
        kept = [(c, f, float(s)) for c, f, s in zip(chosen, fill, sd, strict=True) if s and s > 1e-8]
        return cls(*(tuple(v) for v in zip(*kept, strict=True))) if kept else cls((), (), ())

    def matrix(self, raw: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(raw), np.array(self.fill), raw) / np.array(self.scale) if self.names else raw[:, :0]


@dataclass(frozen=True)
class Weibull:
    """S(t) = exp(-(t / exp(intercept + x b))^shape), with x filled and scaled; without a fit the spread around a median."""

    covariates: Covariates
    intercept: float
    coefficients: tuple[float, ...]
    shape: float
    events: int
    median: float
    fitted: bool

    def scale(self, raw: np.ndarray) -> np.ndarray:
        return np.exp(self.intercept + self.covariates.matrix(raw) @ np.array(self.coefficients))

    def quantiles(self, raw: np.ndarray, levels=(0.1, 0.5, 0.9)) -> np.ndarray:
        if not self.fitted:
            return np.tile(self.median * np.array(SPREAD), (len(raw), 1))
        t = self.scale(raw)[:, None] * (-np.log1p(-np.array(levels)))[None, :] ** (1 / self.shape)
        return np.sort(np.clip(t, LEAST_MONTHS, MOST_MONTHS), axis=1)

    def hazard(self, months: np.ndarray) -> np.ndarray:
        """Cumulative hazard of a fit without covariates."""
        return (months / np.exp(self.intercept)) ** self.shape


def weibull(rows: DataFrame, covariates=(), penalty: float = PENALTY) -> Weibull:
    """Maximum of the mean log-likelihood less half the penalty times the squared coefficients of scaled covariates; one covariate for ten events."""
    n, events, logs = rows.agg(F.count(F.lit(1)), F.sum("event"), F.sum("months")).first()
    events = int(events or 0)
    median = rows.where("event = 1").agg(F.percentile_approx("months", 0.5, 100_000)).first()[0]
    median = 12.0 if median is None else float(median)
    if events < LEAST_EVENTS:
        return Weibull(Covariates((), (), ()), float(np.log(median)), (), 1.0, events, median, False)
    admitted = Covariates.admit(rows, covariates, events // EVENTS_EACH)
    p = len(admitted.names)

    def value(theta: np.ndarray):
        beta, log_shape = theta[:-1], theta[-1]
        shape = np.exp(log_shape)

        def of(m: np.ndarray) -> np.ndarray:
            t, d = np.log(m[:, 0]), m[:, 1]
            x = np.column_stack([np.ones(len(m)), admitted.matrix(m[:, 2:])])
            z = shape * (t - x @ beta)
            a = np.exp(np.minimum(z, 500.0))
            first, cross = -shape * (d - a), -shape * (d - a) + shape * a * z
            return np.concatenate([
                [(d * (log_shape - t + z) - a).sum()], first @ x, [(d * (1 + z) - a * z).sum()],
                (-(shape**2) * a) @ packed(x), cross @ x, [(d * z - a * z - a * z * z).sum()],
            ])

        k = p + 1
        v = summed(rows, ["months", "event", *admitted.names], of, 1 + k + 1 + k * (k + 1) // 2 + k + 1) / n
        hessian = np.zeros((k + 1, k + 1))
        hessian[:k, :k] = unpacked(v[k + 2 : k + 2 + k * (k + 1) // 2], k)
        hessian[:k, k] = hessian[k, :k] = v[-k - 1 : -1]
        hessian[k, k] = v[-1]
        ridge = np.zeros(k + 1)
        ridge[1:k] = penalty
        return v[0] - (ridge * theta**2).sum() / 2, v[1 : k + 2] - ridge * theta, hessian - np.diag(ridge)

    theta = newton(np.concatenate([[np.log(logs / events)], np.zeros(p + 1)]), value)
    return Weibull(admitted, float(theta[0]), tuple(theta[1:-1]), float(np.exp(theta[-1])), events, median, True)


def quantiles(rows: DataFrame, model: Weibull, keep: list[str]) -> DataFrame:
    """(keep, p10, p50, p90) in months."""
    shared, kept = rows.sparkSession.sparkContext.broadcast(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            raw = matrix(batch.columns[len(keep) :]) if shared.value.covariates.names else np.zeros((batch.num_rows, 0))
            q = shared.value.quantiles(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(q[:, k]) for k in range(3)]], names=[*keep, "p10", "p50", "p90"])

    return rows.select(*keep, *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(model.covariates.names)]).mapInArrow(run, f"{kept}, p10 double, p50 double, p90 double")


def cumulative_incidence(arms: dict[str, Weibull], months: float, steps: int = 96) -> dict[str, float]:
    """The chance that each exit has happened by then, from the hazards of all arms; with what is pending they add up to about one."""
    grid = np.linspace(0.0, max(float(months), 1.0), steps + 1)[1:]
    hazards = {name: arm.hazard(grid) for name, arm in arms.items() if arm.fitted}
    if not hazards:
        return {}
    staying = np.exp(-np.sum(list(hazards.values()), axis=0))
    before = np.concatenate([[1.0], staying[:-1]])
    return {name: float((np.diff(h, prepend=0.0) * before).sum()) for name, h in hazards.items()} | {"pending": float(staying[-1])}


@dataclass(frozen=True)
class Cox:
    """Log hazard ratios of scaled covariates; ``effects`` are those of the covariates as they are."""

    covariates: Covariates
    coefficients: tuple[float, ...]

    @property
    def effects(self) -> dict[str, float]:
        return {n: b / s for n, b, s in zip(self.covariates.names, self.coefficients, self.covariates.scale, strict=True)}


def _by_time(m: np.ndarray, covariates: Covariates, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times of a batch, ascending, and for each the sums over its rows and over its events."""
    t, d, x = m[:, 0], m[:, 1], covariates.matrix(m[:, 2:])
    theta = np.exp(np.clip(x @ beta, -500, 500))[:, None]
    every = np.column_stack([theta, theta * x, theta * packed(x)])
    rows = np.column_stack([every, every * d[:, None], d, d[:, None] * x])
    times, at = np.unique(t, return_inverse=True)
    out = np.zeros((len(times), rows.shape[1]))
    np.add.at(out, at, rows)
    return times, out


def _efron(v: np.ndarray, later: np.ndarray, p: int, beta: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian of one range; ``v`` by ascending time, ``later`` the sums of all later ranges."""
    k = 1 + p + p * (p + 1) // 2
    risk = np.cumsum(v[::-1, :k], axis=0)[::-1] + later
    tied, deaths, sx = v[:, k : 2 * k], v[:, 2 * k], v[:, 2 * k + 1 :]
    out = np.zeros(1 + p + p * (p + 1) // 2)
    out[0], out[1 : 1 + p] = (sx @ beta).sum(), sx.sum(axis=0)
    at = np.repeat(np.flatnonzero(deaths > 0), deaths[deaths > 0].astype(np.int64))
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1]) if len(at) else np.zeros(0, dtype=np.int64)
    order = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
    for lo in range(0, len(at), 50_000):
        i, share = at[lo : lo + 50_000], (order[lo : lo + 50_000] / deaths[at[lo : lo + 50_000]])[:, None]
        s = risk[i] - share * tied[i]
        mean = s[:, 1 : 1 + p] / s[:, :1]
        out[0] -= np.log(s[:, 0]).sum()
        out[1 : 1 + p] -= mean.sum(axis=0)
        out[1 + p :] -= (s[:, 1 + p :] / s[:, :1] - packed(mean)).sum(axis=0)
    return out


def cox(rows: DataFrame, covariates, penalty: float = PENALTY, ranges: int = RANGES) -> Cox:
    """Proportional hazards with ties after Efron; the penalty counts as often as there are rows."""
    n, events = rows.agg(F.count(F.lit(1)), F.sum("event")).first()
    admitted = Covariates.admit(rows, covariates, int(events or 0) // EVENTS_EACH)
    p = len(admitted.names)
    if not p:
        return Cox(admitted, ())
    k = 1 + p + p * (p + 1) // 2
    edges = Levels.learn(rows, ["months"], ranges)
    dealt = rows.select(F.col("months").cast("double"), F.col("event").cast("double"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(admitted.names)])
    many = len(edges.edges[0]) + 1

    def value(beta: np.ndarray):
        def partial(batches):
            for batch in batches:
                times, v = _by_time(matrix(batch.columns), admitted, beta)
                at = edges.index(times[:, None])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(times), pa.array(list(v), pa.list_(pa.float64()))], names=["range", "months", "v"])

        part = dealt.mapInArrow(partial, "range int, months double, v array<double>")
        totals = np.zeros((many, k))
        for r in part.groupBy("range").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(k)]).alias("v")).toLocalIterator():
            totals[r.range] = r.v
        later = np.cumsum(totals[::-1], axis=0)[::-1] - totals

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            times, at = np.unique(pdf.months.to_numpy(), return_inverse=True)
            v = np.zeros((len(times), 2 * k + 1 + p))
            np.add.at(v, at, np.stack(pdf.v.to_list()))
            return pd.DataFrame({"at": np.arange(k), "x": _efron(v, later[int(pdf.range.iloc[0])], p, beta)})

        got = np.zeros(k)
        for r in part.groupBy("range").applyInPandas(finish, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():
            got[r["at"]] = r.x
        got /= n
        return got[0] - penalty * (beta @ beta) / 2, got[1 : 1 + p] - penalty * beta, unpacked(got[1 + p :], p) - penalty * np.eye(p)

    return Cox(admitted, tuple(newton(np.zeros(p), value)))


def risk(rows: DataFrame, model: Cox) -> DataFrame:
    """(months, event, risk) with the log hazard of every row."""
    terms = [F.coalesce(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")), F.lit(f)) / s * b for n, f, s, b in zip(model.covariates.names, model.covariates.fill, model.covariates.scale, model.coefficients, strict=True)]
    return rows.select("months", "event", sum(terms, F.lit(0.0)).alias("risk"))


def _pairs(order: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weights of pairs of an event and a row of greater order: with lower risk, with equal risk, all."""
    values, at = np.unique(risk, return_inverse=True)
    tree, size = np.zeros(len(values) + 1), len(values)

    def below(i: int) -> float:
        total = 0.0
        while i > 0:
            total += tree[i]
            i -= i & -i
        return total

    low = same = every = 0.0
    by, cut = np.argsort(-order, kind="stable"), 0
    ordered = order[by]
    seen = 0.0
    while cut < len(by):
        stop = cut + int(np.searchsorted(-ordered[cut:], -ordered[cut], side="right"))
        group = by[cut:stop]
        for i in group[event[group] > 0]:
            w, r = weight[i], int(at[i])
            less, up_to = below(r), below(r + 1)
            low, same, every = low + w * less, same + w * (up_to - less), every + w * seen
        for i in group:
            j = int(at[i]) + 1
            while j <= size:
                tree[j] += weight[i]
                j += j & -j
            seen += weight[i]
        cut = stop
    return low, same, every


def concordance(rows: DataFrame, ranges: int = RANGES) -> float:
    """The share of comparable pairs in which the row that leaves first has the higher risk, equal risks counting half; half if no pair is comparable.

    ``rows`` has months, event and risk. A pair is comparable if one row has its event before the other
    leaves, or at the time at which the other is censored.
    """
    own = rows.select(F.col("months").cast("double").alias("months"), (F.col("event") > 0).cast("int").alias("event"), F.col("risk").cast("double").alias("risk"))
    edges = Levels.learn(own, ["months", "risk"], ranges)
    time, level = edges.columns()
    # of equal times the events come first; an event and a censored row of one time are a pair
    cells = own.select(time.alias("a"), level.alias("b"), (1 - F.col("event")).alias("late"), "months", "event", "risk").groupBy("a", "b", "months", "late", "risk", "event").agg(F.count(F.lit(1)).cast("double").alias("w"))
    size = [len(e) + 1 for e in edges.edges]
    events, every = np.zeros(size), np.zeros(size)
    for r in cells.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("event")).alias("e"), F.sum("w").alias("n")).toLocalIterator():
        events[r.a, r.b], every[r.a, r.b] = r.e, r.n
    later = np.cumsum(every[::-1], axis=0)[::-1] - every
    lower = np.cumsum(later, axis=1) - later
    low, same, comparable = (events * lower).sum(), 0.0, (events * later.sum(axis=1, keepdims=True)).sum()

    def within(order: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rank = pd.MultiIndex.from_frame(pdf[order]).factorize(sort=True)[0] if len(order) > 1 else pdf[order[0]].to_numpy()
            return pd.DataFrame([_pairs(np.asarray(rank), pdf.event.to_numpy(), pdf.risk.to_numpy(), pdf.w.to_numpy())], columns=["low", "same", "every"])

        return run

    # one value of time or risk may hold most rows: pairs within it are not comparable, or all have equal risk
    few = cells.groupBy("a").agg((F.count_distinct("months", "late") > 1).alias("mixed")).where("mixed").select("a")
    for r in cells.join(F.broadcast(few), "a").groupBy("a").applyInPandas(within(["months", "late"]), "low double, same double, every double").toLocalIterator():
        low, same, comparable = low + r.low, same + r.same, comparable + r.every
    alike = cells.groupBy("b", "a", "risk").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("event")).alias("e"))
    alike = alike.select("b", "a", "risk", F.explode(F.array(F.struct(F.lit(1).alias("event"), F.col("e").alias("w")), F.struct(F.lit(0).alias("event"), (F.col("w") - F.col("e")).alias("w")))).alias("c")).select("b", "a", "risk", "c.*").where("w > 0")
    for r in alike.groupBy("b").applyInPandas(within(["a"]), "low double, same double, every double").toLocalIterator():
        low, same = low + r.low, same + r.same
    return float((low + same / 2) / comparable) if comparable else 0.5
