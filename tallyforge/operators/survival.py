"""Survival: durations, Cox regression, baseline curve, risk strata and concordance.

Risk sets are suffix sums over distinct times (``scan.running_sums``), so neither a
time nor the sort of all times meets in one task. What comes to the driver are the
sums of a Newton step: one likelihood, p gradient and p x p curvature numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import first_at_or_above, range_edges, range_of, running_sums

MONTH = 86400 * 30.44
# Words that mean an event or none.
EVENT_WORDS = {"positive": 1, "negative": 0, "yes": 1, "no": 0, "true": 1, "false": 0, "1": 1, "0": 0, "event": 1, "censored": 0, "dead": 1, "alive": 0}


def months_between(start: Column, end: Column) -> Column:
    """Months of 30.44 days from start to end, at least 0."""
    seconds = F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6
    return F.greatest(seconds / MONTH, F.lit(0.0))


def event_flag(c: Column) -> Column:
    """1 for a word that means an event or a number above 0.5, else 0, null included."""
    text = F.lower(c.cast("string"))
    known = F.when(text.isin([w for w, v in EVENT_WORDS.items() if v]), 1.0).when(text.isin([w for w, v in EVENT_WORDS.items() if not v]), 0.0)
    return F.coalesce(F.coalesce(known, text.try_cast("double")) > 0.5, F.lit(False)).cast("int")


def survival_table(df: DataFrame, time: str, event: str, features: list[str]) -> DataFrame:
    """``df`` with ``time`` (missing: the median; at least 0.001), ``event`` (0 or 1) and features (missing: their median, 0 for a column without values) as numbers. One aggregate fits it."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    middle = df.agg(*[F.percentile(number(c), 0.5).alias(f"_m{i}") for i, c in enumerate([time, *features])])
    out = df.crossJoin(F.broadcast(middle))  # one row
    fill = {c: F.coalesce(F.nanvl(number(c), F.col(f"_m{i + 1}")), F.col(f"_m{i + 1}"), F.lit(0.0)) for i, c in enumerate(features)}
    span = F.greatest(F.coalesce(number(time), F.col("_m0"), F.lit(1.0)), F.lit(0.001))
    return out.withColumns(fill | {time: span, event: event_flag(F.col(event))}).select(df.columns)


def pruned_features(df: DataFrame, time: str, event: str, features: list[str], least_variance: float = 1e-12, most_correlated: float = 0.98) -> list[str]:
    """The features that a regression can tell apart, in order.

    Gone are those that repeat an earlier column cell by cell (nulls included),
    those with a variance of at most ``least_variance``, those whose correlation with time is at least
    ``most_correlated``, and then those so correlated with any feature before
    them. One aggregate: variances, and a number for each pair.
    """
    columns = [time, event, *features]
    same, corr = [], []
    for j in range(2, len(columns)):
        for i in range(j):
            same.append(F.min(F.col(columns[i]).cast("double").eqNullSafe(F.col(columns[j]).cast("double")).cast("int")).alias(f"s{i}_{j}"))
            if i != 1:
                both = F.col(columns[i]).isNotNull() & F.col(columns[j]).isNotNull()
                x, y = (F.when(both, F.col(columns[k]).cast("double")) for k in (i, j))
                corr.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"c{i}_{j}"))
    one = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)], *same, *corr).first()
    strong = lambda i, j: one[f"c{i}_{j}"] is not None and not math.isnan(one[f"c{i}_{j}"]) and abs(one[f"c{i}_{j}"]) >= most_correlated
    left = [j for j in range(2, len(columns)) if not any(one[f"s{i}_{j}"] for i in range(j))]
    left = [j for j in left if (one[f"v{j}"] or 0.0) > least_variance and not strong(0, j)]
    return [columns[j] for j in left if not any(strong(i, j) for i in left if i < j)]


@dataclass
class Cox:
    """A fitted model. Coefficients are per unit of a feature; ``mean`` centres it."""

    features: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    mean: np.ndarray
    log_likelihood: float
    rows: int
    steps: int

    def hazard(self) -> Column:
        """The partial hazard of a row, 1 for one at the mean of all features."""
        total = F.lit(0.0)
        for c, b, m in zip(self.features, self.coefficients, self.mean, strict=True):
            total = total + F.lit(float(b)) * (F.col(c) - F.lit(float(m)))
        return F.exp(total)

    def table(self, df: DataFrame) -> DataFrame:
        """(feature, coefficient, hazard_ratio, standard_error, z, p_value)."""
        z = [float(b / e) if e > 0 else math.nan for b, e in zip(self.coefficients, self.errors, strict=True)]
        rows = [(c, float(b), math.exp(b), float(e), v, math.erfc(abs(v) / math.sqrt(2))) for c, b, e, v in zip(self.features, self.coefficients, self.errors, z, strict=True)]
        return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, hazard_ratio double, standard_error double, z double, p_value double")

    def criteria(self) -> dict[str, float]:
        """AIC and BIC of the unpenalised partial likelihood at the fit."""
        k = len(self.features)
        return {"log_likelihood": self.log_likelihood, "aic": -2 * self.log_likelihood + 2 * k, "bic": -2 * self.log_likelihood + k * math.log(max(self.rows, 1))}


def _tied_sums(s0: np.ndarray, t0: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each time the sums over its d events, the l-th having the risk sum s = S0 - l/d T0, of: log s, 1/s, f/s, 1/s^2, f/s^2, f^2/s^2 with f = l/d."""
    out = np.stack([np.log(s0), 1 / s0, np.zeros_like(s0), 1 / s0**2, np.zeros_like(s0), np.zeros_like(s0)])
    for i in np.flatnonzero(d > 1):
        out[:, i] = 0.0
        for lo in range(0, int(d[i]), 1 << 20):
            f = np.arange(lo, min(lo + (1 << 20), int(d[i]))) / d[i]
            s = s0[i] - f * t0[i]
            out[:, i] += [np.log(s).sum(), (1 / s).sum(), (f / s).sum(), (1 / s**2).sum(), (f / s**2).sum(), (f * f / s**2).sum()]
    return out


def _step(rows: DataFrame, p: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Partial log-likelihood, gradient and curvature at ``beta`` over rows (t, event, z0, z1, ...), ties by Efron's rule."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    score = F.lit(0.0)
    for i in range(p):
        score = score + F.lit(float(beta[i])) * F.col(f"z{i}")
    rows = rows.withColumn("xb", score).withColumn("w", F.exp("xb")).withColumn("we", F.col("w") * F.col("event"))
    risk = ["s", *[f"s{i}" for i in range(p)], *[f"s{i}_{j}" for i, j in pairs]]
    made = [F.sum("event").alias("d"), F.sum(F.col("xb") * F.col("event")).alias("xb"), *[F.sum(F.col(f"z{i}") * F.col("event")).alias(f"e{i}") for i in range(p)]]
    for name, weight in (("s", "w"), ("t", "we")):
        made.append(F.sum(weight).alias(name))
        made += [F.sum(F.col(weight) * F.col(f"z{i}")).alias(f"{name}{i}") for i in range(p)]
        made += [F.sum(F.col(weight) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"{name}{i}_{j}") for i, j in pairs]
    times = rows.groupBy(F.col("t").alias("time")).agg(*made).persist()
    at_risk = running_sums(times, "time", risk, descending=True).where("d > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            both = lambda name: np.stack([[get(f"{name}{max(i, j)}_{min(i, j)}") for j in range(p)] for i in range(p)])
            ones = lambda name: np.stack([get(f"{name}{i}") for i in range(p)])
            log, a, b, c, e, f = _tied_sums(get("cum_s"), get("t"), get("d"))
            s1, t1 = ones("cum_s"), ones("t")
            total[0] += (get("xb") - log).sum()
            total[1 : 1 + p] += (ones("e") - s1 * a + t1 * b).sum(1)
            mixed = np.einsum("in,jn,n->ij", s1, t1, e)
            curve = (both("cum_s") * a - both("t") * b).sum(2) - np.einsum("in,jn,n->ij", s1, s1, c) + mixed + mixed.T - np.einsum("in,jn,n->ij", t1, t1, f)
            total[1 + p :] += curve.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "v"])

    sums = at_risk.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    times.unpersist()
    total = np.zeros(1 + p + p * p)
    for r in sums:
        total[r.cell] = r.v
    return float(total[0]), total[1 : 1 + p], total[1 + p :].reshape(p, p)


def cox(df: DataFrame, time: str, event: str, features: list[str], penalty: float = 2.0, most: int = 50, tolerance: float = 1e-9) -> Cox:
    """Cox regression by Newton steps, tied times by Efron's rule.

    Features are scaled to deviation 1 (of a sample); ``penalty`` / 2 times the
    rows times the squared norm of the scaled coefficients is taken off the
    likelihood. A step that lowers the penalised likelihood is halved. Constant
    features get coefficient 0. Rows with a missing value are left out. Each step
    is one aggregate to distinct times and their suffix sums.
    """
    whole = F.lit(True)
    for c in (time, event, *features):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(whole)
    fit = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    mean = np.array([fit[f"m{i}"] or 0.0 for i in range(len(features))], float)
    spread = np.array([fit[f"s{i}"] or 0.0 for i in range(len(features))], float)
    used = [i for i in range(len(features)) if spread[i] > 0 and not math.isnan(spread[i])]
    z = rows.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("event"), *[((F.col(features[i]) - F.lit(float(mean[i]))) / F.lit(float(spread[i]))).alias(f"z{k}") for k, i in enumerate(used)])
    if not used:
        z = z.withColumn("z0", F.lit(0.0))  # the likelihood of no feature
    p = max(len(used), 1)
    n, beta, before, step, made = fit.n, np.zeros(p), -math.inf, np.zeros(p), 0
    value, curve = 0.0, np.eye(p)
    for made in range(1, most + 1):
        value, slope, curve = _step(z, p, beta)
        reached = value - n * penalty / 2 * float(beta @ beta)
        if reached < before - 1e-9 * abs(before):
            step = step / 2
            beta = beta - step
            continue
        before = reached
        curve = curve + n * penalty * np.eye(p)
        step = np.linalg.lstsq(curve, slope - n * penalty * beta, rcond=None)[0]
        if np.abs(step).max() < tolerance:
            break
        beta = beta + step
    coefficients, errors = np.zeros(len(features)), np.zeros(len(features))
    inverse = np.linalg.pinv(curve)
    for k, i in enumerate(used):
        coefficients[i], errors[i] = beta[k] / spread[i], math.sqrt(max(inverse[k, k], 0.0)) / spread[i]
    return Cox(list(features), coefficients, errors, mean, value, n, made)


def baseline_survival(df: DataFrame, time: str, event: str, hazard: Column) -> DataFrame:
    """(time, events, at_risk, cumulative_hazard, survival) of each distinct time: events over the hazards at risk, summed up to it; survival is exp of minus that."""
    times = df.where(F.col(time).isNotNull()).groupBy(F.col(time).cast("double").alias("time")).agg(F.sum(event).cast("double").alias("events"), F.sum(hazard).alias("w")).persist()
    risk = running_sums(times, "time", ["w"], descending=True).select("time", "events", F.col("cum_w").alias("at_risk"), (F.col("events") / F.col("cum_w")).alias("h"))
    out = running_sums(risk, "time", ["h"])
    return out.select("time", "events", "at_risk", F.col("cum_h").alias("cumulative_hazard"), F.exp(-F.col("cum_h")).alias("survival"))


def retention(curve: DataFrame, months: list[float]) -> DataFrame:
    """(months, time, rate): the survival at the curve's time nearest to each of ``months`` (the earlier one on a tie), in percent with two digits; one aggregate."""
    near = lambda m: F.min(F.struct(F.abs(F.col("time") - F.lit(float(m))).alias("off"), "time", "survival"))
    one = curve.agg(*[near(m).alias(f"r{i}") for i, m in enumerate(months)])
    rows = F.array(*[F.struct(F.lit(float(m)).alias("months"), F.col(f"r{i}.time").alias("time"), F.round(F.col(f"r{i}.survival") * 100, 2).alias("rate")) for i, m in enumerate(months)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("time is not null")


def risk_probability(df: DataFrame, hazard: str) -> DataFrame:
    """Adds ``risk_prob``: the hazard from the least (0) to the largest (1); null where all are equal."""
    ends = df.agg(F.min(hazard).alias("_lo"), F.max(hazard).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn("risk_prob", F.try_divide(F.col(hazard) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")  # one row


def risk_strata(df: DataFrame, time: str, event: str, hazard: str, curve: DataFrame) -> DataFrame:
    """One row of how well hazards part the table.

    low and high thresholds are the hazards' 25 and 75 percentiles; event rates
    beyond them and their difference; precision and recall of the upper ones for
    events (0 where nothing is counted); the median of the predicted median
    lives, where a row's ``curve`` to the power of its hazard first falls to a
    half (the last time where it never does); and 1 less their mean absolute
    error over the mean time, between 0 and 1.
    """
    last = curve.agg(F.max("time").alias("_last"))
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), F.col(hazard).alias("w")).withColumn("_need", F.lit(math.log(2)) / F.col("w"))
    lives = first_at_or_above(rows, "_need", curve, "cumulative_hazard", "time", "life").crossJoin(F.broadcast(last)).withColumn("life", F.coalesce("life", "_last"))
    ends = df.agg(F.percentile(hazard, 0.25).alias("low_threshold"), F.percentile(hazard, 0.75).alias("high_threshold"))
    both = lives.crossJoin(F.broadcast(ends))  # one row each
    high, low = F.col("w") >= F.col("high_threshold"), F.col("w") <= F.col("low_threshold")
    one = both.agg(
        F.first("low_threshold").alias("low_threshold"), F.first("high_threshold").alias("high_threshold"), F.coalesce(F.avg(F.when(high, F.col("e"))), F.lit(0.0)).alias("high_risk_event_rate"),
        F.coalesce(F.avg(F.when(low, F.col("e"))), F.lit(0.0)).alias("low_risk_event_rate"), F.coalesce(F.try_divide(F.sum(F.when(high, F.col("e"))), F.sum(high.cast("double"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.sum(F.when(high, F.col("e"))), F.sum("e")), F.lit(0.0)).alias("recall"), F.percentile("life", 0.5).alias("median_life"), F.avg(F.abs(F.col("life") - F.col("t"))).alias("mae"), F.avg("t").alias("mean_time"),
    )
    accuracy = F.least(F.greatest(1 - F.try_divide(F.col("mae"), F.col("mean_time")), F.lit(0.0)), F.lit(1.0))
    return one.select("low_threshold", "high_threshold", "high_risk_event_rate", "low_risk_event_rate", (F.col("high_risk_event_rate") - F.col("low_risk_event_rate")).alias("risk_separation"), "precision", "recall", "median_life", accuracy.alias("time_accuracy"))


def _pairs_within(place: np.ndarray, score: np.ndarray, many: np.ndarray, events: np.ndarray) -> tuple[float, float]:
    """(concordant, tied) pairs of rows sorted by place: the first is an event and stands at a smaller place; concordant if its score is smaller too. Rows are weighted by ``many``, as firsts by ``events``."""
    n = len(place)
    if n < 2 or place[0] == place[-1]:
        return 0.0, 0.0
    if n <= 128:
        before = (place[:, None] < place[None]) * events[:, None] * many[None]
        return float((before * (score[:, None] < score[None])).sum()), float((before * (score[:, None] == score[None])).sum())
    cut = int(np.searchsorted(place, place[n // 2]))
    if cut == 0:
        cut = int(np.searchsorted(place, place[0], side="right"))
    order = np.argsort(score[cut:], kind="stable")
    right, weight = score[cut:][order], np.r_[0.0, np.cumsum(many[cut:][order])]
    up, to = np.searchsorted(right, score[:cut], side="right"), np.searchsorted(right, score[:cut], side="left")
    concordant, tied = float((events[:cut] * (weight[-1] - weight[up])).sum()), float((events[:cut] * (weight[up] - weight[to])).sum())
    for part in (slice(0, cut), slice(cut, n)):
        c, t = _pairs_within(place[part], score[part], many[part], events[part])
        concordant, tied = concordant + c, tied + t
    return concordant, tied


def concordance(df: DataFrame, time: str, event: str, score: str, ranges: int = 64) -> DataFrame:
    """(concordant, tied, pairs, index) of predicted lives: ``score`` is larger for those who should last longer.

    A pair counts if one had its event and the other stayed longer, or was
    censored at the same time; it is concordant if the first one's score is
    smaller, a tie counts half. Equal (time, event, score) rows are one with a
    weight. Places in time and scores are cut into ranges: pairs of other ranges
    in both are counted from a table of ranges x ranges, the rest by merging
    inside each range of places, and inside each range of scores across ranges
    of places. Rows with a missing value are left out; without pairs the index
    is null. More rows need more ``ranges``: a range is one task's merge.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(score).isNotNull())
    rows = rows.groupBy(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), F.col(score).cast("double").alias("s")).agg(F.count("*").cast("double").alias("many")).persist()
    by_time, by_score = range_edges(rows, "t", ranges), range_edges(rows, "s", ranges)
    cut = rows.select("t", "e", "s", "many", range_of(F.col("t"), by_time).alias("i"), range_of(F.col("s"), by_score).alias("j"))
    # pairs of different ranges of time, from counts
    cells = cut.groupBy("i", "j").agg(F.sum("many").alias("n"), F.sum(F.col("many") * F.col("e")).alias("events")).collect()  # ranges x ranges numbers
    n, events = np.zeros((len(by_time) + 1, len(by_score) + 1)), np.zeros((len(by_time) + 1, len(by_score) + 1))
    for r in cells:
        n[r.i, r.j], events[r.i, r.j] = r.n, r.events
    later = n[::-1].cumsum(0)[::-1] - n
    above = later[:, ::-1].cumsum(1)[:, ::-1] - later
    concordant, tied, pairs = float((events * above).sum()), 0.0, float((events.sum(1) * later.sum(1)).sum())
    form = "concordant double, tied double, pairs double"

    def inside(table: pa.Table) -> pa.Table:
        t, e, s, many = (table.column(c).to_numpy() for c in ("t", "e", "s", "many"))
        place = np.unique(np.stack([t, 1 - e], axis=1), axis=0, return_inverse=True)[1].ravel()  # events before those censored at the same time
        order = np.argsort(place, kind="stable")
        place, s, many, own = place[order], s[order], many[order], (many * e)[order]
        c, d = _pairs_within(place, s, many, own)
        at = np.searchsorted(place, place, side="right")
        total = float((own * (many.sum() - np.r_[0.0, np.cumsum(many)][at])).sum())
        return pa.table({"concordant": [c], "tied": [d], "pairs": [total]})

    def across(table: pa.Table) -> pa.Table:
        i, e, s, many = (table.column(c).to_numpy() for c in ("i", "e", "s", "many"))
        order = np.argsort(i, kind="stable")
        c, d = _pairs_within(i[order], s[order], many[order], (many * e)[order])
        return pa.table({"concordant": [c], "tied": [d], "pairs": [0.0]})

    merged = cut.groupBy("i").applyInArrow(inside, form).unionByName(cut.groupBy("j").applyInArrow(across, form))
    one = merged.agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) + F.lit(v)).alias(c) for c, v in (("concordant", concordant), ("tied", tied), ("pairs", pairs))])
    return one.withColumn("index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("pairs")))
