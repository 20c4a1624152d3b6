"""Evaluation of scored tables: confusion, losses, reliability, conformal sets, decision curves, shifts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import exact_quantiles


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, y: str, predicted: str, positive: object = 1) -> DataFrame:
    """(rows, accuracy, precision, recall, f1, conversion_rate): classes weighted by their rows, a class never predicted has precision 0; the last is the ``positive`` class's hits among its predictions, in percent, 0 without any.

    It comes from the confusion counts, a row per pair of classes.
    """
    counts = confusion(df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()), y, predicted)
    cells = counts.select("n", F.col("y").cast("string").alias("y"), F.col("predicted").cast("string").alias("p"), ((F.col("y") == positive) & (F.col("predicted") == positive)).alias("won"), (F.col("predicted") == positive).alias("called"))
    side = lambda c: F.struct(F.col(c).alias("label"), F.when(F.lit(c == "y"), F.col("n")).otherwise(0).alias("real"), F.when(F.lit(c == "p"), F.col("n")).otherwise(0).alias("guessed"), F.when((F.col("y") == F.col("p")) & F.lit(c == "y"), F.col("n")).otherwise(0).alias("hit"))
    each = cells.select(F.explode(F.array(side("y"), side("p"))).alias("r")).select("r.*").groupBy("label").agg(F.sum("real").alias("real"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    precision, recall = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "real"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    mean = lambda c: F.try_divide(F.sum(F.col("real") * c), F.sum("real"))
    one = each.agg(F.coalesce(F.sum("real"), F.lit(0)).alias("rows"), F.try_divide(F.sum("hit"), F.sum("real")).alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"))
    won = cells.agg((100 * F.coalesce(F.try_divide(F.sum(F.when(F.col("won"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("called"), F.col("n")).otherwise(0))), F.lit(0.0))).alias("conversion_rate"))
    return one.crossJoin(F.broadcast(won))  # one row each


def class_losses(df: DataFrame, y: str, probabilities: str, classes: list, clip: float = 1e-15) -> DataFrame:
    """(rows, log_loss, brier) of an array of probabilities by class: the Brier score is the mean over rows and classes."""
    place = F.array_position(F.array(*[F.lit(c).cast("string") for c in classes]), F.col(y).cast("string")).cast("int")
    p = F.get(probabilities, place - 1)
    spread = F.aggregate(F.transform(probabilities, lambda v, i: (v - F.when(i == place - 1, 1.0).otherwise(0.0)) ** 2), F.lit(0.0), lambda a, v: a + v)
    rows = df.where(place > 0)
    return rows.agg(F.count("*").alias("rows"), F.avg(-F.log(F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))).alias("log_loss"), F.avg(spread / len(classes)).alias("brier"))


def regression_report(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """(rows, mae, mse, rmse, r2) of rows with both; r2 is null where the target does not vary."""
    off = F.col(predicted) - F.col(y)
    one = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("rows"), F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.var_pop(F.col(y).cast("double")).alias("_v"))
    return one.select("rows", "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "_v")).alias("r2"))


def losses(df: DataFrame, y: str, p: str, clip: float = 1e-15) -> DataFrame:
    """accuracy, log loss and Brier score of a binary probability."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    log = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    return df.agg(F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.avg(log).alias("log_loss"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def decision_curve(df: DataFrame, y: str, p: str, gain: float = 100, cost: float = -10) -> DataFrame:
    """Volume, precision, recall and expected profit at thresholds 0.1 to 0.9, from one aggregate."""
    at = [round(0.1 * i, 1) for i in range(1, 10)]
    hit = lambda t: F.col(p) >= t
    one = df.agg(F.sum(F.col(y)).alias("pos"), *[F.count_if(hit(t)).alias(f"v{i}") for i, t in enumerate(at)], *[F.count_if(hit(t) & (F.col(y) == 1)).alias(f"t{i}") for i, t in enumerate(at)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"v{i}").alias("volume"), F.col(f"t{i}").alias("tp"), F.col("pos").alias("pos")) for i, t in enumerate(at)])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    return r.select("threshold", "volume", F.try_divide("tp", "volume").alias("precision"), F.try_divide("tp", "pos").alias("recall"), (gain * F.col("tp") + cost * (F.col("volume") - F.col("tp"))).cast("double").alias("expected_profit"))


def conformal_threshold(df: DataFrame, p_true: Column, alpha: float = 0.1, by: str | None = None) -> DataFrame:
    """The 1 - alpha quantile of 1 - p_true, for all rows or per class."""
    q = F.percentile(1 - p_true, 1 - alpha).alias("threshold")
    return df.groupBy(by).agg(q) if by else df.agg(q)


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, center, conf, acc, n) of the predicted class's probability by equal-frequency edges; a value on an inner edge counts in both bins, an empty bin has n 0."""
    scored = df.select(F.greatest(F.col(p), 1 - F.col(p)).alias("q"), ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double").alias("right"))
    edges = scored.agg(F.percentile("q", F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("e"))
    spans = edges.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(F.col("e")[i].alias("lo"), F.col("e")[i + 1].alias("hi")))).alias("bin", "span"))
    spans = spans.select("bin", "span.lo", "span.hi")
    inside = (F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi") + 1e-12)
    found = scored.join(F.broadcast(spans), inside).groupBy(F.col("bin").alias("_b")).agg(F.avg("q").alias("conf"), F.avg("right").alias("acc"), F.count("*").alias("n"))
    return spans.join(found, F.col("bin") == F.col("_b"), "left").select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("center"), "conf", "acc", F.coalesce("n", F.lit(0)).alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def prediction_sets(df: DataFrame, probabilities: dict[str, Column], threshold: float, most: int = 2) -> DataFrame:
    """Adds ``labels``, the classes with 1 - p of at most ``threshold``, most probable first and at most ``most``, and ``abstained`` for none."""
    cells = F.array(*[F.struct((-p).alias("order"), F.lit(c).alias("label")) for c, p in probabilities.items()])
    inside = F.filter(cells, lambda s: 1 + s["order"] <= threshold)
    labels = F.transform(F.slice(F.array_sort(inside), 1, most), lambda s: s["label"])
    return df.withColumn("labels", labels).withColumn("abstained", F.size("labels") == 0)


def set_metrics(sets: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """coverage, avg_set_size and abstention_rate of prediction sets, for all rows or per segment."""
    made = [F.count("*").alias("n"), F.avg(F.array_contains("labels", F.col(y)).cast("double")).alias("coverage"), F.avg(F.size("labels")).alias("avg_set_size"), F.avg(F.col("abstained").cast("double")).alias("abstention_rate")]
    return sets.groupBy(F.col(by).alias("segment")).agg(*made) if by else sets.agg(*made)


def _log_gamma_ratio(v: float) -> float:
    return math.lgamma((v + 1) / 2) - math.lgamma(v / 2)


def student_tail(t: float, v: float) -> float:
    """Two-sided tail of Student's t with v degrees of freedom: the incomplete beta function by its continued fraction."""
    x, a, b = v / (v + t * t), v / 2, 0.5
    if t == 0:
        return 1.0
    front = math.exp(_log_gamma_ratio(v) - math.log(math.pi) / 2 + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    part = front * total / a
    return min(max(1 - part if flip else part, 0.0), 1.0)


def student_quantile(tail: float, v: float) -> float:
    """The t whose two-sided tail is ``tail``, by halving."""
    lo, hi = 0.0, 1.0
    while student_tail(hi, v) > tail:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_tail(mid, v) > tail else (lo, mid)
    return (lo + hi) / 2


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a table of four counts: the tables with these margins that are not likelier."""
    rows, column, n = a + b, a + c, a + b + c + d
    k = np.arange(max(0, rows + column - n), min(rows, column) + 1)
    log = np.vectorize(math.lgamma, otypes=[float])
    choose = lambda m, j: math.lgamma(m + 1) - log(j + 1) - log(m - j + 1)
    p = np.exp(choose(rows, k) + choose(n - rows, column - k) - choose(n, np.array([column]))[0])
    return float(min(p[p <= p[k == a][0] * (1 + 1e-7)].sum(), 1.0))


def _risk(change: float) -> str:
    return "higher_risk" if change > 0 else "lower_risk" if change < 0 else "similar_risk"


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def set_sizes(sets: DataFrame) -> DataFrame:
    """(size, n, share) of prediction sets."""
    total = sets.agg(F.count("*").alias("_t"))
    return sets.groupBy(F.size("labels").alias("size")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("size", "n", (F.col("n") / F.col("_t")).alias("share"))  # one row


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row of a decision curve with the largest expected profit, the lowest threshold on a tie."""
    row = F.struct(*curve.columns)
    return curve.agg(F.min_by(row, F.struct((-F.col("expected_profit")).alias("p"), "threshold")).alias("r")).select("r.*")


def scenario_summary(df: DataFrame, before: str, after: str, classification: bool, desired: float | None = None) -> DataFrame:
    """One row of what a scenario changes, from one aggregate and the exact median by brackets.

    The prediction's mean, median and mean absolute change; means before and
    after with the change and its percent (null for a base of 0); the sum of
    changes; and with a ``desired`` outcome, for classes the percent of rows
    that reach it, else of rows that moved towards it.
    """
    a, b = F.col(before).cast("double"), F.col(after).cast("double")
    d = b - a
    middle = exact_quantiles(df.select(d.alias("d")), ["d"], [0.5])["d"][0]
    reach = F.lit(None).cast("double") if desired is None else 100 * F.avg((b == desired).cast("double") if classification else (F.signum(F.lit(float(desired)) - a) == F.signum(d)).cast("double"))
    return df.agg(
        F.count("*").alias("n_samples"), F.avg(d).alias("pred_delta_mean"), F.lit(middle).cast("double").alias("pred_delta_median"), F.avg(F.abs(d)).alias("pred_delta_abs_mean"), F.avg(a).alias("mean_baseline"), F.avg(b).alias("mean_new"),
        (F.avg(b) - F.avg(a)).alias("uplift_abs"), (100 * F.try_divide(F.avg(b) - F.avg(a), F.abs(F.avg(a)))).alias("uplift_pct"), F.sum(d).alias("total_delta"), reach.alias("success_rate" if classification else "moved_toward_goal_pct"),
    )


def paired_means(df: DataFrame, before: str, after: str, level: float = 0.95, unit_value: float = 20.0) -> DataFrame:
    """One row that compares two predictions of each row by their means.

    Means, percent change (0 for a mean of 0), the paired t test and its
    interval by Student's t, the effect size (the change over the root of the
    mean of both variances), the change of the deviations (all of the
    population), risk_assessment by its sign, and the revenue of the rounded
    means' change at ``unit_value`` a unit. Missing and infinite predictions
    count as 0. One aggregate; the tails are computed from its one row. Without
    spread, or with one row, t, p and the interval are null.
    """
    a, b = _finite(before), _finite(after)
    d = b - a
    r = df.agg(F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.avg(d).alias("md"), F.stddev_samp(d).alias("sd")).first()
    form = "rows long, original_mean double, modified_mean double, percent_change double, t_statistic double, p_value double, is_significant boolean, ci_low double, ci_high double, effect_size double, variance_change double, risk_assessment string, estimated_revenue_impact double"
    if not r.n:
        return df.sparkSession.createDataFrame([], form)
    error = (r.sd or 0.0) / math.sqrt(r.n)
    t = r.md / error if error > 0 else None
    p = student_tail(t, r.n - 1) if t is not None else None
    half = student_quantile(1 - level, r.n - 1) * error if t is not None else None
    pooled = math.sqrt((r.sa**2 + r.sb**2) / 2)
    change = round(r.sb - r.sa, 4)
    ma, mb = round(r.ma, 4), round(r.mb, 4)
    row = (r.n, ma, mb, round((r.mb - r.ma) / r.ma * 100, 2) if r.ma else 0.0, t, p, None if p is None else p < 1 - level, None if half is None else r.md - half, None if half is None else r.md + half, round((r.mb - r.ma) / pooled, 4) if pooled else 0.0, change, _risk(change), round((mb - ma) * r.n * unit_value, 2))
    return df.sparkSession.createDataFrame([row], form)


def paired_rates(df: DataFrame, before: str, after: str, cut: float = 0.5, level: float = 0.95) -> DataFrame:
    """One row that compares the shares of predictions of at least ``cut``: rates, percent change, and the p of the pooled z test, or of Fisher's exact test where a count is below five; the change of the predictions' deviations and its sign. Missing and infinite predictions count as 0."""
    a, b = _finite(before), _finite(after)
    r = df.agg(F.count("*").alias("n"), F.count_if(a >= cut).alias("ca"), F.count_if(b >= cut).alias("cb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb")).first()
    form = "rows long, original_rate double, modified_rate double, percent_change double, test string, p_value double, is_significant boolean, variance_change double, risk_assessment string"
    if not r.n:
        return df.sparkSession.createDataFrame([], form)
    ra, rb = r.ca / r.n, r.cb / r.n
    if min(r.ca, r.cb, r.n - r.ca, r.n - r.cb) >= 5:
        pool = (r.ca + r.cb) / (2 * r.n)
        test, p = "z-test", math.erfc(abs(rb - ra) / math.sqrt(pool * (1 - pool) * 2 / r.n) / math.sqrt(2))
    else:
        test, p = "fisher", fisher_exact(r.cb, r.n - r.cb, r.ca, r.n - r.ca)
    change = round(r.sb - r.sa, 4)
    row = (r.n, round(ra, 4), round(rb, 4), round((rb - ra) / ra * 100, 2) if ra else 0.0, test, p, p < 1 - level, change, _risk(change))
    return df.sparkSession.createDataFrame([row], form)


def percentile_summary(df: DataFrame, before: str, after: str) -> DataFrame:
    """(percentile, original, modified) at 25, 50 and 75."""
    found = {c: exact_quantiles(df, [c], [0.25, 0.5, 0.75])[c] for c in (before, after)}
    rows = [(p, found[before][i], found[after][i]) for i, p in enumerate((25, 50, 75))]
    return df.sparkSession.createDataFrame(rows, "percentile int, original double, modified double")


def risk_bucket(c: Column) -> Column:
    """High from 0.8, medium from 0.4, else low."""
    return F.when(c >= 0.8, "High Risk").when(c >= 0.4, "Medium Risk").otherwise("Low Risk")


def risk_shift(df: DataFrame, before: str, after: str) -> DataFrame:
    """(bucket, original_pct, modified_pct): shares of the three risk buckets, from one aggregate."""
    names = ["High Risk", "Medium Risk", "Low Risk"]
    share = lambda c, b: F.avg((risk_bucket(F.col(c)) == b).cast("double"))
    one = df.agg(*[f for i, b in enumerate(names) for f in (share(before, b).alias(f"o{i}"), share(after, b).alias(f"m{i}"))])
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"o{i}").alias("original_pct"), F.col(f"m{i}").alias("modified_pct")) for i, b in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def class_share_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """(label, change): the modified share of a class less its original one, in points of a hundred."""
    sides = F.array(F.struct(F.col(before).cast("string").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("m")), F.struct(F.col(after).cast("string").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("m")))
    counts = df.select(F.explode(sides).alias("r")).select("r.*").groupBy("label").agg(F.sum("o").alias("o"), F.sum("m").alias("m"))
    total = df.agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).select("label", ((F.col("m") - F.col("o")) / F.col("_n") * 100).alias("change"))  # one row


def mean_difference_interval(df: DataFrame, before: str, after: str) -> DataFrame:
    """(low, high) of the mean difference at 1.96 standard errors; 0 and 0 for fewer than two rows or no change."""
    d = F.col(after) - F.col(before)
    one = df.agg(F.avg(d).alias("m"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("h"), F.count(d).alias("n"), F.max(F.abs(d)).alias("most"))
    still = (F.col("n") < 2) | (F.col("most") <= 1e-8)
    return one.select(F.when(still, 0.0).otherwise(F.col("m") - F.col("h")).alias("low"), F.when(still, 0.0).otherwise(F.col("m") + F.col("h")).alias("high"))


def change_correlation(df: DataFrame, changes: dict[str, Column], effect: Column) -> DataFrame:
    """(feature, correlation) of each feature's change with the prediction's, nulls as 0; features that do not vary are left out."""
    one = df.agg(*[F.try_divide(F.covar_pop(F.coalesce(c, F.lit(0.0)), effect), F.nullif(F.stddev_pop(F.coalesce(c, F.lit(0.0))) * F.stddev_pop(effect), F.lit(0.0))).alias(f"_{i}") for i, c in enumerate(changes.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"_{i}").alias("correlation")) for i, name in enumerate(changes)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("correlation is not null and not isnan(correlation)")
