"""Customer aggregates, KPI targets, flags, A/B tests, segments and billing."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.clean import whole_days


def customer_aggregate(df: DataFrame, customer: str, amount: str, date: str) -> DataFrame:
    """total_spent, first and last activity, visits, days_active (at least 1); money to the cent, so that the order of summing does not show; combined before the shuffle."""
    agg = df.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("customer_id"))
    agg = agg.agg(F.round(F.sum(amount), 2).alias("total_spent"), F.min(date).alias("first_activity"), F.max(date).alias("last_activity"), F.count("*").alias("visits"))
    return agg.withColumn("days_active", F.greatest(whole_days(F.col("last_activity"), F.col("first_activity")), F.lit(1)))


OPERATIONS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: F.try_mod, ast.Pow: F.pow}


def formula(text: str, columns: list[str]) -> Column:
    """Arithmetic over named columns and numbers; anything else raises, as users write these."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATIONS:
            return OPERATIONS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Name) and node.id in columns:
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    try:
        return build(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text}") from e


def kpi(name: str, as_of: str, vip_threshold: float = 500.0, columns: list[str] | None = None) -> Column:
    """The KPI target ``name`` over a customer aggregate; with ``columns`` any other text is a formula over these.

    Per-visit figures are null for a customer without visits. ``margin`` and
    ``referrals`` are columns that the caller has joined.
    """
    idle = whole_days(F.lit(as_of).cast("timestamp"), F.col("last_activity"))
    per_visit = F.try_divide(F.col("total_spent"), F.col("visits"))
    frequency = F.try_divide(F.col("visits"), F.col("days_active"))
    known = {
        "clv": per_visit * frequency * (F.col("days_active") / 30), "revenue_per_customer": per_visit, "churn": (idle > 60).cast("int"), "aov": per_visit, "revenue_per_visit": per_visit,
        "purchase_frequency": frequency, "customer_lifetime": whole_days(F.col("last_activity"), F.col("first_activity")), "repeat_purchase_rate": (F.col("visits") > 1).cast("int"), "recency": idle,
        "loyalty_score": frequency * 0.6 + F.lit(0.4) / F.greatest(idle, F.lit(1)), "engagement_score": frequency, "profit_per_customer": F.col("total_spent") * F.col("margin"),
        "inactivity_risk_score": (idle > 90).cast("int"), "vip_flag": (F.col("total_spent") > vip_threshold).cast("int"), "referral_score": F.col("referrals") / (F.col("visits") + 1),
    }
    if name in known:
        return known[name]
    if columns is None:
        raise ValueError(f"unknown KPI: {name}")
    return formula(name, columns)


def customer_flags(agg: DataFrame, as_of: str, vip_threshold: float = 500.0, at_risk_days: int = 90) -> DataFrame:
    """clv, recency, VIP, at-risk, and an upsell score from min-max clv (0.7) and inverse recency (0.3), 0 where either is constant."""
    base = agg.withColumn("clv", kpi("clv", as_of)).withColumn("recency", kpi("recency", as_of))
    ends = base.agg(F.min("clv").alias("c0"), F.max("clv").alias("c1"), F.min("recency").alias("r0"), F.max("recency").alias("r1"))
    base = base.crossJoin(F.broadcast(ends))  # one row
    ratio = lambda v, lo, hi: F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo))
    score = 0.7 * ratio("clv", "c0", "c1") + 0.3 * (1 - ratio("recency", "r0", "r1"))
    return base.select("customer_id", "total_spent", "clv", "recency", (F.col("total_spent") > vip_threshold).cast("int").alias("is_vip"), (F.col("recency") > at_risk_days).cast("int").alias("is_at_risk"), F.coalesce(score, F.lit(0.0)).alias("upsell_score"))


def customer_summary(flags: DataFrame, upsell_threshold: float = 0.7) -> DataFrame:
    """One row of counts and averages over ``customer_flags``."""
    return flags.agg(
        F.count("*").alias("total_customers"), F.count_if(F.col("is_vip") == 1).alias("vip_count"), F.count_if(F.col("is_at_risk") == 1).alias("at_risk_customers"),
        F.count_if(F.col("upsell_score") > upsell_threshold).alias("high_upsell_score"), F.round(F.avg("clv"), 2).alias("average_clv"), F.round(F.avg("recency"), 2).alias("average_recency"),
    )


def mean_margin(visits: DataFrame, customer: str, margin: Column) -> DataFrame:
    """(customer_id, margin): the mean margin of each customer's rows."""
    return visits.where(F.col(customer).isNotNull()).groupBy(F.col(customer).cast("string").alias("customer_id")).agg(F.round(F.avg(margin), 6).alias("margin"))


def referral_counts(agg: DataFrame, visits: DataFrame, code: str) -> DataFrame:
    """``agg`` with ``referrals``, how often a customer's id stands as a referral code (0 where it does not)."""
    counts = visits.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_code")).agg(F.count("*").alias("_n"))
    return agg.join(counts, agg.customer_id == counts._code, "left").withColumn("referrals", F.coalesce("_n", F.lit(0))).drop("_code", "_n")


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square > x), by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def ab_table(df: DataFrame, variant: str, converted: Column) -> DataFrame:
    """Per variant total_users, conversions and conversion_rate; rows with a null variant or result go first."""
    rows = df.where(F.col(variant).isNotNull() & converted.isNotNull())
    t = rows.groupBy(F.col(variant).alias("variant")).agg(F.count("*").alias("total_users"), F.sum(converted.cast("long")).alias("conversions"))
    return t.withColumn("conversion_rate", F.col("conversions") / F.col("total_users"))


def ab_chi_square(table: DataFrame) -> DataFrame:
    """chi2 of the variants' table, Yates-corrected when it is 2 x 2, with its degrees of freedom; 0 and 0 where all or none convert."""
    all_ = table.agg(F.sum("total_users").alias("n"), F.sum("conversions").alias("c"), F.count("*").alias("k"))
    t = table.crossJoin(F.broadcast(all_))  # one row
    expected_yes, expected_no = F.col("total_users") * F.col("c") / F.col("n"), F.col("total_users") * (F.col("n") - F.col("c")) / F.col("n")
    gap = F.abs(F.col("conversions") - expected_yes)
    gap = F.when(F.col("k") == 2, F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    mixed = (F.max("c") > 0) & (F.max("c") < F.max("n"))
    return t.agg(F.coalesce(F.sum(F.try_divide(gap * gap, expected_yes) + F.try_divide(gap * gap, expected_no)), F.lit(0.0)).alias("chi2"), F.when(mixed, F.max("k") - 1).otherwise(F.lit(0)).cast("long").alias("df"))


def ab_test(table: DataFrame) -> DataFrame:
    """(winner, lift, chi2, df, p_value) in one row: lift is the best rate less the lowest, the first variant wins a tie.

    The table has a row per variant; its one row of sums comes to the driver, where the tail is computed.
    """
    ends = table.agg(F.max_by("variant", F.struct("conversion_rate")).alias("any"), F.max("conversion_rate").alias("best"), F.min("conversion_rate").alias("low"))
    winner = table.join(F.broadcast(ends), F.col("conversion_rate") == F.col("best")).agg(F.min("variant").alias("winner"), F.first(F.col("best") - F.col("low")).alias("lift"))
    row = ab_chi_square(table).first()
    p = chi_square_tail(row["chi2"], row["df"]) if row and row["df"] else 1.0
    return winner.select("winner", "lift", F.lit(float(row["chi2"])).alias("chi2"), F.lit(row["df"]).cast("long").alias("df"), F.lit(float(p)).alias("p_value"))


def prediction_stats(df: DataFrame, prediction: str, confidence: str | None = None) -> DataFrame:
    """count, mean, population std, min, max, median of predictions; of confidences mean, min, max, and how many are below 0.7 and above 0.9."""
    v = F.col(prediction).cast("double")
    made = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("median")]
    if confidence:
        c = F.col(confidence)
        made += [F.avg(c).alias("confidence_mean"), F.min(c).alias("confidence_min"), F.max(c).alias("confidence_max"), F.count_if(c < 0.7).alias("low_confidence"), F.count_if(c > 0.9).alias("high_confidence")]
    return df.agg(*made)


def segment_differences(df: DataFrame, segment: str, features: list[str], top: int = 3) -> DataFrame:
    """(segment, feature, difference, rank): the ``top`` features of each segment by distance of its mean from the table's."""
    means = df.agg(*[F.avg(c).alias(f"_all_{c}") for c in features])
    per = df.groupBy(F.col(segment).alias("segment")).agg(*[F.avg(c).alias(c) for c in features]).crossJoin(F.broadcast(means))  # one row
    long = per.select("segment", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col(f"_all_{c}")).alias("difference")) for c in features])).alias("r")).select("segment", "r.*")
    w = Window.partitionBy("segment").orderBy(F.desc(F.abs("difference")), "feature")  # a row per feature
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def usage_billing(log: DataFrame, user: str, order: list[str], megabytes: Column, minutes: Column) -> DataFrame:
    """Cost of each request and each user's running total."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("cost", 74.1 * F.log1p(megabytes) + 0.5 * minutes).withColumn("running", F.sum("cost").over(w))


def unit_economics(customers: DataFrame | None, orders: DataFrame | None, margin_pct: float = 0.40, return_pct: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """(one row of reach, unit economics and expected value; gaps (calculation, table, missing)) of canonical tables.

    emailable_pct and sms_opt_in_pct are shares of customers with an email or a
    phone, aov the mean amount, profit_per_tp what is left of it after returns
    at the margin; volume is half of those the better channel reaches, rounded
    down, and expected_net a tenth of their profit. What can't be computed is 0
    and a gap; calc_coverage_pct is the share of the seven that could. Two
    aggregates.
    """
    spark = (customers if customers is not None else orders).sparkSession
    c = o = None
    if customers is not None:
        share = lambda n: F.avg(F.col(n).isNotNull().cast("double")).alias(n) if n in customers.columns else F.lit(None).cast("double").alias(n)
        c = customers.agg(F.count(F.lit(1)).alias("n"), share("email"), share("phone")).first()
    if orders is not None and "amount" in orders.columns:
        o = orders.agg(F.avg("amount").alias("aov")).first()
    gaps: list[tuple[str, str, str]] = []

    def known(value: float | None, calculation: str, table: str, missing: str) -> float:
        if value is None:
            gaps.append((calculation, table, missing))
        return value or 0.0

    total = int(known(c.n if c is not None else None, "eligible_population.total", "customers", "*"))
    email = known(c.email if total else None, "eligible_population.emailable_pct", "customers", "email" if total or customers is None or "email" not in customers.columns else "customer_id")
    phone = known(c.phone if total else None, "eligible_population.sms_opt_in_pct", "customers", "phone" if total or customers is None or "phone" not in customers.columns else "customer_id")
    aov = known(o.aov if o is not None else None, "unit_economics.aov", "orders", "amount")
    profit = known(aov * margin_pct * (1 - return_pct) if aov > 0 else None, "unit_economics.profit_per_tp", "orders", "amount")
    reach = max(email, phone)
    volume = int(known(int(total * reach * 0.5) if total and reach > 0 else None, "threshold_volume.volume", "customers", "email|phone"))
    net = known(round(volume * profit * 0.1, 2) if profit > 0 and volume > 0 else None, "threshold_volume.expected_net", "orders|customers", "|".join([*["aov"] * (profit <= 0), *["contactable_customers"] * (volume <= 0)]))
    row = (total, email, phone, aov, margin_pct, return_pct, profit, volume, net, (7 - len(gaps)) / 7)
    form = "eligible_total long, emailable_pct double, sms_opt_in_pct double, aov double, margin_pct double, return_pct double, profit_per_tp double, volume long, expected_net double, calc_coverage_pct double"
    return spark.createDataFrame([row], form), spark.createDataFrame(gaps, "calculation string, table string, missing string")
