"""Order statistics without a global sort: exactly k rows, and exact quantiles, by counts of ranges that are refined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of one counting pass, and rows that a last window may sort.
RANGES, ENOUGH = 4096, 100_000


def smallest(df: DataFrame, order: Column, ties: list[Column], k: int, name: str) -> DataFrame:
    """Adds ``name``, true for exactly ``k`` rows (or all): those smallest by ``order``, a number without nulls, then by ``ties``, which tell rows apart.

    Counts of ranges of ``order`` find the range that the k-th row is in, again
    until it holds few rows; only these are ranked in one window. Rows whose
    orders are all equal are told apart in that window, so a long tie is one
    task's sort.
    """
    rows = df.withColumn("_o", order.cast("double"))
    ends = rows.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, below, inside = ends.lo, ends.hi, 0, ends.n
    if k <= 0 or not inside:
        return df.withColumn(name, F.lit(False))
    if k >= inside:
        return df.withColumn(name, F.lit(True))
    while inside > ENOUGH and lo < hi:
        width = (hi - lo) / RANGES
        place = F.least(F.floor((F.col("_o") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(RANGES - 1))
        cut = rows.where((F.col("_o") >= F.lit(lo)) & (F.col("_o") <= F.lit(hi)))
        counts = sorted(cut.groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("_o").alias("lo"), F.max("_o").alias("hi")).collect(), key=lambda r: r.r)  # a row per range
        before = inside
        for r in counts:
            if below + r.n >= k:
                lo, hi, inside = r.lo, r.hi, r.n
                break
            below += r.n
        if inside == before:
            break
    edge = rows.withColumn("_edge", (F.col("_o") >= F.lit(lo)) & (F.col("_o") <= F.lit(hi)))
    settled = edge.where(~F.col("_edge")).withColumn(name, F.col("_o") < F.lit(lo))
    ranked = edge.where("_edge").withColumn(name, F.row_number().over(Window.partitionBy("_edge").orderBy("_o", *ties)) <= k - below)
    return settled.unionByName(ranked).drop("_o", "_edge")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) of each column's values; null for a column without any.

    Approximate quantiles bracket each rank; one pass counts what is below each
    bracket and what it holds, and only values inside brackets are sorted, each
    bracket by itself. So no task keeps a column's distinct values.
    """
    values = [F.col(c).cast("double") for c in columns]
    spread = 1 / 1000
    around = [max(0.0, s - spread) for s in shares] + [min(1.0, s + spread) for s in shares]
    marks = [f(v).alias(f"{a}{i}") for i, v in enumerate(values) for a, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("at", lambda v: F.percentile_approx(v, around, 10_000)))]
    known = df.agg(*marks).first()  # one sketch for all ranks of a column
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    wanted = []  # (column, share, rank)
    for i in range(len(columns)):
        n = known[f"n{i}"]
        wanted += [(i, s, min(int(share * (n - 1)), n - 1), share * (n - 1)) for s, share in enumerate(shares) if n]
    if not wanted:
        return out
    brackets = []
    for i, s, _, _ in wanted:
        lo, hi = known[f"at{i}"][s], known[f"at{i}"][len(shares) + s]
        brackets.append((known[f"lo{i}"] if shares[s] - spread <= 0 else lo, known[f"hi{i}"] if shares[s] + spread >= 1 else hi))
    counted = df.agg(*[F.count_if(values[w[0]] < F.lit(b[0])).alias(f"u{j}") for j, (w, b) in enumerate(zip(wanted, brackets, strict=True))], *[F.count_if((values[w[0]] >= F.lit(b[0])) & (values[w[0]] <= F.lit(b[1]))).alias(f"i{j}") for j, (w, b) in enumerate(zip(wanted, brackets, strict=True))]).first()
    tagged = F.array(*[F.when((values[w[0]] >= F.lit(b[0])) & (values[w[0]] <= F.lit(b[1])), F.struct(F.lit(j).alias("j"), values[w[0]].alias("v"))) for j, (w, b) in enumerate(zip(wanted, brackets, strict=True))])
    inside = df.select(F.explode(F.array_compact(tagged)).alias("r")).select("r.*").groupBy("j", "v").agg(F.count("*").alias("n"))
    ranked = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
    need = F.array(*[F.lit(w[2] - counted[f"u{j}"]) for j, w in enumerate(wanted)])
    first, more = F.get(need, F.col("j")), F.get(need, F.col("j")) + 1
    near = ranked.groupBy("j").agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > more, F.col("v"))).alias("b"))
    found = {r.j: (r.a, r.b) for r in near.collect()}  # a row per quantile
    for j, (i, s, rank, exact) in enumerate(wanted):
        if not 0 <= rank - counted[f"u{j}"] < counted[f"i{j}"] - (exact > rank):
            return {c: df.agg(F.percentile(c, F.array(*[F.lit(v) for v in shares]))).first()[0] or [None] * len(shares) for c in columns}  # a bracket missed its rank
        a, b = found[j]
        out[columns[i]][s] = a if exact == rank else a + (exact - rank) * (b - a)
    return out


def group_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the exact median of each group's values, null for a group without any.

    As ``exact_quantiles``, with a bracket for each group, whose rank the sketch
    can't miss. Brackets are broadcast, so groups should be few; their rows may be many.
    """
    v, n = F.col(value).cast("double"), F.col("_n")
    marks = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(v).alias("_n"), F.percentile_approx(v, [0.499, 0.501], 10_000).alias("_at"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = df.join(F.broadcast(marks), same)  # a row per group
    groups = [f"_k{i}" for i in range(len(keys))]
    counts = rows.where(v.isNull() | (v <= F.col("_at")[1])).groupBy(*groups, "_n", F.when(v >= F.col("_at")[0], v).alias("_v"), v.isNull().alias("_gap")).agg(F.count("*").alias("_c"))
    upto = F.sum(F.when(~F.col("_gap"), F.col("_c"))).over(Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first()))
    ranked = counts.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > rank), F.col("_v")))
    both = ranked.groupBy(*groups).agg(at(F.floor((n - 1) / 2)).alias("_a"), at(F.floor(n / 2)).alias("_b"))
    return both.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], (F.col("_a") + 0.5 * (F.col("_b") - F.col("_a"))).alias(name))
