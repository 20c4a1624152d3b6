"""K-means, the choice of k, cluster metrics and segment names.

Every step is one aggregate over the table: Lloyd's steps of all k together
(counts and sums per (k, cluster)), and the metrics of all k together from sizes,
means and variances, the silhouette included. What comes to the driver are
centres and statistics: a few numbers per cluster, never rows (``MOST_CLUSTERS``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import discard, materialize

#: Clusters of one labelling whose statistics may come to the driver.
MOST_CLUSTERS = 1000
#: Rows that starting centres are drawn from: those with the smallest hashes of the whole table.
START_ROWS = 2048

Centres = list[list[float]]


def _distance(columns: list[str], centre: list[float]) -> Column:
    """Squared Euclidean distance."""
    total = F.lit(0.0)
    for c, v in zip(columns, centre, strict=True):
        total = total + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
    return total


def nearest(columns: list[str], centres: Centres) -> Column:
    """Number of the nearest centre; of equally near ones the first."""
    return F.array_min(F.array(*[F.struct(_distance(columns, c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]))["j"]


def _no_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose features are all numbers."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(keep)


def start_centres(df: DataFrame, columns: list[str], ks: list[int], tries: int = 10, seed: int = 42) -> dict[int, Centres]:
    """Starting centres for each k: k-means++ on ``START_ROWS`` rows, the best of ``tries`` after a few steps there.

    The sample is the rows with the smallest hashes of all rows' features, so it
    does not depend on partitioning; fewer distinct rows than k give fewer centres.
    """
    rows = _no_gaps(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(START_ROWS).toPandas().to_numpy(dtype=float)
    points = np.unique(drawn, axis=0)
    out: dict[int, Centres] = {}
    for k in ks:
        best: tuple[float, np.ndarray] | None = None
        for attempt in range(tries):
            rng = np.random.default_rng([seed, k, attempt])
            centres = points[rng.integers(len(points))][None] if len(points) else points
            while 0 < len(centres) < min(k, len(points)):
                far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
                centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum())]])
            for _ in range(20):
                d = ((drawn[:, None] - centres[None]) ** 2).sum(2)
                own = d.argmin(1)
                moved = np.array([drawn[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
                if np.array_equal(moved, centres):
                    break
                centres = moved
            cost = ((drawn[:, None] - centres[None]) ** 2).sum(2).min(1).sum() if len(centres) else 0.0
            if best is None or cost < best[0]:
                best = (cost, centres)
        out[k] = best[1].tolist()
    return out


def lloyd(df: DataFrame, columns: list[str], starts: dict[int, Centres], steps: int = 300, tolerance: float = 1e-4) -> dict[int, Centres]:
    """Centres after Lloyd's steps for all k of ``starts`` at once, one aggregate a step.

    Rows of equal features are folded into one point with their count, which is
    written once; a step sums points next to each centre in Arrow batches.

    A k is done once its centres move by at most ``tolerance`` times the mean
    variance of the features (squared, summed over centres). A centre without
    rows stays where it is. Rows with a missing feature are left out.
    """
    rows = _no_gaps(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    spread = rows.agg(*[F.var_pop(c) for c in columns]).first()
    enough = tolerance * float(np.mean([v or 0.0 for v in spread]))
    centres, running = dict(starts), {k for k, c in starts.items() if c}
    if not running or not steps:
        return centres
    names = [f"_x{i}" for i in range(len(columns))]
    points = materialize(rows.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.count("*").alias("_n")), "kmeans-points")
    for _ in range(steps):
        if not running:
            break
        parts = points.mapInArrow(_cluster_sums(names, {k: centres[k] for k in sorted(running)}), "k int, j int, n long, " + ", ".join(f"{c} double" for c in names))
        moved = {k: [list(c) for c in centres[k]] for k in running}
        for r in parts.groupBy("k", "j").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # k rows for each k
            moved[r.k][r.j] = [r[c] / r.n for c in names]
        for k in sorted(running):
            shift = sum((a - b) ** 2 for old, new in zip(centres[k], moved[k], strict=True) for a, b in zip(old, new, strict=True))
            centres[k] = moved[k]
            if shift <= enough:
                running.discard(k)
    discard(points)
    return centres


def _cluster_sums(names: list[str], centres: dict[int, Centres]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the counts and sums (k, j, n, ...) of the points next to each centre; of equally near ones the first."""
    at = {k: np.array(c, float) for k, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {k: np.zeros(len(c), np.int64) for k, c in at.items()}
        total = {k: np.zeros(c.shape) for k, c in at.items()}
        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            n = batch.column("_n").to_numpy(zero_copy_only=False)
            for k, c in at.items():
                least, own = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
                for j in range(len(c)):
                    d = np.zeros(len(n))
                    for i, v in enumerate(x):
                        d += (v - c[j, i]) ** 2
                    nearer = d < least
                    least[nearer], own[nearer] = d[nearer], j
                count[k] += np.bincount(own, n, len(c)).astype(np.int64)
                for i, v in enumerate(x):
                    total[k][:, i] += np.bincount(own, n * v, len(c))
        kj = [(k, j) for k in at for j in np.flatnonzero(count[k]).tolist()]
        arrays = [pa.array([k for k, _ in kj], pa.int32()), pa.array([j for _, j in kj], pa.int32()), pa.array([count[k][j] for k, j in kj], pa.int64())]
        arrays += [pa.array([total[k][j, i] for k, j in kj], pa.float64()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(arrays, names=["k", "j", "n", *names])

    return run


def metrics_of(df: DataFrame, columns: list[str], labels: dict[int, Column]) -> DataFrame:
    """(k, clusters, rows, inertia, silhouette, calinski_harabasz, davies_bouldin) of several labellings, by two aggregates in all.

    The silhouette is the squared-Euclidean one: a row's mean squared distance
    to a cluster is its squared distance to the mean plus the cluster's mean
    squared spread, so it needs no pairs. A cluster of one row has silhouette
    0. With one cluster all three are null. Rows with a missing feature or
    label are left out.
    """
    spark = df.sparkSession
    rows = _no_gaps(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns], *[v.cast("string").alias(f"_l{k}") for k, v in labels.items()])
    form = "k int, clusters long, rows long, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_l{k}").alias("label")) for k in labels])
    stats = rows.withColumn("_at", F.explode(each)).where("_at.label is not null").groupBy("_at").agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns])
    found = stats.limit(MOST_CLUSTERS * len(labels) + 1).collect()
    known: dict[int, list] = {k: sorted((r for r in found if r._at.k == k), key=lambda r: r._at.label) for k in labels}
    if any(len(rs) > MOST_CLUSTERS for rs in known.values()) or len(found) > MOST_CLUSTERS * len(labels):
        raise ValueError(f"a labelling has more than {MOST_CLUSTERS} clusters")
    size = {k: [r._n for r in rs] for k, rs in known.items()}
    mean = {k: [[r[f"m_{c}"] for c in columns] for r in rs] for k, rs in known.items()}
    within = {k: [sum(r[f"v_{c}"] for c in columns) for r in rs] for k, rs in known.items()}  # mean squared spread

    many = [k for k in labels if len(known[k]) > 1]
    second: dict[int, dict] = {k: {} for k in labels}
    if many:
        shapes = {k: ([r._at.label for r in known[k]], np.array(size[k], float), np.array(mean[k], float), np.array(within[k], float)) for k in many}
        parts = rows.mapInArrow(_spread_sums(columns, shapes), "k int, j int, n long, d double, s double")
        for r in parts.groupBy("k", "j").agg((F.sum("d") / F.sum("n")).alias("d"), F.sum("s").alias("s")).collect():
            second[r.k][r.j] = (r.d, r.s)
    out = []
    for k in labels:
        n, m = np.array(size[k], float), np.array(mean[k])
        total, inertia = n.sum(), float((n * np.array(within[k])).sum())
        if len(n) < 2:
            out.append((k, len(n), int(total), inertia, None, None, None))
            continue
        centre = (n[:, None] * m).sum(0) / total
        between = float((n * ((m - centre) ** 2).sum(1)).sum())
        scatter = np.array([second[k][j][0] for j in range(len(n))])
        apart = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(apart > 0, (scatter[:, None] + scatter[None]) / apart, 0.0)
            ch = float(between * (total - len(n)) / (inertia * (len(n) - 1))) if inertia > 0 and total > len(n) else None
        out.append((k, len(n), int(total), inertia, float(sum(v[1] for v in second[k].values()) / total), ch, float(ratio.max(1).mean())))
    return spark.createDataFrame(out, form)


def _spread_sums(columns: list[str], shapes: dict[int, tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task (k, j, n, d, s): rows of each cluster, and their summed distances to its mean and silhouettes; ``shapes`` has labels, sizes, means and mean squared spreads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((3, len(shape[0]))) for k, shape in shapes.items()}
        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for k, (names, size, mean, within) in shapes.items():
                found = pa.compute.index_in(batch.column(f"_l{k}"), value_set=pa.array(names, pa.string()))
                known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                own = found.drop_null().to_numpy(zero_copy_only=False)
                mine = np.arange(len(own))
                far = np.zeros((len(own), len(names)))
                for i, v in enumerate(x):
                    far += (v[known, None] - mean[None, :, i]) ** 2
                apart = np.sqrt(np.maximum(far[mine, own], 0.0))
                far += within
                a = far[mine, own] * np.where(size > 1, size / np.maximum(size - 1, 1), 0.0)[own]
                far[mine, own] = np.inf
                b = far.min(1)
                most = np.maximum(a, b)
                score = np.where((size[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
                for place, weight in enumerate((None, apart, score)):
                    sums[k][place] += np.bincount(own, weight, len(names))
        kj = [(k, j) for k in sums for j in np.flatnonzero(sums[k][0]).tolist()]
        arrays = [pa.array([k for k, _ in kj], pa.int32()), pa.array([j for _, j in kj], pa.int32()), pa.array([int(sums[k][0, j]) for k, j in kj], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array([sums[k][place, j] for k, j in kj], pa.float64()) for place in (1, 2)], names=["k", "j", "n", "d", "s"])

    return run


def cluster_metrics(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``metrics_of`` one labelling that is a column, without k."""
    return metrics_of(df, columns, {0: F.col(label)}).drop("k")


def k_curve(df: DataFrame, columns: list[str], most: int = 10, seed: int = 42) -> tuple[DataFrame, dict[int, Centres]]:
    """(metrics for k = 2 .. ``most``, the centres of each k); at most as many clusters as rows less one."""
    rows = _no_gaps(df, columns).limit(most + 1).count()
    ks = list(range(2, min(most, rows - 1) + 1))
    if not ks:
        return df.sparkSession.createDataFrame([], "k int, clusters long, rows long, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"), {}
    centres = lloyd(df, columns, start_centres(df, columns, ks, seed=seed))
    return metrics_of(df, columns, {k: nearest(columns, centres[k]) for k in ks}), centres


def best_k(curve: DataFrame) -> int:
    """The k with the largest silhouette, the smaller on a tie; 3 where there are fewer than two to choose from, 2 for an empty curve."""
    rows = sorted(curve.where("silhouette is not null").collect(), key=lambda r: (-r.silhouette, r.k))  # one row for each k
    return rows[0].k if len(rows) > 1 else 3 if rows else 2


def kmeans(df: DataFrame, columns: list[str], centres: Centres, name: str = "cluster") -> DataFrame:
    """Adds the number of the nearest centre; null for rows with a missing feature."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.withColumn(name, F.when(whole, nearest(columns, centres)))


def segment_names(df: DataFrame, cluster: str, columns: list[str], most: int = 2) -> DataFrame:
    """Adds ``segment_name``: for the first ``most`` features High or Low, as the cluster's mean is above the table's median or not.

    Rows without a cluster have no name. Means and medians are joined back, a row
    per cluster.
    """
    columns = columns[:most]
    middle = df.agg(*[F.percentile(c, 0.5).alias(f"_m{i}") for i, c in enumerate(columns)])
    means = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("_c")).agg(*[F.avg(c).alias(f"_a{i}") for i, c in enumerate(columns)])
    words = [F.concat(F.when(F.col(f"_a{i}") > F.col(f"_m{i}"), "High ").otherwise("Low "), F.lit(c.replace("_", " "))) for i, c in enumerate(columns)]
    named = means.crossJoin(F.broadcast(middle)).select("_c", F.concat_ws(" & ", *words).alias("segment_name"))  # one row
    return df.join(named, F.col(cluster) == F.col("_c"), "left").drop("_c")


def principal_components(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """Adds pc1, pc2, ...: centred rows projected on the leading eigenvectors of the features' covariance.

    The covariance comes from one aggregate; each component's largest entry (the
    first on a tie) is positive. Missing features count as the mean.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    centre = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    at = [F.coalesce(F.col(c).cast("double") - F.lit(float(centre[i] or 0.0)), F.lit(0.0)) for i, c in enumerate(columns)]
    cells = df.agg(*[F.avg(at[i] * at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = cells[f"c{i}_{j}"] or 0.0
    _, vectors = np.linalg.eigh(cov)
    out = {}
    for p in range(components):
        v = vectors[:, -1 - p]
        v = v * np.sign(v[np.argmax(np.round(np.abs(v), 12))] or 1.0)
        total = F.lit(0.0)
        for a, w in zip(at, v, strict=True):
            total = total + a * F.lit(float(w))
        out[f"pc{p + 1}"] = total
    return df.withColumns(out)
