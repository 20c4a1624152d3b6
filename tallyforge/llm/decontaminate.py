"""Benchmark decontamination: scan word windows against a set of benchmark n-grams.

Words are runs of ASCII letters, digits and characters from U+0080 up, after
A-Z is lower-cased. A window is ``width`` consecutive words of an item; an item
with fewer words, but not none, is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize

WIDTH = 10
#: The benchmark's windows are broadcast up to this many; beyond, Spark joins by a shuffle.
BROADCAST_WINDOWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def joined(left: str, right: str, ahead: int) -> Column:
    """Hashes of ``left`` at i with ``right`` at i + ahead, null past the end."""
    return F.transform(left, lambda x, i: F.xxhash64(x, F.get(right, i + ahead)))


def with_grams(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Adds array ``grams``: a hash of every run of ``n`` words, by doubling; a step per column, so no array is computed twice."""
    df, have = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("g1")), 1
    while have * 2 <= n:
        df, have = df.select("*", joined(f"g{have}", f"g{have}", have).alias(f"g{have * 2}")), have * 2
    grams, done, p = f"g{have}", have, have
    while done < n:
        if done + p <= n:
            df = df.select("*", joined(grams, f"g{p}", done).alias(f"t{done}"))
            grams, done = f"t{done}", done + p
        p //= 2
    return df.select(*keep, F.slice(grams, F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0))).alias("grams"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows (k words, window text, its items) of the benchmark (item_id, text)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    k = F.least(F.size("words"), F.lit(width))
    cut = items.select("item_id", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))).alias("window"))
    return cut.groupBy("k", "window").agg(F.collect_set("item_id").alias("item_ids"))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, k, item_ids): verified occurrences of benchmark windows in the documents.

    Document windows stream past a broadcast hash set of benchmark n-grams; a
    hit is verified word by word. The set's size is counted first, and a larger
    benchmark is joined by a shuffle.
    """
    windows = materialize(benchmark_windows(benchmark, width), "benchmark-windows")
    lengths = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most ``width`` rows
    small = sum(lengths.values()) <= BROADCAST_WINDOWS
    base = docs.select("doc_id", words(F.col("text")).alias("words"))
    found = None
    for k in sorted(lengths) or [width]:
        side = windows.where(F.col("k") == k).select("window", "item_ids", F.split("window", " ").alias("words"))
        side = materialize(with_grams(side, k, ["window", "item_ids", "words"]).select("window", "item_ids", F.col("grams")[0].alias("gram")), "benchmark-grams")
        # outer: else a filter on the array is derived, and computed twice
        scan = with_grams(base, k, ["doc_id", "words"]).select("doc_id", "words", F.posexplode_outer("grams").alias("pos", "gram"))
        hit = scan.join(F.broadcast(side) if small else side, "gram")
        text = F.array_join(F.slice("words", F.col("pos") + 1, F.lit(k)), " ")
        hit = hit.where(F.nullif(text, F.col("window")).isNull())  # not "=", which would make the text a join key
        hit = hit.select("doc_id", "pos", F.lit(k).alias("k"), "item_ids")
        found = hit if found is None else found.unionByName(hit)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_hit, spans, item_ids) of contaminated documents.

    ``spans`` are (pos, k) of verified windows in order, n_hit the words inside
    any of them, ``item_ids`` the items with a window, sorted as strings.
    """
    per = find_hits(docs, benchmark, width).groupBy("doc_id").agg(F.collect_set(F.struct("pos", "k")).alias("spans"), F.collect_set("item_ids").alias("ids"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(a: Column, s: Column) -> Column:
        end = s["pos"] + s["k"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n"))

    per = per.select("doc_id", F.array_sort("spans").alias("spans"), F.array_sort(F.transform(F.array_distinct(F.flatten("ids")), lambda i: i.cast("string"))).alias("item_ids"))
    return per.select("doc_id", F.aggregate("spans", start, cover)["n"].alias("n_hit"), "spans", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, or without the words of contaminated spans.

    ``remove``: "documents" or "spans" (each hit word goes with the separators
    after it). Documents with null or empty text have no words and are kept;
    rows that share a doc_id, null included, share its verdict. Columns of
    ``docs`` pass through; a benchmark without words changes nothing.
    """
    marked = contamination(docs.select("doc_id", "text"), benchmark, width)
    i, sp = free_name("_id", docs), free_name("_spans", docs)
    if remove == "documents":
        ids = marked.select(F.col("doc_id").alias(i))
        return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(i)), "left_anti")
    spans = marked.select(F.col("doc_id").alias(i), F.col("spans").alias(sp))
    gap = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"  # separators of a text whose A-Z is as it was
    part = F.regexp_extract_all("text", F.lit(f"^[{gap}]+|[^{gap}]+[{gap}]*"), F.lit(0))
    lead = F.when(F.col("text").rlike(f"^[{gap}]"), 1).otherwise(0)
    hit = F.array_distinct(F.flatten(F.transform(sp, lambda s: F.sequence(s["pos"], s["pos"] + s["k"] - 1))))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(i)), "left")
    kept = F.filter(part, lambda p, k: ~F.array_contains(hit, k - lead))
    return joined.withColumn("text", F.when(F.col(sp).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, digest of its items, verdict."""
    marked = contamination(docs, benchmark, width)
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    marked = marked.withColumnRenamed("doc_id", "_id")
    return counted.join(marked, counted.doc_id.eqNullSafe(marked._id), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
