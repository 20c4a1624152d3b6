"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import discard, materialize, shared_folder  # noqa: F401

#: Ids of a crowded bucket's most frequent class, and of the others, that all outside it are compared with first.
CENTRES = 8


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, with as many underscores added as keep it apart from the tables' columns (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_words(text: Column) -> Column:
    """Array of runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(id, class) of every id in ``edges`` (a, b), class the smallest id of its component.

    Each round leads every id to the first of its neighbours and itself, in an
    order of hashes that is new each round, and keeps the links between the ids
    led to. These shrink by a share each round, so that all rounds together read
    and write rows in proportion to the first, and their number grows with the
    logarithm of the links. Joins read written tables on both sides, so a hot
    centre is split by AQE.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, tag + "-links")
    rounds: list[DataFrame] = []
    while True:
        rank = lambda c: F.xxhash64(F.lit(len(rounds)), c)
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", rank("b")).alias("near"))
        rounds.append(materialize(first.select("id", F.when(rank("near") < rank("id"), F.col("near")).otherwise(F.col("id")).alias("to")), tag))
        left, right = (rounds[-1].select(F.col("id").alias("i" + s), F.col("to").alias("to" + s)) for s in "ab")
        step = links.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).where("toa <> tob")
        step = materialize(step.select(F.least("toa", "tob").alias("a"), F.greatest("toa", "tob").alias("b")).distinct(), tag + "-links")
        discard(links)
        links = step
        if links.limit(1).count() == 0:
            break
    found = rounds[-1].select("id", F.col("to").alias("root"))
    for led in rounds[-2::-1]:
        later = found.select(F.col("id").alias("k"), F.col("root").alias("r"))
        found = led.join(later, F.col("to") == F.col("k"), "left").select("id", F.coalesce("r", "to").alias("root"))
    found = materialize(found, tag + "-roots")
    least = found.groupBy(F.col("root").alias("k")).agg(F.min("id").alias("class"))
    out = materialize(found.join(least, F.col("root") == F.col("k")).select("id", "class"), tag)
    discard(links, found, *rounds)
    return out


def rare_item_pairs(crowd: DataFrame, items: Callable[[DataFrame], DataFrame], ratio: float, tag: str, close: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs (a, b) of ``crowd`` (id, class, size, ...) that may be within (1 - ``ratio``) edits of the longer size: all of different classes, and few others.

    ``items`` gives the distinct items (id, item) of ids, of which one edit takes
    one away at most. Two ids then have so many items in common that, in one
    order of all items, the first common one leaves room for these; the join
    asks that of every item it meets, so it loses no pair. Rare items come
    first, so a passage that a whole crowd shares comes last. ``close`` is a
    further test on the columns of two rows, by their suffixes. Where ``crowd``
    has a ``main`` class, pairs with both ids in it are left out, as they are
    linked already; so are items whose ids are all of one class.
    """
    out = F.col("class") != F.col("main") if "main" in crowd.columns else F.lit(True)
    more = [c for c in crowd.columns if c not in ("id", "class", "size", "main", "bucket", "out", "n", "lo", "hi", "centre")]
    who = crowd.groupBy("id").agg(F.min("class").alias("class"), F.max("size").alias("size"), F.max(out).alias("out"), *[F.first(c).alias(c) for c in more])
    who = materialize(who, f"{tag}-crowd")
    rows = materialize(items(who.select("id")), f"{tag}-items")
    times = rows.groupBy(F.col("item").alias("ti")).agg(F.count("*").alias("times"))
    mine = Window.partitionBy("id")
    rows2 = rows.join(times, F.col("item") == F.col("ti")).withColumn("nth", F.row_number().over(mine.orderBy("times", "item"))).withColumn("have", F.count("*").over(mine))
    slim = rows2.join(who.select(F.col("id").alias("w"), "size", "class", "out"), F.col("id") == F.col("w"))
    lost = F.floor((1 / ratio - 1) * F.col("size") + 1e-6)
    first = materialize(slim.where((F.col("nth") <= lost + 1) & (F.col("times") > 1)).select("item", "id", "class", "size", "have", "nth", "out"), f"{tag}-rare")
    mixed = first.groupBy(F.col("item").alias("mi")).agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.max("out").alias("any")).where("c0 < c1 AND any").select("mi")
    kept = first.join(mixed, F.col("item") == F.col("mi"), "left_semi").join(who.select(F.col("id").alias("w"), *more), F.col("id") == F.col("w")).drop("w")
    kept = materialize(kept, f"{tag}-mixed")
    left, right = (kept.select("item", F.col("id").alias(s), *[F.col(c).alias(c + s) for c in kept.columns if c not in ("item", "id")]) for s in "ab")
    common = F.greatest("havea", "haveb") - F.floor((1 - ratio) * F.greatest("sizea", "sizeb") + 1e-6)
    room = F.least(F.col("havea") - F.col("ntha"), F.col("haveb") - F.col("nthb")) + 1
    fits = F.least("sizea", "sizeb") >= ratio * F.greatest("sizea", "sizeb") - 1e-9
    met = left.where("outa").join(right, "item").where("(a < b OR NOT outb) AND classa <> classb").where(fits & (room >= common))
    if close is not None:
        met = met.where(close("a", "b"))
    pairs = materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-met")
    discard(who, rows, first, kept)
    return pairs


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None, tag: str, ratio: float, small: int = 16, items: Callable[[DataFrame], DataFrame] | None = None, close: Callable[[str, str], Column] | None = None, item_close: Callable[[str, str], Column] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, fits: Column | None = None) -> DataFrame:
    """Verified links (a, b) that connect all ids that share a bucket of ``members`` (bucket long, id long, size, ...) and are similar.

    Members are shuffled once; buckets of one and the same list of ids count once.
    Buckets of up to ``small`` ids are compared pair by pair. In a larger one every
    id is compared with its smallest and largest id, so work stays linear in its
    size. Buckets that are then in one class are done. Of the others the ids
    outside the most frequent class are compared with all ids of other classes,
    those in the most frequent one included, so similarity need not be
    transitive: first with ``CENTRES`` ids of that class and as many others, then those still outside
    pair by pair, each pair in the first bucket it shares alone; or where ``items`` is given by ``rare_item_pairs``
    with ``item_close``. Pairs that ``fits`` turns down, a test on the members'
    columns with suffixes a and b, can't be links and are left out; without it,
    where members have a size, so are those whose sizes differ by more than
    ``ratio`` allows. In crowded buckets so are those that ``close`` turns down, a
    test on the columns of two rows, by their suffixes, to which ``refine`` may
    add. ``prepare`` gets the ids (id) of pairs and of crowded buckets before
    pairs are verified.
    """
    if fits is None:
        fits = F.least("sizea", "sizeb") >= ratio * F.greatest("sizea", "sizeb") - 1e-9 if "size" in members.columns else F.lit(True)

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("bucket", F.col("id").alias(s), *[F.col(c).alias(c + s) for c in rows.columns if c not in ("bucket", "id", "n", "lo", "hi")])

    bucket = Window.partitionBy("bucket")
    met = members.withColumn("n", F.count("*").over(bucket)).withColumn("list", F.bit_xor(F.xxhash64("id")).over(bucket)).where("n > 1")
    more = [F.max(c).alias(c) for c in members.columns if c not in ("bucket", "id")] or [F.count("*").alias("times")]
    met = met.groupBy(F.xxhash64("list", "n").alias("bucket"), "id").agg(*more).select(members.columns)
    met = met.withColumn("n", F.count("*").over(bucket)).withColumn("lo", F.min("id").over(bucket)).withColumn("hi", F.max("id").over(bucket))
    shared = materialize(met.where("lo < hi"), f"{tag}-shared")
    few, many = shared.where(F.col("n") <= small), shared.where(F.col("n") > small)
    pairs = side(few, "a").join(side(few, "b"), "bucket").where("a < b").where(fits).select("a", "b")
    stars = many.select("id", F.explode(F.array("lo", "hi")).alias("centre")).where("id <> centre")
    pairs = materialize(pairs.unionByName(stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))).distinct(), f"{tag}-pairs")
    if prepare is not None:
        prepare(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many.select("id")).distinct())
    links = materialize(verify(pairs).select("a", "b"), f"{tag}-links")
    discard(pairs)
    if many.limit(1).count() == 0:
        discard(shared)
        return links
    classes = connected_components(links, f"{tag}-classes")
    known = classes.select(F.col("id").alias("m"), F.col("class").alias("mc"))
    rest = many.drop("n", "lo", "hi").join(known, F.col("id") == F.col("m"), "left").withColumn("class", F.coalesce("mc", "id")).drop("m", "mc")
    rest = materialize(rest, f"{tag}-rest")
    times = rest.groupBy(F.col("bucket").alias("k"), "class").agg(F.count("*").alias("times"))
    mixed = times.groupBy("k").agg(F.max_by("class", F.struct("times", "class")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    crowd = materialize(rest.join(mixed, rest.bucket == F.col("k")).drop("k", "kinds"), f"{tag}-crowd")
    discard(shared, classes, rest)
    if crowd.limit(1).count() == 0:
        discard(crowd)
        return links
    if refine is not None:
        crowd = refine(crowd)
    if items is not None:
        pairs = rare_item_pairs(crowd, items, ratio, tag, item_close)
    else:
        near = close("a", "b") if close is not None else F.lit(True)
        ordered = lambda met: met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        crowd = materialize(crowd, f"{tag}-crowd")
        nth = F.row_number().over(Window.partitionBy("bucket", "out").orderBy(F.xxhash64("id"), "id"))
        centres = crowd.withColumn("out", F.col("class") != F.col("main")).withColumn("nth", nth).where(F.col("nth") <= CENTRES).drop("nth", "out")
        met = side(crowd.where("class <> main"), "a").join(side(centres, "b"), "bucket").where("classa <> classb").where(fits).where(near)
        begun = materialize(verify(ordered(met)).select("a", "b"), f"{tag}-begun")
        links = links.unionByName(begun)
        label = [crowd.select(F.col("id").alias("l" + s), F.col("class").alias("class" + s)).distinct() for s in "ab"]
        joined = begun.join(label[0], F.col("a") == F.col("la")).join(label[1], F.col("b") == F.col("lb")).select(F.col("classa").alias("a"), F.col("classb").alias("b"))
        groups = connected_components(joined, f"{tag}-begun")
        new = lambda c: groups.select(F.col("id").alias("g"), F.col("class").alias(c))
        lists = crowd.groupBy(F.col("id").alias("l")).agg(F.array_sort(F.collect_set("bucket")).alias("list"))
        out = crowd.join(new("c1"), F.col("class") == F.col("g"), "left").drop("g").join(new("c2"), F.col("main") == F.col("g"), "left").drop("g")
        out = out.withColumn("class", F.coalesce("c1", "class")).withColumn("main", F.coalesce("c2", "main")).drop("c1", "c2")
        out = out.join(lists, F.col("id") == F.col("l")).drop("l").withColumn("out", F.col("class") != F.col("main"))
        out = materialize(out, f"{tag}-out")
        met = side(out, "a").where("outa").join(side(out, "b"), "bucket").where("(a < b OR NOT outb) AND classa <> classb").where(fits)
        met = met.where(F.get(F.array_intersect("lista", "listb"), F.lit(0)) == F.col("bucket")).where(near)
        pairs = materialize(ordered(met), f"{tag}-pairs")
    more = materialize(verify(pairs).select("a", "b"), f"{tag}-links")
    discard(pairs)
    return links.unionByName(more)
