"""Mixing sources to target weights: packed blocks, drawn by index.

Each source's words form one stream that is packed into fixed-length blocks.
Output slots are dealt to shards; the source counts of a shard are a
multinomial draw that is conditioned on the totals (a pseudorandom permutation
of the multiset of source labels, cut into shards), so the totals meet the
targets to half a block. A slot's rank within its source goes through a
pseudorandom permutation of that source's block numbers, one permutation for
each pass over the source, and blocks are joined by (source, block number).
All draws are functions of the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_words, materialize

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 42
#: Documents of a source are numbered in groups of about this many.
GROUP_DOCS = 20_000
#: Slots that one row of the draw stands for before it is spread.
CHUNK = 10_000


def permuted(x: Column, n: Column, *seed: Column | str) -> Column:
    """A pseudorandom permutation of 0..n-1 at x: four Feistel rounds on a rectangle, walked until inside."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high = F.floor((n + wide - 1) / wide).cast("long")

    def rounds(v: Column) -> Column:
        left, right = v % wide, F.floor(v / wide).cast("long")
        for r in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(2 * r), *seed), wide), wide)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(2 * r + 1), *seed), high), high)
        return right * wide + left

    wide, high = F.greatest(wide, F.lit(1)), F.greatest(high, F.lit(1))  # of nothing there is nothing to permute
    first = F.transform(F.array(x), rounds)[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), first, lambda v, _: F.when(v < n, v).otherwise(rounds(v)))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights repeat over the sources by code point, null last.

    Targets share ``share`` times all words by weight; a target stops at
    ``most`` times its source, the excess is reshared by weight until none is
    above. In order of size over weight, the sources that stop come first, so
    one running sum finds the level. There is one row per source here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), k)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("rest", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("rest") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("i", F.row_number().over(up))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("i", "level"))).over(every)
    w = w.withColumn("top", first["level"])
    return w.select("source", "source_size", F.when(F.col("top").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("top") * F.col("weight"))).cast("double").alias("target"))


def sized_rows(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """(doc_id, source, size in words, h a row hash) and more columns per document."""
    size = F.size(ascii_words(F.col("text"))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), *more)


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame, DataFrame]:
    """(rows, place, targets, slots) of a mix.

    ``rows``: those of ``sized_rows``, written; ``place`` adds each one's start
    in its source's stream and lets other columns pass; ``targets``: source,
    source_size, target; ``slots``: shard, slot, source, block, pass.
    """
    rows = materialize(sized_rows(docs, seed), "mix-rows")
    groups = max(1, rows.count() // GROUP_DOCS)
    sums = rows.groupBy("source", F.pmod("h", F.lit(groups)).alias("g")).agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select(F.col("source").alias("s"), F.col("g").alias("sg"), "n", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("base")), "mix-groups")

    def place(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("source", "g").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("g", F.pmod("h", F.lit(groups))).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        placed = placed.join(F.broadcast(sums), placed.source.eqNullSafe(sums.s) & (placed.g == sums.sg))  # a row per group
        return placed.withColumn("start", F.col("base") + F.col("within")).drop("g", "within", "s", "sg", "n", "base")

    targets = materialize(source_targets(sums.groupBy(F.col("s").alias("source")).agg(F.sum("n").alias("source_size")), weights, share, most), "mix-targets")
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    quota = targets.where("source_size > 0").select("source", blocks.alias("blocks"), F.least(F.round(F.col("target") / F.col("source_size") * blocks).cast("long"), F.floor(blocks * F.lit(float(most))).cast("long")).alias("quota"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    quota = quota.withColumn("to", F.sum("quota").over(order)).withColumn("from", F.col("to") - F.col("quota")).where("quota > 0")
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    # every label's position, in chunks, gets its slot by one permutation of all slots
    chunks = quota.withColumn("lo", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(CHUNK)))).repartition(max(1, min(total // CHUNK + 1, 10_000)), "lo")
    slots = chunks.withColumn("at", F.explode(F.sequence("lo", F.least(F.col("lo") + (CHUNK - 1), F.col("to") - 1))))
    slots = slots.withColumn("slot", permuted(F.col("at"), F.lit(total).cast("long"), F.lit(seed)))
    rank = F.col("at") - F.col("from")
    turn = F.floor(rank / F.col("blocks")).cast("long")
    slots = slots.select(F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), "slot", "source", "blocks", (rank % F.col("blocks")).alias("r"), turn.alias("pass"))
    slots = slots.withColumn("block", permuted(F.col("r"), F.col("blocks"), F.lit(seed + 1), F.col("source"), F.col("pass")))
    return rows, place, targets, slots.select("shard", "slot", "source", "block", "pass")


def doc_blocks(placed: DataFrame, block_words: int) -> DataFrame:
    """Adds (block, lo, hi): the words lo..hi of a document that lie in a block; a row per touched block."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = F.col("block") * block_words
    return spread.withColumn("lo", F.greatest(at - F.col("start"), F.lit(0))).withColumn("hi", F.least(at + block_words - F.col("start"), F.col("size")))


def block_texts(block_words: int) -> Column:
    """Array of (block, text): what of ``words``, from ``start``, lies in each block it touches."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)

    def cut(b: Column) -> Column:
        lo = F.greatest(b * block_words - F.col("start"), F.lit(0))
        hi = F.least((b + 1) * block_words - F.col("start"), F.col("size"))
        return F.struct(b.alias("block"), F.array_join(F.slice("words", (lo + 1).cast("int"), (hi - lo).cast("int")), " ").alias("text"))

    return F.transform(F.sequence(first.cast("long"), last.cast("long")), cut)


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix: (shard, slot, source, block, pass, doc_ids, text), a row per drawn block.

    ``text`` has the block's words joined by blanks, ``doc_ids`` the documents
    they come from, in order. Null text has no words; null sources are one
    source; documents without words are in no block; rows that repeat a doc_id
    count each for themselves; an empty table gives no rows.
    """
    _, place, _, slots = mix_plan(docs, block_words, weights, share, most, seed)
    # the texts are placed where they are sorted, as a join with their places would move them again
    placed = place(sized_rows(docs, seed, "text")).where("size > 0").withColumn("words", ascii_words(F.col("text")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, so that grouping and join deal rows alike
    cut = placed.select(key.alias("k"), "doc_id", "start", F.explode(block_texts(block_words)).alias("at")).select("k", "at.block", F.struct("start", "doc_id", "at.text").alias("part"))
    whole = cut.groupBy("k", "block").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(F.col("k").alias("_k"), F.col("block").alias("_b"), "parts")
    slots = slots.withColumn("k", key)
    # merge: Spark takes the slots for small, as they are spread from a row per source
    drawn = slots.hint("merge").join(whole, (slots.k == whole._k) & (slots.block == whole._b))
    return drawn.select("shard", "slot", "source", "block", "pass", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every document, from the mix's plan.

    ``taken`` counts the words of the document's parts over all drawn blocks.
    """
    rows, place, targets, slots = mix_plan(docs, block_words, weights, share, most, seed)
    placed = place(rows)
    times = slots.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("times"))
    parts = doc_blocks(placed, block_words)
    # merge: Spark takes the counts for small, as they are spread from a row per source
    parts = parts.join(times.hint("merge"), parts.source.eqNullSafe(times._s) & (parts.block == times._b))
    taken = parts.groupBy("doc_id", "source", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("start").alias("_at"), "taken")
    t = targets.select(F.col("source").alias("_ts"), "source_size", "target")
    out = placed.join(taken.hint("merge"), placed.doc_id.eqNullSafe(taken._id) & placed.source.eqNullSafe(taken._s) & (placed.start == taken._at) & (placed["size"] > 0), "left")
    out = out.join(F.broadcast(t), placed.source.eqNullSafe(t._ts))  # a row per source
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source")
