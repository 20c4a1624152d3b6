"""Near-duplicate documents by Order MinHash.

For each of ``SKETCHES`` hash orders, the ``PICKS`` smallest occurrence-labelled
shingles of five words are kept in text order; documents that agree on a sketch
meet in a bucket. A bit map of each text's words, sparse enough that unlike texts
seldom pass by chance, turns down those that differ in too many; what is left
falls into small classes of candidates. Inside a class,
texts are verified by a banded alignment of their words: similar if the word
edit distance is at most a fifth of the longer text. A text that joined a group
is not aligned with that group again. Equal word sequences are folded before,
so groups of copies cost one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import BUCKET_SETS, Bucket, folded, in_blocks, id_pairs, runs_of
from .shared import connected_components, discard, free_name, materialize

SHINGLE, PICKS, SKETCHES = 5, 2, 96
SIMILARITY = 0.8
#: Bits of a text's map for each word, and of any map at least.
WORD_BITS, LEAST_BITS = 8, 2048
#: Words of one class that a task aligns with each other; more are cut into blocks, each compared with each.
CLASS_WORDS = 1_000_000
SEEDS = np.random.default_rng(1729).integers(1, 2**63, SKETCHES, dtype=np.uint64)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: Column) -> Column:
    """Hashes of a text's lower-cased runs of letters and digits; null text has none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(runs, lambda w: w != ""), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - np.repeat(fresh, np.diff(np.r_[fresh, n]))).astype(np.uint64)
    return nth


def order_sketches(words: np.ndarray) -> np.ndarray:
    """One hash per hash order; a text of fewer words than a shingle is one shingle."""
    w = words.view(np.uint64)
    n = max(len(w) - SHINGLE + 1, 1)
    grams = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        grams = mix(grams * M1 + w[j : j + n])
    nth = occurrence(grams)
    labelled = mix(grams + nth * M1)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // n)
    picks = min(PICKS, n)
    for lo in range(0, SKETCHES, step):
        h = (labelled[None, :] ^ SEEDS[lo : lo + step, None]) * M2
        h ^= h >> np.uint64(32)
        h *= M3
        rows, at = np.arange(len(h)), np.empty((len(h), picks), np.int64)
        for p in range(picks):
            at[:, p] = h.argmin(1)
            h[rows, at[:, p]] = np.uint64(2**64 - 1)
        at.sort(1)
        sketch = SEEDS[lo : lo + step].copy()
        for p in range(picks):
            sketch = mix(sketch * M1 + grams[at[:, p]])
        out[lo : lo + step] = sketch
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if at most ``most``, else more than that: bands of doubling width."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return len(a) + len(b)
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    mine = np.zeros(len(values), np.int64)
    np.add.at(mine, np.searchsorted(values, a), 1)
    if max(len(a), len(b)) - int(np.minimum(mine, counts - mine).sum()) > most:
        return most + 1  # more words differ than may
    if len(a) < len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    rows = [places.get(w, 0) for w in b.tolist()]
    band = min(most, max(8, len(a) - len(b)))
    while True:
        d = banded(rows, len(a), band)
        if d <= band or band >= most:
            return d
        band = min(most, 4 * band)


def banded(rows: list[int], n: int, band: int) -> int:
    """Alignment cost within ``band`` diagonals, exact if at most ``band``, else ``band`` + 1.

    ``rows`` has, per word of the shorter text, the bits of its places in the
    longer one of ``n`` words. A column of the band is one integer of vertical
    differences, moved down by one word per step.
    """
    band = min(band, n)
    width = 2 * band + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down = full ^ ((1 << (width - band - 1)) - 1), 0
    cost, start = band, band + 1 - width
    most = band + max(len(rows) - max(n - band, 0), 0)  # the steps from row n - band on may each take one away
    for at in rows[: n - band]:
        x = (at >> start if start > 0 else at << -start) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        right, left = down | (full ^ (d | up)), d & up
        cost += not d & top
        if cost > most:
            return band + 1
        up, down = left | (full ^ ((d >> 1) | right)), (d >> 1) & right
        start += 1
    level = top >> 1
    for at in rows[max(n - band, 0) :]:
        x = (at >> start if start > 0 else at << -start) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        right, left = down | (full ^ (d | up)), d & up
        cost += bool(right & level) - bool(left & level)
        level >>= 1
        up, down = left | (full ^ ((d >> 1) | right)), (d >> 1) & right
        start += 1
    return cost if cost <= band else band + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - SIMILARITY) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield flat[lo:hi]


def labelled(words: np.ndarray) -> np.ndarray:
    """Words as hashes that tell equal ones apart by how many stand before."""
    w = words.view(np.uint64)
    return mix(w + occurrence(w) * M1)


def text_map(items: np.ndarray) -> bytes:
    """Bits of a text's labelled words. Chance links between unlike texts that share a passage grow with the table
    and connect them into one class where bits are few, so there are several for each word."""
    size = 1 << (max(LEAST_BITS, WORD_BITS * len(items)) - 1).bit_length()
    bits = np.zeros(size, np.uint8)
    bits[(mix(items) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_edits(sizes: np.ndarray) -> np.ndarray:
    return np.floor((1 - SIMILARITY) * sizes + 1e-9).astype(np.int64)


class TextBucket(Bucket):
    """Texts as bit maps of their occurrence-labelled words: an edit changes two bits at most."""

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        n, sizes = self.sizes[x], self.sizes[others]
        others = others[np.minimum(sizes, n) >= SIMILARITY * np.maximum(sizes, n) - 1e-9]
        out = []
        for longs in set(self.longs[others].tolist()):
            some = others[self.longs[others] == longs]
            shared = min(longs, int(self.longs[x]))
            mine = folded(self.maps[int(self.longs[x])][self.row[x]][None], shared)
            apart = np.bitwise_count(folded(self.maps[longs][self.row[some]], shared) ^ mine).sum(1, dtype=np.int64)
            out.append(some[apart <= 2 * most_edits(np.maximum(self.sizes[some], n))])
        return np.concatenate(out) if out else others[:0]

    def links(self) -> list[tuple[int, int]]:
        """Pairs that connect all texts which may be similar, directly or over others: each with the smallest id of its group, so that groups are shallow and buckets repeat pairs."""
        return connecting(self, lambda _, maybe: maybe.tolist())


def connecting(bucket: TextBucket, linked: Callable[[int, np.ndarray], list[int]], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(smallest id, id) for each group that is connected by what ``linked`` keeps of a text's candidates, each pair asked at most once; with ``sides`` only texts of different sides."""
    out, left = [], np.array(sorted(range(len(bucket.ids)), key=bucket.ids.__getitem__))
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            x = queue.pop()
            found = linked(x, bucket.alike(x, left if sides is None else left[sides[left] != sides[x]]))
            if found:
                out += [(bucket.ids[first], bucket.ids[y]) for y in found]
                queue += found
                left = left[~np.isin(left, found)]
    return out


def class_links(bucket: TextBucket, classes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``classes`` that connect those with texts which may be similar, fewer than there are classes: each two texts of classes that are not yet connected are compared."""
    _, side = np.unique(classes, return_inverse=True)
    out = []
    for x in np.flatnonzero(side != np.bincount(side).argmax()).tolist():
        for y in bucket.alike(x, np.flatnonzero(side != side[x])).tolist():
            if side[y] != side[x]:
                out.append((int(min(classes[x], classes[y])), int(max(classes[x], classes[y]))))
                side[side == side[y]] = side[x]
    return out


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, sketches, map) of documents with words and an id; h1 and h2 hash the word sequence."""
    words = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("words"))
    words = words.select("doc_id", F.xxhash64("words").alias("h1"), F.xxhash64("words", F.lit(1)).alias("h2"), F.size("words").alias("n"), "words")
    names = ["doc_id", "h1", "h2", "n", "sketches", "map"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(batch.column("n"), 0))
            if not batch.num_rows:
                continue
            made = [(order_sketches(w).view(np.int64), text_map(labelled(w))) for w in _lists(batch.column("words"))]
            flat = pa.array(np.concatenate([m[0] for m in made]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * SKETCHES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:4]] + [lists, pa.array([m[1] for m in made], pa.binary())], names=names)

    return words.mapInArrow(run, "doc_id long, h1 long, h2 long, n int, sketches array<long>, map binary")


def candidate_links(sketched: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): texts, or smallest texts of groups, as many as connect all that agree on a sketch and may be similar; of equal texts only the ``first`` (rep) count.

    Buckets of one and the same list of ids count once. Copies go once lists are
    known, as rows of two numbers, so that sketches are not shuffled for it.
    First each text is compared in its largest bucket alone, which gives at most
    one pair a text; then every bucket whose texts are not all in one class is
    compared between its classes. So a large group gives its pairs once and not
    once for each sketch. Texts and maps are joined by merge whatever the size,
    lest the plan of a small table hide what a large one moves.
    """
    members = sketched.select(F.col("doc_id").alias("id"), F.explode("sketches").alias("sketch"))
    sketch, bucket = Window.partitionBy("sketch"), Window.partitionBy("bucket")
    met = members.withColumn("m", F.count("*").over(sketch)).withColumn("list", F.bit_xor(F.xxhash64("id")).over(sketch)).where("m > 1")
    met = met.select(F.xxhash64("list", "m").alias("bucket"), "id").distinct().join(first, F.col("id") == F.col("rep"), "left_semi")
    shared = materialize(met.withColumn("m", F.count("*").over(bucket)).where("m > 1"), "omh-shared")
    slim = sketched.select(F.col("doc_id").alias("s"), F.col("n").cast("long").alias("n"), "map")

    def compared(rows: DataFrame, tag: str) -> DataFrame:
        rows = rows.join(slim.hint("merge"), F.col("id") == F.col("s")).drop("s")
        rows = in_blocks(rows, "bucket", F.ceil(F.col("m") / BUCKET_SETS), "id").select("bucket", "x", "y", "id", "n", "map", "class")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, int]] = set()
            for table in runs_of(batches, ["bucket", "x", "y"]):
                if table.num_rows > 1:
                    texts = TextBucket(table.column("id").to_pylist(), table.column("n").to_numpy(), table.column("map").to_pylist())
                    found.update(texts.links() if table.column("class").null_count else class_links(texts, table.column("class").to_numpy()))
                if len(found) > 200_000:
                    yield id_pairs(found)
                    found = set()
            if found:
                yield id_pairs(found)

        return materialize(rows.mapInArrow(run, "a long, b long").distinct(), tag)

    largest = shared.groupBy(F.col("id").alias("i")).agg(F.max(F.struct("m", "bucket")).alias("top"))
    begun = compared(largest.select(F.col("top.bucket").alias("bucket"), F.col("i").alias("id"), F.col("top.m").alias("m"), F.lit(None).cast("long").alias("class")), "omh-begun")
    groups = connected_components(begun, "omh-begun-groups")
    known = groups.select(F.col("id").alias("k"), F.col("class").alias("c"))
    dealt = shared.join(known, F.col("id") == F.col("k"), "left").select("bucket", "id", "m", F.coalesce("c", "id").alias("class"))
    mixed = dealt.withColumn("lo", F.min("class").over(bucket)).withColumn("hi", F.max("class").over(bucket)).where("lo < hi").drop("lo", "hi")
    links = materialize(begun.unionByName(compared(mixed, "omh-joined")), "omh-candidates")
    discard(shared, begun, groups)
    return links


class WordBucket(TextBucket):
    """Texts with their words: what their bit maps leave is turned down where too few words are shared, counted for many texts at once."""

    #: Texts counted at once.
    AT_ONCE = 256

    def __init__(self, ids: list[int], texts: list[np.ndarray]):
        marked = [labelled(t) for t in texts]
        super().__init__(ids, np.array([len(t) for t in texts]), [text_map(w) for w in marked])
        self.ends = np.cumsum(self.sizes)
        values, numbers = np.unique(np.concatenate(marked), return_inverse=True)
        self.words, self.mine = numbers.astype(np.int32), np.zeros(len(values), bool)

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        others, n = super().alike(x, others), int(self.sizes[x])
        if not n or not len(others):
            return others
        words = self.words[self.ends[x] - n : self.ends[x]]
        self.mine[words] = True
        keep = []
        for some in np.split(others, range(self.AT_ONCE, len(others), self.AT_ONCE)):
            sizes = self.sizes[some]
            first = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(self.ends[some] - sizes - first, sizes)
            shared = np.add.reduceat(self.mine[self.words[at]], first, dtype=np.int64)
            longest = np.maximum(sizes, n)
            keep.append(some[longest - shared <= most_edits(longest)])
        self.mine[words] = False
        return np.concatenate(keep)


def aligned_links(ids: list[int], texts: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of ids that connect all similar texts, with ``sides`` only over texts of different sides."""
    bucket = WordBucket(ids, texts)
    return connecting(bucket, lambda x, maybe: [y for y in maybe.tolist() if similar(texts[x], texts[y])], sides)


def verified_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) that connect all similar documents of candidate ``classes`` (id, class, n)."""
    words = classes.groupBy(F.col("class").alias("k")).agg(F.sum("n").alias("words"))
    dealt = classes.select("id", "class").join(words, F.col("class") == F.col("k")).drop("k").withColumn("blocks", F.ceil(F.col("words") / CLASS_WORDS))
    rows = docs.select(F.col("doc_id").alias("d"), "text").join(dealt.hint("merge"), F.col("d") == F.col("id")).select("class", "id", "text", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("side"))
    rows = in_blocks(rows, "class", F.col("blocks"), "id").select("class", "x", "y", "id", "side", word_hashes(F.col("text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["class", "x", "y"]):
            across = table.column("x")[0] != table.column("y")[0]
            pairs = aligned_links(table.column("id").to_pylist(), list(_lists(table.column("words"))), table.column("side").to_numpy() if across else None)
            if pairs:
                yield id_pairs(set(pairs))

    return rows.mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every document, class_id the smallest doc_id of its group.

    Documents without words (null, empty or only marks) and those with a null
    doc_id are in no group: their class is their own id. Rows that share a
    doc_id are one document with several texts: any of them links it. An empty
    table gives no rows; other columns are ignored. Groups are the connected
    classes of verified pairs.
    """
    sketched = materialize(sketch_documents(docs.select("doc_id", "text")), "omh-sketches")
    known = sketched.select("doc_id", "h1", "h2", "n").distinct()
    reps = known.groupBy(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n").alias("rn")).agg(F.min("doc_id").alias("rep"))
    own = materialize(known.join(reps, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("n") == F.col("rn"))).select("doc_id", "rep"), "omh-own")
    first = own.where("doc_id = rep").select("rep").distinct()
    candidates = candidate_links(sketched, first)
    groups = connected_components(candidates, "omh-groups")
    sizes = sketched.groupBy(F.col("doc_id").alias("s")).agg(F.max("n").cast("long").alias("n"))
    classes = materialize(groups.join(sizes, F.col("id") == F.col("s")).select("id", "class", "n"), "omh-classes")
    links = verified_links(docs, classes)
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    links = materialize(links.unionByName(twice.select("a", F.explode("all").alias("b")).where("a <> b")), "omh-links")
    found = connected_components(links, "omh-final").select(F.col("id").alias("c"), "class")
    discard(sketched, candidates, groups, classes, links)
    grouped = own.join(found, F.col("rep") == F.col("c"), "left").groupBy(F.col("doc_id").alias("g")).agg(F.min(F.coalesce("class", "rep")).alias("class_id"))
    return docs.select("doc_id").join(grouped, F.col("doc_id") == F.col("g"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the smallest doc_id. Its columns pass through, whatever their names."""
    gone = free_name("_gone", docs)
    classes = near_classes(docs.select("doc_id", "text")).where("class_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(classes, F.col("doc_id") == F.col(gone), "left_anti")
