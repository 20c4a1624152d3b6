"""Documents whose word n-gram sets are alike (Jaccard), by a prefix-tree join.

A set is the distinct four-word shingles of a text, as 64-bit items in one
global order: rare ones first, by a table of counts over all documents, then by
hash. Equal sets are folded. Two sets at the similarity share one of their first
items (of n, the first n - ceil(0.85 n) + 1), so sets meet where they share such
an item; sizes and a bit map of each set turn down most that are not alike, and
what is left falls into small classes of candidates.

Each class's sets are stored in a trie in the global order. A set is looked up by
walking down from the root with the overlap so far, which all sets below share;
a subtree is left as soon as the items that remain on either side can't make up
the overlap its sizes ask for. Sets that were found join the class and leave the
trie, so copies are found once. Links need not be expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, discard, materialize

SHINGLE = 4
#: Two sets are linked if 100 * intersection >= 85 * union.
PERCENT = 85
#: Counters of the table that orders items; each task has one.
CELLS = 1 << 18
#: Sets of one bucket, and words of one class, that a task compares with each other; more are cut into blocks, each compared with each.
BUCKET_SETS, CLASS_WORDS = 16_384, 3_000_000
#: Bytes of texts that are hashed together; powers that are kept for places in a word.
SLICE, PLACES = 1 << 20, 1 << 12
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Item sets of texts; words are runs of UTF-8 bytes without ASCII white space, A-Z in lower case.

    Many texts are hashed at once: a word's hash is the sum of its bytes' random
    numbers, each times an odd number to the power of its place in the word.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(20_011)
        self.byte = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.byte[self.blank] = 0
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.full(PLACES, M1 | np.uint64(1), np.uint64))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The distinct shingles' hashes of each text, sorted; a text of fewer words is one shingle, one without words, and null, has none."""
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        null = np.asarray(column.is_null())
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
            yield from self._slice(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], null[lo:hi])
            lo = hi

    def _slice(self, text: np.ndarray, at: np.ndarray, null: np.ndarray) -> Iterator[np.ndarray]:
        blank = self.blank[text]
        begins = np.r_[True, blank[:-1]][: len(text)]
        begins[at[:-1][at[:-1] < len(text)]] = True
        starts = np.flatnonzero(begins & ~blank)
        own = np.searchsorted(at, starts, side="right") - 1  # the text a word is in; empty texts have none
        hashes = np.zeros(0, np.uint64)
        if len(starts):
            run = text[starts[0] :]
            place = np.arange(len(run)) - np.repeat(starts - starts[0], np.diff(np.r_[starts, len(text)]))
            hashes = mix(np.add.reduceat(self.byte[run] * self.power[place & (PLACES - 1)], starts - starts[0]))
        first = np.searchsorted(own, np.arange(len(null) + 1))
        grams = self._grams(hashes, SHINGLE)
        for i in range(len(null)):
            lo, hi = first[i], first[i + 1]
            if null[i] or lo == hi:
                yield np.zeros(0, np.uint64)
            elif hi - lo < SHINGLE:
                yield self._grams(hashes[lo:hi], int(hi - lo))
            else:
                g = np.sort(grams[lo : hi - SHINGLE + 1])
                yield g[np.r_[True, g[1:] != g[:-1]]]

    @staticmethod
    def _grams(words: np.ndarray, size: int) -> np.ndarray:
        n = max(len(words) - size + 1, 0)
        g = np.full(n, size, np.uint64)
        for j in range(size):
            g = (g ^ (g >> np.uint64(29))) * M1 + words[j : j + n] * M2
        return mix(g)


def in_order(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted keys of items: six bits of how often the item's counter was hit (its logarithm), then the item's hash."""
    keys = (items >> np.uint64(6)) | (levels[(items & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58))
    return np.unique(keys)


def bit_map(keys: np.ndarray) -> np.ndarray:
    """Bits of a set's items, in a map of at least as many bits as items."""
    size = 1 << max(6, (len(keys) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix(keys) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def overlap(a, b):
    """Least intersection of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2) of every row: set size and two hashes of the set; and rows with (cell, hits), a task's counts of items by counter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "h1", "h2", "cells", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, count, id_type = Shingler(), np.zeros(CELLS, np.int64), None
        waiting, many = [], 0
        for batch in batches:
            id_type = batch.column("doc_id").type
            n, h1, h2 = [], [], []
            for items in shingler.sets(batch.column("text")):
                waiting.append((items & np.uint64(CELLS - 1)).astype(np.int32))
                many += len(items)
                if many > 1_000_000:
                    count += np.bincount(np.concatenate(waiting), minlength=CELLS)
                    waiting, many = [], 0
                n.append(len(items))
                h1.append(int(mix(items + M1).sum(dtype=np.uint64)) - 2**63)
                h2.append(int(mix(items * M1 + M3).sum(dtype=np.uint64)) - 2**63)
            none = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), none, none], names=names)
        if many:
            count += np.bincount(np.concatenate(waiting), minlength=CELLS)
        cells = np.flatnonzero(count)
        for lo in range(0, len(cells), 4096):
            part = cells[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 3, pa.array([part], pa.list_(pa.int64())), pa.array([count[part]], pa.list_(pa.int64()))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, h1 long, h2 long, cells array<long>, hits array<long>")


def count_levels(table: DataFrame) -> np.ndarray:
    """Bits of each counter's total over all documents; ``CELLS`` numbers."""
    pairs = table.where("cells is not null").select(F.explode(F.arrays_zip("cells", "hits")).alias("p"))
    totals = pairs.groupBy(F.col("p.cells").alias("cell")).agg(F.sum("p.hits").alias("hits"))
    levels = totals.select("cell", F.ceil(F.log2(F.col("hits") + 1)).alias("level")).toPandas()
    out = np.zeros(CELLS, np.uint8)
    out[levels.cell.to_numpy()] = levels.level.to_numpy()
    return out


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(id, n, prefix, map): a set's first items and its bit map, of rows with words and an id."""
    names = ["id", "n", "prefix", "map"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows, sizes, lists, maps = [], [], [], []
            for i, items in enumerate(shingler.sets(batch.column("text"))):
                if len(items):
                    keys = in_order(items, levels)
                    rows.append(i)
                    sizes.append(len(keys))
                    lists.append(keys[: prefix_length(len(keys))].view(np.int64))
                    maps.append(bit_map(keys).tobytes())
            if rows:
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(sizes, pa.int64()), flat, pa.array(maps, pa.binary())], names=names)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "id long, n long, prefix array<long>, map binary")


def folded(maps: np.ndarray, longs: int) -> np.ndarray:
    """Maps (a row each) halved to ``longs`` longs: two maps still differ in at most as many bits as their sets in items."""
    while maps.shape[1] > longs:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Bucket:
    """Sets that share an item: ids, sizes and bit maps, of which some may be alike."""

    def __init__(self, ids: list[int], sizes: np.ndarray, maps: list[bytes]) -> None:
        self.ids, self.sizes = ids, sizes
        self.longs = np.array([len(m) // 8 for m in maps])
        self.row = np.zeros(len(ids), np.int64)
        self.maps = {}
        for longs in set(self.longs.tolist()):
            mine = np.flatnonzero(self.longs == longs)
            self.row[mine] = np.arange(len(mine))
            self.maps[longs] = np.frombuffer(b"".join([maps[i] for i in mine]), np.uint64).reshape(len(mine), longs)

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those ``others`` that may be linked to ``x``: by sizes, and because two maps differ in at most as many bits as the sets in items."""
        n = self.sizes[x]
        sizes = self.sizes[others]
        others = others[(100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n))]
        out = []
        for longs in set(self.longs[others].tolist()):
            some = others[self.longs[others] == longs]
            shared = min(longs, int(self.longs[x]))
            mine = folded(self.maps[int(self.longs[x])][self.row[x]][None], shared)
            apart = np.bitwise_count(folded(self.maps[longs][self.row[some]], shared) ^ mine).sum(1, dtype=np.int64)
            out.append(some[apart <= self.sizes[some] + n - 2 * overlap(self.sizes[some], n)])
        return np.concatenate(out) if out else others[:0]

    def links(self) -> list[tuple[int, int]]:
        """Pairs of ids that connect all sets that may be alike, directly or over others."""
        out, left = [], np.arange(len(self.ids))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                found = self.alike(x, left)
                if len(found):
                    out += [(self.ids[x], self.ids[y]) for y in found.tolist()]
                    queue += found.tolist()
                    left = left[~np.isin(left, found)]
        return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal ``keys``, of rows sorted by them; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        cut[0] = bool(held) and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
        at = np.flatnonzero(cut)
        for lo, hi in zip(np.r_[0, at], np.r_[at, batch.num_rows], strict=True):
            if cut[lo] and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: str, blocks: Column, part: str) -> DataFrame:
    """``rows`` dealt so that each two rows of a ``key`` meet in one (key, x, y): rows of ``blocks`` blocks by the hash of ``part``, each block with each."""
    mine = F.pmod(F.xxhash64(part), blocks).cast("int")
    out = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    out = out.withColumn("x", F.least("_mine", "_other")).withColumn("y", F.greatest("_mine", "_other")).drop("_mine", "_other")
    return out.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y")


def candidate_links(sketches: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): sets that share a first item and may be alike, as many as connect all of them; of equal sets only the ``first`` (rep) count.

    Items with one and the same list of sets count once. Copies go once lists
    are known, as rows of two numbers, so that sketches are not shuffled for it.
    """
    members = sketches.select("id", F.explode("prefix").alias("item"))
    item, bucket = Window.partitionBy("item"), Window.partitionBy("bucket")
    met = members.withColumn("m", F.count("*").over(item)).withColumn("list", F.bit_xor(F.xxhash64("id")).over(item)).where("m > 1")
    met = met.select(F.xxhash64("list", "m").alias("bucket"), "id").distinct().join(first, F.col("id") == F.col("rep"), "left_semi")
    shared = materialize(met.withColumn("m", F.count("*").over(bucket)).where("m > 1"), "ngram-shared")
    slim = sketches.select(F.col("id").alias("s"), "n", "map")
    rows = in_blocks(shared.join(slim, F.col("id") == F.col("s")).drop("s"), "bucket", F.ceil(F.col("m") / BUCKET_SETS), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for table in runs_of(batches, ["bucket", "x", "y"]):
            if table.num_rows > 1:
                found.update(Bucket(table.column("id").to_pylist(), table.column("n").to_numpy(), table.column("map").to_pylist()).links())
            if len(found) > 200_000:
                yield id_pairs(found)
                found = set()
        if found:
            yield id_pairs(found)

    links = rows.select("bucket", "x", "y", "id", "n", "map").mapInArrow(run, "a long, b long")
    links = materialize(links.distinct(), "ngram-candidates")
    discard(shared)
    return links


def id_pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(sorted(found), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


class Trie:
    """Sorted key sets in a compressed prefix tree, as arrays over its nodes; sets can leave."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        coded = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=coded.__getitem__)
        parent, depth, ends, pieces = [-1], [0], [[]], [np.empty(0, np.uint64)]
        self.leaf = [0] * len(sets)
        path, before = [0], np.empty(0, np.uint64)  # the nodes down to the last set

        def grow(under: int, at: int, keys: np.ndarray) -> int:
            for column, value in ((parent, under), (depth, at), (ends, []), (pieces, keys)):
                column.append(value)
            return len(parent) - 1

        for i in order:
            s = sets[i]
            k = min(len(s), len(before))
            apart = np.flatnonzero(s[:k] != before[:k])
            common = int(apart[0]) if len(apart) else k
            while depth[path[-1]] > common:
                node = path.pop()
                if depth[path[-1]] < common:  # split the edge to ``node``
                    cut = common - depth[path[-1]]
                    upper = grow(path[-1], common, pieces[node][:cut])
                    pieces[node], parent[node] = pieces[node][cut:], upper
                    path.append(upper)
            if len(s) > common:
                path.append(grow(path[-1], len(s), s[common:]))
            ends[path[-1]].append(i)
            self.leaf[i] = path[-1]
            before = s
        self.parent, self.ends = np.array(parent), ends
        self.depth, self.sizes = np.array(depth), np.array([len(s) for s in sets])
        nodes = np.argsort(self.depth, kind="stable")
        self.length = np.array([len(p) for p in pieces])
        self.at = np.r_[0, np.cumsum(self.length)]
        self.keys = np.concatenate(pieces)
        self.alive = np.zeros(len(parent), np.int64)
        self.least, self.most = np.full(len(parent), 1 << 60), np.zeros(len(parent), np.int64)
        for i, node in enumerate(self.leaf):
            self.alive[node] += 1
            self.least[node] = self.most[node] = self.sizes[i]
        for node in nodes[::-1]:
            p = self.parent[node]
            if p >= 0:
                self.alive[p] += self.alive[node]
                self.least[p], self.most[p] = min(self.least[p], self.least[node]), max(self.most[p], self.most[node])
        by = np.argsort(self.parent, kind="stable")
        self.children = by[np.searchsorted(self.parent[by], 0) :]
        bounds = np.searchsorted(self.parent[self.children], np.arange(len(parent) + 1))
        self.first, self.last = bounds[:-1], bounds[1:]

    def remove(self, i: int) -> None:
        node = self.leaf[i]
        self.ends[node].remove(i)
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def linked(self, x: np.ndarray) -> list[int]:
        """Sets that are in the trie and linked to ``x``: level by level, the nodes that may still lead to one."""
        n, found = len(x), []
        nodes, had = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            for node, k in zip(nodes.tolist(), had.tolist(), strict=True):
                for i in self.ends[node]:
                    if k >= overlap(int(self.sizes[i]), n):
                        found.append(i)
            nodes, had = self._below(nodes, had)
            nodes, had = nodes[keep := self.alive[nodes] > 0], had[keep]
            keep = (100 * self.most[nodes] >= PERCENT * n) & (100 * n >= PERCENT * self.least[nodes])
            nodes, had = nodes[keep], had[keep]
            if not len(nodes):
                break
            lengths = self.length[nodes]
            ends = np.cumsum(lengths)
            keys = self.keys[np.repeat(self.at[nodes] - ends + lengths, lengths) + np.arange(ends[-1])]
            place = np.searchsorted(x, keys)
            hit = x[np.minimum(place, n - 1)] == keys
            had = had + np.add.reduceat(hit.astype(np.int64), ends - lengths)
            rest = n - place[ends - 1] - hit[ends - 1]
            least = np.maximum(self.least[nodes], -(-PERCENT * n // 100))
            keep = had + np.minimum(rest, self.most[nodes] - self.depth[nodes]) >= overlap(least, n)
            nodes, had = nodes[keep], had[keep]
        return found

    def _below(self, nodes: np.ndarray, had: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.last[nodes] - self.first[nodes]
        if not many.sum():
            return nodes[:0], had[:0]
        ends = np.cumsum(many)
        return self.children[np.repeat(self.first[nodes] - ends + many, many) + np.arange(ends[-1])], np.repeat(had, many)


def trie_links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ids that connect all linked sets."""
    trie, out = Trie(sets), []
    waiting = dict.fromkeys(sorted(range(len(ids)), key=ids.__getitem__))
    while waiting:
        queue = [next(iter(waiting))]
        del waiting[queue[0]]
        trie.remove(queue[0])
        while queue and waiting:
            x = queue.pop()
            for y in trie.linked(sets[x]):
                out.append((ids[x], ids[y]))
                del waiting[y]
                trie.remove(y)
                queue.append(y)
    return out


def verified_links(docs: DataFrame, classes: DataFrame, levels: np.ndarray) -> DataFrame:
    """(a, b) that connect all linked documents of candidate ``classes`` (id, class, n)."""
    words = classes.groupBy(F.col("class").alias("k")).agg(F.sum("n").alias("words"))
    dealt = classes.select("id", "class").join(words, F.col("class") == F.col("k")).drop("k")
    rows = docs.select(F.col("doc_id").alias("d"), "text").join(dealt, F.col("d") == F.col("id")).select("class", "id", "text", "words")
    rows = in_blocks(rows, "class", F.ceil(F.col("words") / CLASS_WORDS), "id").select("class", "x", "y", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def as_sets() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [in_order(items, levels) for items in shingler.sets(batch.column("text"))]
                flat = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int64()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("class", "x", "y", "id")], flat], names=["class", "x", "y", "id", "keys"])

        for table in runs_of(as_sets(), ["class", "x", "y"]):
            column = table.column("keys").combine_chunks()
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            pairs = trie_links(table.column("id").to_pylist(), [flat[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)])
            if pairs:
                yield id_pairs(set(pairs))

    return rows.mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. Texts without words,
    and null ones, have an empty set and are linked with nothing; a row with a null
    doc_id has a null component and links nothing. Rows that share a doc_id are
    one document with several sets: any of them links it. doc_id must be a whole
    number. Equal sets are linked. An empty table gives no rows; other columns
    are ignored, whatever their names. Texts are taken whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(digests(docs), "ngram-digests")
    levels = count_levels(table)
    rows = table.where("cells is null").select("doc_id", "n", "h1", "h2")
    known = rows.where("doc_id is not null and n > 0").distinct()
    reps = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    own = materialize(known.join(reps.select(F.col("n").alias("rn"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), "rep"), (F.col("n") == F.col("rn")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).select("doc_id", "n", "rep"), "ngram-own")
    first = own.where("doc_id = rep").select("rep").distinct()
    sketches = materialize(prefixes(docs, levels), "ngram-sketches")
    candidates = candidate_links(sketches, first)
    groups = connected_components(candidates, "ngram-groups")
    sizes = sketches.groupBy(F.col("id").alias("s")).agg(F.max("n").alias("n"))
    classes = materialize(groups.join(sizes, F.col("id") == F.col("s")).select("id", "class", "n"), "ngram-classes")
    links = verified_links(docs, classes, levels)
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    links = materialize(links.unionByName(twice.select("a", F.explode("all").alias("b")).where("a <> b")), "ngram-links")
    found = connected_components(links, "ngram-components").select(F.col("id").alias("c"), "class")
    discard(sketches, candidates, groups, classes, links)
    mine = own.join(found, F.col("rep") == F.col("c"), "left").groupBy(F.col("doc_id").alias("m")).agg(F.min(F.coalesce("class", "rep")).alias("component_id"))
    out = rows.join(mine, F.col("doc_id") == F.col("m"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
