"""Exact substring dedup: bytes covered by a 50-byte string of an earlier document.

1. Anchors. In every window of ``LENGTH`` bytes the ``GRAM``-byte string with
   the smallest hash is its anchor, a function of the window alone, so equal
   windows have equal anchors. Only (hash, document, position) is shuffled; a
   sorted stream keeps the anchors that two documents share.
2. Contexts. Around each shared anchor the bytes of the windows that have it are
   cut: a run, as windows between two of them have it too. Equal contexts fold
   to one with its smallest document.
3. Suffix arrays. The distinct contexts of an anchor meet in one task, which
   sorts their suffixes by linear grouping: suffixes are grouped by Lyndon
   prefix, groups are worked off in descending order along previous-smaller
   pointers, and each group's order is then emitted, without renaming. Runs of
   suffixes that agree on a window give its first document. As each window of
   an anchor has the anchor's bytes, those are sorted as one symbol. Before,
   contexts are cut to the bytes that another one has too, and fold again.
   Anchors with more than ``CONTEXTS`` contexts are split by window instead.
4. A document's covered bytes are the union over its contexts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM  # a window begins at most so many bytes before its anchor
CONTEXTS = 4096
#: Windows are told apart by how many bytes before their anchor they start, in cells of so many places.
CELL = 9
COMMON = LENGTH - CELL + 1  # bytes that all windows of a cell share
#: Texts whose anchors are found at once, in bytes; a longer text goes alone.
SLICE_BYTES = 1 << 16
#: Contexts that are sorted together, in bytes.
SORT_BYTES = 1 << 13
_rng = np.random.default_rng(5)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEPS = [np.uint64(x | 1) for x in _rng.integers(1, 2**63, 8, dtype=np.uint64)]


def grouped_suffixes(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is smaller than all others and occurs once.

    Phase one groups suffixes by Lyndon prefix, from the highest group down:
    each suffix of a group points to the previous suffix of a smaller group,
    whose prefix its own extends; those move behind the rest of their group,
    by how many suffixes point to them. Phase two runs over the sorted
    suffixes and places, along the same pointers, all whose prefix ends there.
    """
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    begin, at = {}, 0
    for c in sorted(counts):
        begin[c] = at
        at += counts[c]
    fill = dict(begin)
    order, place, start = [0] * n, [0] * n, [0] * n  # start: first slot of a suffix's group
    size = [0] * n  # by first slot
    for s, c in enumerate(text):
        k = fill[c]
        fill[c] = k + 1
        order[k], place[s], start[s] = s, k, begin[c]
    for c, b in begin.items():
        size[b] = counts[c]
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        s = order[end]
        g = start[s]
        if g == end:  # most groups are of one suffix, which moves one other at most
            p = s - 1
            while p >= 0 and start[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0 and size[start[p]] > 1:
                b = start[p]
                size[b] -= 1
                last = b + size[b]
                other, here = order[last], place[p]
                order[here], place[other] = other, here
                order[last], place[p] = p, last
                size[last], start[p] = 1, last
            end -= 1
            continue
        group = sorted(order[g : end + 1])
        found: dict[int, int] = {}
        for s in group:  # ascending, so pointers within the group are known
            p = s - 1
            while p >= 0 and start[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if found:
            by_count: dict[int, list[int]] = {}
            if max(found.values()) == 1:
                by_count[1] = list(found)
            else:
                for p, k in found.items():
                    by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[k]:
                    b = start[p]
                    size[b] -= 1
                    last = b + size[b]
                    other, here = order[last], place[p]
                    order[here], place[other] = other, here
                    order[last], place[p] = p, last
                    moved[b] = moved.get(b, 0) + 1
                for b, m in moved.items():
                    new = b + size[b]
                    if new == b:  # the whole group moved: it stays as it is
                        size[b] = m
                        continue
                    size[new] = m
                    for j in range(new, new + m):
                        start[order[j]] = new
        end = g - 1
    out, free, done = [-1] * n, start[:], [False] * n
    heads = {}
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            b = free[s]
            k = heads.get(b, b)
            out[k] = s
            heads[b] = k + 1
            done[s] = True
            s = prev[s]
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, hash, first byte and size of the windows that have it, its place in these, cells) of every anchor of the texts.

    ``cells`` packs three hashes of 7 bits, of the bytes that a third of the
    anchor's windows have in common each; 0 where it has no such bytes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = BYTE[data]  # hashes of 1, 2, 4, 8, 16 and then 24 bytes
    grams = {1: h}
    for i, w in enumerate((1, 2, 4, 8)):
        g = grams[w]
        grams[2 * w] = g[:-w] * _STEPS[i] + g[w:]
        grams[2 * w] ^= grams[2 * w] >> np.uint64(29)
    h = grams[16][: n - GRAM + 1] * _STEPS[5] + grams[8][16 : n - GRAM + 17]
    h *= _STEPS[6]
    h ^= h >> np.uint64(32)
    h *= _STEPS[7]
    h |= np.uint64(1)
    m = n - LENGTH + 1
    least, span = h, 1  # least over REACH + 1 positions, by doubling
    while span * 2 <= REACH + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:m], least[REACH + 1 - span : REACH + 1 - span + m])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes)[:m] - np.arange(m)
    least[left < LENGTH] = 0  # windows that would cross into the next text
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    most, span = padded, 1
    while span * 2 <= REACH + 1:
        most = np.maximum(most[:-span], most[span:])
        span *= 2
    most = np.maximum(most[: len(h)], most[REACH + 1 - span : REACH + 1 - span + len(h)])
    at = np.flatnonzero(most == h)
    number = np.searchsorted(ends, at, side="right")
    # The windows that have an anchor are neighbours: a run of equal values within its REACH + 1 places.
    change = padded[1:] != padded[:-1]
    first = np.r_[0, np.flatnonzero(change) + 1]
    last = np.r_[first[1:], len(padded)]
    run = np.r_[0, np.cumsum(change)][at]
    off = np.flatnonzero(padded[first[run]] != h[at])
    while len(off):
        run[off] += 1
        off = off[padded[first[run[off]]] != h[at[off]]]
    lo = np.maximum(first[run], at) - REACH
    size = np.minimum(last[run], at + REACH + 1) - REACH - lo + LENGTH - 1
    # Windows that start ``e`` to ``e + CELL - 1`` bytes before the anchor share the bytes that all of them have.
    cells = np.zeros(len(at), np.int64)
    for e in range(0, REACH + 1, CELL):
        p = at - e
        there = (p >= lo) & (p + COMMON <= lo + size)
        p = np.where(there, p, 0)
        mixed = (grams[16][p] * _STEPS[5] + grams[16][np.minimum(p + 16, n - 16)]) * _STEPS[6] + grams[16][np.minimum(p + COMMON - 16, n - 16)]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEPS[7]
        cells = cells << 7 | np.where(there, (mixed >> np.uint64(40)) % np.uint64(127) + np.uint64(1), np.uint64(0)).astype(np.int64)
    return number, h[at].view(np.int64), lo - (ends - sizes)[number], size, at - lo, cells


def _blob(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode() for x in column.to_pylist()]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, place) of all documents' anchors; ``place`` packs lo (31 bits), size (7), at (5) and cells (21)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _blob(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            slices = np.cumsum([len(t) for t in texts]) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                number, h, lo, size, at, cells = anchors(texts[a:b])
                place = ((lo << 7 | size) << 5 | at) << 21 | cells
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[a:b][number]), pa.array(place)], names=["hash", "doc_id", "place"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "hash long, doc_id long, place long")


def with_partner(group: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which rows agree in one of their three cells with another row of their group; all that share a window do."""
    keep = np.zeros(len(group), bool)
    for shift in (0, 7, 14):
        cell = cells >> shift & 127
        key = group * 128 + cell
        keep |= (cell > 0) & (np.bincount(key)[key] > 1)
    return keep


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(hash, doc_id, lo, size, at) whose hash occurs in two documents, from a stream sorted by hash.

    Holds one document's rows of a hash at most. Where a hash's rows lie in one
    batch, those without a partner in any cell are left out, as no other has a window of theirs.
    """

    def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.column(2).to_numpy()
        parts = [(place >> 33).astype(np.int32), (place >> 26 & 127).astype(np.int8), (place >> 21 & 31).astype(np.int8)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, parts)], names=["hash", "doc_id", "lo", "size", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the hash at the end, so far all of one document
        last, known = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(h)]
            many = np.minimum.reduceat(d, lo) != np.maximum.reduceat(d, lo)
            keep = np.repeat(many, hi - lo)
            inner = np.flatnonzero(keep[hi[0] : lo[-1]]) + hi[0]  # rows of whole groups
            if len(inner):
                group = np.repeat(np.cumsum(many), hi - lo)[inner]
                keep[inner] = with_partner(group - group[0], batch.column(2).to_numpy()[inner])
            if last is not None and h[0] == last[0]:  # the first run goes on from the batch before
                if known or many[0] or d[0] != last[1]:
                    yield from map(unpacked, held)
                    held, known = [], True
                    keep[: hi[0]] = True
                many[0] = known
            if len(lo) > 1 or last is None or h[0] != last[0]:
                held, known = [], bool(many[-1])
            if not known:
                held.append(batch.slice(int(lo[-1])))
            last = (h[-1], d[-1])
            yield unpacked(batch.filter(pa.array(keep)))

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, doc_id long, lo int, size tinyint, at tinyint")


def contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(hash, doc_id, lo, at, context): the bytes of each shared anchor's windows."""
    per = shared.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("hash", "lo", "size", "at")).alias("found"))
    joined = docs.select("doc_id", "text").join(per, docs.doc_id == per.d).select("doc_id", "text", "found.hash", "found.lo", "found.size", "found.at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                text = part.column(1)[0].as_py().encode()
                h, lo, size = part.column(2)[0].values, part.column(3)[0].values.to_numpy(), part.column(4)[0].values.to_numpy()
                cut = [text[a:b] for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h, pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(lo))), pa.array(lo), part.column(5)[0].values, pa.array(cut, pa.binary())], names=["hash", "doc_id", "lo", "at", "context"])

    return joined.mapInArrow(run, "hash long, doc_id long, lo int, at tinyint, context binary")


def repeated_starts(parts: list[tuple[int, int, bytes, int]]) -> list[int]:
    """For each (hash, anchor's place, context, document) a bit set of the window starts whose window a smaller document has."""
    text: list[int] = []
    begin, owner = [], []  # owner: the context of each window's start, else -1
    symbols: dict[tuple[int, bytes], int] = {}
    for k, (h, at, data, _) in enumerate(parts):
        begin.append(len(text))
        text += [b + 2 for b in data[:at]]
        text.append(symbols.setdefault((h, data[at : at + GRAM]), 258 + len(symbols)))
        text += [b + 2 for b in data[at + GRAM :]]
        text.append(1)
        owner += [k] * (len(data) - LENGTH + 1) + [-1] * (REACH + 1)
    text.append(0)
    out, run, window = [0] * len(parts), [], None

    def close() -> None:
        if len(run) > 1:
            first = min(parts[owner[s]][3] for s in run)
            for s in run:
                k = owner[s]
                if parts[k][3] > first:
                    out[k] |= 1 << (s - begin[k])

    for s in grouped_suffixes(text)[1:]:
        if owner[s] < 0:
            continue
        w = text[s : s + REACH + 1]
        if w != window:
            close()
            run, window = [], w
        run.append(s)
    close()
    return out


def common(ordered: list[bytes]) -> list[int]:
    """How many first bytes each of the sorted strings has in common with another one: with a neighbour, as no other has more."""
    out = [0] * len(ordered)
    for k in range(len(ordered) - 1):
        a, b = ordered[k], ordered[k + 1]
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        same = n - (x.bit_length() + 7 >> 3)
        out[k], out[k + 1] = max(out[k], same), same
    return out


def sharing(parts: list[tuple[int, int, bytes, int]]) -> tuple[list[tuple[int, int, bytes, int]], list[tuple[int, int, tuple]]]:
    """The contexts of one anchor, cut to the bytes around it that another one has too; and of each that is left (number of its cut context, bytes cut off in front, whole context).

    A window that two contexts share lies within what each has in common with
    another before its anchor, and from it on; those left with less than a window
    have none. Equal cut contexts fold to one with their smallest document.
    """
    before = [data[:at][::-1] for _, at, data, _ in parts]
    after = [data[at:] for _, at, data, _ in parts]
    size = [[0] * len(parts) for _ in range(2)]
    for side, strings in zip(size, (before, after), strict=True):
        order = sorted(range(len(parts)), key=strings.__getitem__)
        for k, n in zip(order, common([strings[k] for k in order]), strict=True):
            side[k] = n
    cut: dict[tuple[int, bytes], list] = {}
    whole = []
    for row, left, right in zip(parts, *size, strict=True):
        if left + right >= LENGTH:
            h, at, data, first = row
            known = cut.setdefault((left, data[at - left : at + right]), [len(cut), first])
            known[1] = min(known[1], first)
            whole.append((known[0], at - left, row))
    return [(parts[0][0], left, data, first) for (left, data), (_, first) in cut.items()], whole


def sort_contexts(distinct: DataFrame) -> DataFrame:
    """(hash, at, context, starts) of those contexts that repeat windows, ``starts`` the bits of where these start; anchors' contexts meet by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes, int]] = []  # cut contexts, and the whole ones by their numbers
        members: list[tuple[int, int, tuple]] = []
        same: list[tuple[int, int, bytes, int]] = []  # contexts of one anchor
        held = 0

        def add() -> int:
            parts, whole = sharing(same) if len(same) > 1 else ([], [])
            members.extend((len(group) + k, cut, row) for k, cut, row in whole)
            group.extend(parts)
            same.clear()
            return sum(len(x[2]) for x in parts)

        def work() -> pa.RecordBatch:
            times = Counter(x[0] for x in group)
            several = [x for x in group if times[x[0]] > 1]  # a context that is alone repeats nothing
            found = dict(zip(several, repeated_starts(several), strict=True)) if several else {}
            rows = []
            for k, cut, (*row, first) in members:  # a later document repeats all windows of an equal cut context
                starts = found.get(group[k], 0) if first == group[k][3] else (1 << (len(group[k][2]) - LENGTH + 1)) - 1
                if starts:
                    rows.append((*row, starts << cut))
            group.clear()
            members.clear()
            h, at, c, starts = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(at, pa.int8()), pa.array(c, pa.binary()), pa.array(starts, pa.int64())], names=["hash", "at", "context", "starts"])

        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if same and same[-1][0] != row[0]:
                    held += add()
                    if held > SORT_BYTES:
                        yield work()
                        held = 0
                same.append(row)
        add()
        yield work()

    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(partitions, "hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, at tinyint, context binary, starts long")


def split_contexts(distinct: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, window by window: equal windows meet by hash and content."""
    w = distinct.select("hash", "at", "context", "first", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("s"))
    w = w.withColumn("window", F.substring("context", F.col("s") + 1, F.lit(LENGTH)))
    least = materialize(w.groupBy(F.col("window").alias("w")).agg(F.min("first").alias("least")), "substring-windows")
    hit = w.join(least, w.window == least.w).where("first > least")
    bits = hit.groupBy("hash", "at", "context").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("starts"))
    return bits


def covered_contexts(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, starts): window starts, as bits from byte ``lo``, whose window an earlier document has."""
    shared = materialize(shared_anchors(anchor_rows(docs)), "substring-anchors")
    content = ("hash", "at", "context")
    # Two hashes stand for a context in the last join, as one of 64 bits collides at 10^11 rows.
    key, check = F.xxhash64(*content), F.xxhash64(F.lit(1), *content)
    cut = materialize(contexts(docs, shared), "substring-contexts")
    discard(shared)
    distinct = cut.groupBy(*content).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    distinct = materialize(distinct, "substring-distinct")
    many = materialize(distinct.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n")).where("n > 1"), "substring-counts")
    counted = distinct.join(many, distinct.hash == many.h)
    sorted_ = sort_contexts(counted.where(F.col("n") <= CONTEXTS).select(*content, "first"))
    split = split_contexts(counted.where(F.col("n") > CONTEXTS).select(*content, "first"))
    bits = materialize(sorted_.unionByName(split).where("starts <> 0").select(key.alias("k"), check.alias("c"), "starts"), "substring-bits")
    discard(many)
    verdict = distinct.select(key.alias("key2"), check.alias("check2"), "first", "rows")
    verdict = verdict.join(bits, (F.col("key2") == bits.k) & (F.col("check2") == bits.c), "left").where("rows > 1 or starts is not null")
    verdict = materialize(verdict.select("key2", "check2", "first", F.coalesce("starts", F.lit(0).cast("long")).alias("starts")), "substring-verdicts")
    discard(distinct, bits)
    joined = cut.select("doc_id", "lo", key.alias("key"), check.alias("check"), F.octet_length("context").alias("size"))
    joined = joined.join(verdict, (F.col("key") == F.col("key2")) & (F.col("check") == F.col("check2")))
    full = F.expr(f"shiftleft(1L, size - {LENGTH - 1}) - 1L")
    joined = joined.select("doc_id", "lo", F.when(F.col("doc_id") > F.col("first"), full).otherwise(F.col("starts")).alias("starts"))
    found = materialize(joined.where("starts <> 0"), "substring-covered")
    discard(cut, verdict)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every document.

    ``kept`` is the text without its covered bytes (binary, as a cut may split a
    character). Null text counts as empty, texts below ``LENGTH`` bytes and rows
    with a null doc_id are kept whole, rows that share a doc_id are one document
    to each other. An empty table gives no rows; other columns are ignored.
    """
    found = covered_contexts(docs)
    per = found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("lo", "starts")).alias("hits"))
    joined = docs.select("doc_id", "text").join(per, docs.doc_id == per.d, "left").select("doc_id", "text", "hits.lo", "hits.starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple] = []
                for text, los, starts in zip(_blob(part.column(1)), part.column(2), part.column(3), strict=True):
                    removed = spans = 0
                    kept = text
                    if los.is_valid:
                        edge = np.zeros(len(text) + 1, np.int64)
                        bits = (starts.values.to_numpy()[:, None] >> np.arange(REACH + 1)) & 1
                        hit = np.unique((los.values.to_numpy()[:, None] + np.arange(REACH + 1))[bits.astype(bool)])
                        hit = hit[hit + LENGTH <= len(text)]
                        edge[hit] += 1
                        edge[hit + LENGTH] -= 1
                        cover = np.cumsum(edge[:-1]) > 0
                        removed = int(cover.sum())
                        spans = int((cover & ~np.r_[False, cover[:-1]]).sum())
                        kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                    rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
