"""The n-gram join against all pairs of small tables, and its trie against set intersections."""

import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import ngram_join as nj


def shingles(text: str | None) -> set:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def components(rows: list[tuple]) -> dict:
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    of = {i: i for i, _ in sets}

    def top(i: int) -> int:
        while of[i] != i:
            i = of[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                of[hi] = lo
    return {i: top(i) for i in of}


def texts(n: int, seed: int) -> list[tuple]:
    """Families of near copies that drift, copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["w%d" % rng.randrange(3000), "É", "the", "Of"])
    passage = [word() for _ in range(40)]
    rows, base = [], [word() for _ in range(100)]
    for i in range(n):
        kind = rng.randrange(8)
        if kind < 4:
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                text[rng.randrange(len(text))] = word()
            if kind == 0:
                base = text if rng.random() < 0.8 else [word() for _ in range(rng.choice([6, 30, 100, 400]))]
        elif kind == 4:
            text = [word() for _ in range(rng.randrange(1, 8))]
        elif kind == 5:
            text = passage + [word() for _ in range(rng.randrange(1, 60))]
        else:
            text = [word() for _ in range(rng.randrange(0, 120))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows + [(n, ""), (n + 1, None), (n + 2, rows[3][1]), (n + 3, rows[3][1].upper()), (n + 4, "a b c"), (None, rows[3][1])]


def check(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n long, class string")
    got = nj.ngram_components(df.repartition(3)).collect()
    assert len(got) == len(rows)
    want = components(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, want.get(i)) for i, _ in rows}
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t))) for i, t in rows)


def test_components_equal_all_pairs(spark):
    check(spark, texts(400, 1))


def test_components_with_blocks_of_few_sets(spark, monkeypatch):
    """Every bucket and class is cut into blocks, and two rows have one id."""
    monkeypatch.setattr(nj, "BUCKET_SETS", 3)
    monkeypatch.setattr(nj, "CLASS_WORDS", 400)
    rows = texts(200, 2)
    check(spark, [*rows, (5, rows[11][1]), (5, rows[11][1]), (7, "x y z")])


def test_sets_are_the_shingles():
    """Counts and overlaps of hashed sets, over slices and nulls, in an array that starts later."""
    rows = ["x", *[t for _, t in texts(300, 3)], "long " * 9000, "a" * 70_000, "", None, "\n", "A b\tc  d e", "a B c\x0bd E"]
    column = pa.array(rows).slice(1)
    got = list(nj.Shingler().sets(column))
    assert [len(g) for g in got] == [len(shingles(t)) for t in rows[1:]]
    assert np.array_equal(got[-1], got[-2])
    for i in range(0, 280, 7):
        assert len(np.intersect1d(got[i], got[i + 1])) == len(shingles(rows[i + 1]) & shingles(rows[i + 2]))


def test_maps_turn_down_no_link():
    rng = np.random.default_rng(9)
    for n in (1, 5, 40, 300, 3000):
        base = rng.integers(1, 2**58, n).astype(np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, max(1, n - k), replace=False), rng.integers(1, 2**58, k).astype(np.uint64)]) for k in (0, 0, n // 30, n // 20, n // 12, n // 2)]
        bucket = nj.Bucket(list(range(len(sets))), np.array([len(s) for s in sets]), [nj.bit_map(s).tobytes() for s in sets])
        for x in range(len(sets)):
            k = np.array([len(np.intersect1d(sets[x], s)) for s in sets])
            linked = {y for y in range(len(sets)) if 100 * k[y] >= 85 * (len(sets[x]) + len(sets[y]) - k[y])}
            assert linked <= set(bucket.alike(x, np.arange(len(sets))).tolist())


def test_empty_table(spark):
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_finds_all_linked_sets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        pool = np.sort(rng.choice(2**40, 60, replace=False).astype(np.uint64))
        base = rng.choice(pool, 25, replace=False)
        sets = []
        for _ in range(30):
            s = np.unique(np.concatenate([base[rng.random(25) < rng.choice([0.9, 0.97, 1.0])], rng.choice(pool, rng.integers(0, 4))]))
            sets.append(s if len(s) else pool[:1])
        sets += sets[:3]
        trie = nj.Trie(sets)
        gone = set(rng.choice(len(sets), 5, replace=False).tolist())
        for i in gone:
            trie.remove(i)
        for x in sets[::4]:
            k = [len(np.intersect1d(x, y)) for y in sets]
            want = {i for i, y in enumerate(sets) if i not in gone and 100 * k[i] >= 85 * (len(x) + len(y) - k[i])}
            assert set(trie.linked(x)) == want
