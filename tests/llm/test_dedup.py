"""Near, line and substring dedup against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, extra string"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows: list[tuple] = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 12, 40, 150]))
        kind = rng.random()
        if rows and kind < 0.2:
            words = rng.choice(rows)[1].split(" ")
        elif rows and kind < 0.5:
            words = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in rng.choice(rows)[1].split(" ")]
        elif kind < 0.7:
            words = words[:20] + passage.split() + words[20:]
        lines = " ".join(words)
        rows.append((i, re.sub(r" (w\d*7) ", r" \1\n", lines), "x"))
    return rows


EDGES = [(900, None, "a"), (901, "", "b"), (902, "!!!", None), (None, "some text without an id at all here", "c"), (903, "ünïcode äöü", "d"), (903, "ünïcode äöü", "d")]


def word_distance(a: list[str], b: list[str]) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def classes(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    words = {i: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for i, t, _ in rows}
    links = []
    for a in words:
        for b in words:
            if a < b:
                longest = max(len(words[a]), len(words[b]))
                if word_distance(words[a], words[b]) <= 0.2 * longest:
                    links.append((a, b))
    want = classes(list(words), links)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
    kept = {r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(want.values())


def test_near_classes_edges(spark):
    got = near_dedup.near_classes(spark.createDataFrame(EDGES, DOCS)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == [(900, 900), (901, 901), (902, 902), (903, 903), (903, 903)]
    assert near_dedup.near_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert near_dedup.keep_one(spark.createDataFrame(EDGES, DOCS)).columns == ["doc_id", "text", "extra"]


def brute_spans(rows: list[tuple]) -> dict:
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t, _ in rows if i is not None}
    for i in sorted(data):
        for s in range(len(data[i]) - 49):
            first.setdefault(data[i][s : s + 50], i)
    out = {}
    for i, t in data.items():
        cover = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                cover[s : s + 50] = True
        cover = cover[:-1]
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out[i] = (len(t), int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("contexts", [4096, 2])
def test_substrings_equal_brute_force(spark, contexts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CONTEXTS", contexts)
    monkeypatch.setattr(substring_dedup, "SORT_BYTES", 2000)
    rows = corpus(3, 80) + [(500, "a" * 300, "x"), (501, "b" + "a" * 120, "x"), (502, "é" * 60, "x"), (503, "x" + "é" * 60, "x"), *EDGES]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_spans(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffix_grouping():
    rng = random.Random(4)
    for _ in range(300):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 40))] + [0]
        assert substring_dedup.grouped_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])


def norm(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", "", line.lower())).strip()


@pytest.mark.parametrize("seed", [5, 6])
def test_lines_equal_brute_force(spark, seed):
    rows = corpus(seed, 40)
    frame = spark.createDataFrame(rows, DOCS)
    texts = {hash(n): n for _, t, _ in rows for n in map(norm, t.split("\n")) if n}
    links = []
    for a in texts:
        for b in texts:
            if a < b and word_distance(list(texts[a]), list(texts[b])) <= 0.2 * max(len(texts[a]), len(texts[b])):
                links.append((a, b))
    group = classes(list(texts), links)
    seen, want = set(), {}
    for i, t, _ in rows:
        kept = []
        for line in t.split("\n"):
            g = group[hash(norm(line))] if norm(line) else None
            if g is None or g not in seen:
                kept.append(line)
                seen.add(g)
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, drop_emptied=False).collect()}
    assert all(set(want[i].split("\n")) <= set(got[i].split("\n")) for i in want)  # nothing else goes
    lines = sum(len(t.split("\n")) for _, t, _ in rows)
    due, left = (lines - sum(len(x.split("\n")) for x in side.values()) for side in (want, got))
    assert left >= 0.9 * due > 0  # lines whose words nearly all carry typos may stay


def test_line_edges(spark):
    frame = spark.createDataFrame([*EDGES, (904, "Same line here.\nsame LINE, here\n\n!!\nother", "e")], DOCS)
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame).collect()}
    assert (900, None) in got and (901, "") in got and (902, "!!!") in got
    assert (904, "Same line here.\n\n!!\nother") in got
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_counts_every_bit(spark):
    """Against a count by hand, on lines of one word and of many."""
    rng = random.Random(7)
    lines = [(i, " ".join("w%d" % rng.randrange(500) for _ in range(n))) for i, n in enumerate((1, 2, 5, 40, 3000))]
    frame = spark.createDataFrame(lines, "id long, norm string")
    words = {r.id: r.h for r in frame.select("id", F.transform(line_dedup.ranked_words(F.col("norm")), lambda v: F.xxhash64(v)).alias("h")).collect()}
    for r in line_dedup.simhashes(frame).collect():
        hashes = [h & (2**64 - 1) for h in words[r.id]]
        assert r.n_words == len(hashes) == len(set(lines[r.id][1].split(" ")))
        assert r.simhash & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_star_rounds_lose_no_link(spark, monkeypatch):
    """One bucket of many members with several classes: stars, refining and the rest find them all."""
    from tallyforge.llm import shared

    members = spark.createDataFrame([(b, i, 1) for b in (1, 2) for i in range(40)], "bucket long, id long, size long")

    def verify(pairs):
        return pairs.where("a % 7 = b % 7")

    links = shared.link_buckets(members, verify, lambda rest: rest, "t", 0.8, small=4)
    got = {r.id: r["class"] for r in shared.connected_components(links, "t").collect()}
    assert got == {i: i % 7 for i in range(40)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_items_lose_no_pair(spark, seed):
    """Every pair of a crowd within the edits is among the pairs joined on rare words."""
    from tallyforge.llm import shared

    rng = random.Random(seed)
    passage = ["p%d" % i for i in range(30)]
    texts = {}
    for i in range(40):
        words = [w if rng.random() > 0.1 else "v%d" % rng.randrange(200) for w in texts[rng.randrange(i)]] if i and rng.random() < 0.6 else passage + ["v%d" % rng.randrange(200) for _ in range(rng.randrange(8, 25))]
        texts[i] = words
    crowd = spark.createDataFrame([(1, i, i, len(w), 0) for i, w in texts.items()], "bucket long, id long, class long, size int, centre long")
    words = spark.createDataFrame([(i, w) for i, ws in texts.items() for w in set(ws)], "id long, item string")
    got = {(r.a, r.b) for r in shared.rare_item_pairs(crowd, lambda ids: words.join(ids, "id", "left_semi"), 0.8, "t").collect()}
    number = {w: k for k, w in enumerate(sorted({w for ws in texts.values() for w in ws}))}
    codes = {i: np.array([number[w] for w in ws], np.int64) for i, ws in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and near_dedup.similar(codes[a], codes[b])}
    assert want and want <= got


@pytest.mark.parametrize("by_items", [False, True])
def test_crowded_bucket_links_left_over_to_joined(spark, by_items):
    """Similarity that is not transitive: ids unlike the centre meet ids that joined it, in the one bucket they share."""
    from tallyforge.llm import shared

    ids = [2 * i for i in range(10)] + [100 + 2 * i for i in range(10)]  # two chains of neighbours
    members = spark.createDataFrame([(2, i, 10) for i in ids], "bucket long, id long, size long")

    def verify(pairs):
        return pairs.where("b - a <= 6")

    def items(some):  # an id holds ten items, and shares at least eight with ids up to six away
        return some.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(F.col("id") / 20) * 100 + k)).alias("item"))

    links = shared.link_buckets(members, verify, lambda rest: rest, "t", 0.8, small=4, items=items if by_items else None)
    got = {r.id: r["class"] for r in shared.connected_components(links, "t").collect()}
    assert got == {i: 0 if i < 100 else 100 for i in ids}


@pytest.mark.parametrize("edits", [0.1, 0.15, 0.2])
def test_sketches_meet_down_to_the_similarity(edits):
    """Pairs by edit similarity alone: spread substitutions, insertions and deletions up to a fifth of the words."""
    rng = random.Random(8)
    met = total = 0
    for n in (20, 60, 200) * 40:
        a = [rng.getrandbits(40) for _ in range(n)]
        b = list(a)
        for _ in range(int(n * edits)):
            at, kind = rng.randrange(len(b)), rng.random()
            b[at : at + (kind < 0.9)] = [rng.getrandbits(40)] if kind < 0.8 or kind >= 0.9 else []
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if near_dedup.similar(a, b):
            total += 1
            met += bool((near_dedup.order_sketches(a) == near_dedup.order_sketches(b)).any())
    assert total >= 100 and met >= (0.9 if edits == 0.2 else 0.97) * total


def test_lines_meet_by_edit_similarity_alone(spark):
    """Brute force without a bound on SimHash bits: lines with words replaced, and short lines with typos."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 11)))
    lines = []
    for n in (3, 6, 10, 15, 20) * 3:
        line = [word() for _ in range(n)]
        lines += [" ".join(line)] + [" ".join(w if i not in gone else word() for i, w in enumerate(line)) for gone in (rng.sample(range(n), max(1, n // 6)) for _ in range(2))]
    for _ in range(8):
        line = "".join(rng.choices("abcdefgh ", k=rng.randrange(7, 13))).strip() + "z"
        at = rng.randrange(1, len(line) - 1)
        lines += [line, line[:at] + "y" + line[at + 1 :]]
    lines = [norm(line) for line in lines]
    links = [(a, b) for a in lines for b in lines if a < b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and word_distance(list(a), list(b)) <= 0.2 * max(len(a), len(b))]
    group, seen, want = classes(lines, links), set(), set()
    for i, line in enumerate(lines):
        if group[line] not in seen:
            want.add(i)
            seen.add(group[line])
    frame = spark.createDataFrame([(i, line, "x") for i, line in enumerate(lines)], DOCS)
    assert links and {r.doc_id for r in line_dedup.dedup_lines(frame).collect()} == want


@pytest.mark.parametrize("size", [3, 25])
def test_links_do_not_depend_on_how_crowded_a_bucket_is(spark, size):
    """Ten similar pairs, one letter changed in each short word, in one bucket alone and among unlike lines; short lines, and lines compared by words."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    head = " ".join(word(13) for _ in range(4 if size == 3 else 24))
    lines = []
    for _ in range(10):
        short = [word(3) for _ in range(8)]
        lines += [" ".join([head, *short]), " ".join([head, *[w[:2] + "0" for w in short]])] if size == 3 else [" ".join([head, *short]), " ".join([head, *[word(3) for _ in short[:6]], *short[6:]])]
    fill = [" ".join([head, *[word(9) for _ in range(8 if size == 3 else 40)]]) for _ in range(30)]
    frame = lambda ls: spark.createDataFrame([(i, line, "x") for i, line in enumerate(ls)], DOCS)
    pairs = [{r.doc_id for r in line_dedup.dedup_lines(frame(lines[i : i + 2])).collect()} for i in (0, 2)]
    assert pairs == [{0}, {0}]
    kept = {r.doc_id for r in line_dedup.dedup_lines(frame(lines + fill)).collect()}
    assert not kept & set(range(1, 20, 2)) and kept >= set(range(20, 50))


@pytest.mark.parametrize("size", [3, 100000])
def test_lines_with_typos_in_every_word_are_linked(spark, monkeypatch, size):
    """Exact line dedup against brute force: letters replaced all over, short lines, and lines compared by words; in one block and in many."""
    rng = random.Random(21)
    monkeypatch.setattr(line_dedup, "BLOCK", size)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))
    lines = []
    for n, share in ((3, 0.15), (6, 0.1), (6, 0.18), (12, 0.1), (12, 0.18), (20, 0.18)) * 2:
        line = " ".join(word() for _ in range(n))
        lines += [line, "".join(rng.choice("abcdefghij") if c != " " and rng.random() < share else c for c in line)]
    for n in (60, 80):
        line = sorted((word() for _ in range(n)), key=len, reverse=True)
        lines += [" ".join(line), " ".join(["0" + w[1:] if i < n // 6 else w for i, w in enumerate(line)])]
    rng.shuffle(lines)
    mark = lambda a, b: (list(a), list(b)) if max(len(a), len(b)) <= line_dedup.CHARS else (a.split(), b.split())
    near = lambda a, b: word_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    links = [(a, b) for a in lines for b in lines if a < b and near(*mark(a, b))]
    group, seen, want = classes(lines, links), set(), set()
    for i, line in enumerate(lines):
        if group[line] not in seen:
            want.add(i)
            seen.add(group[line])
    frame = spark.createDataFrame([(i, line, "x") for i, line in enumerate(lines)], DOCS)
    assert len(links) >= 10 and {r.doc_id for r in line_dedup.dedup_lines(frame, exact=True).collect()} == want
    assert {r.doc_id for r in line_dedup.line_report(frame).where("kept_chars > 0").collect()} == want


def test_components_of_a_long_chain_take_few_rows(spark, monkeypatch):
    from tallyforge.llm import shared

    written = []
    real = shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df, tag: written.append(real(df, tag)) or written[-1])
    monkeypatch.setattr(shared, "discard", lambda *tables: None)
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 50)], "a long, b long")
    got = {r.id: r["class"] for r in shared.connected_components(edges, "t").collect()}
    assert got == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(50)}
    assert sum(t.count() for t in written) < 8 * 450


def test_contexts_are_cut_to_what_others_have():
    """Only bytes around the anchor that another context has are sorted, and contexts that are then equal fold."""
    anchor = bytes(range(100, 100 + substring_dedup.GRAM))
    inner = b"abcdefghijklm" + anchor + b"nopqrstuvwxyzABC"
    parts = [(7, 14, b"1" + inner + b"55", 4), (7, 15, b"22" + inner + b"6", 9), (7, 3, b"klm" + anchor + b"z" * 23, 2)]
    cut, whole = substring_dedup.sharing(parts)
    assert cut == [(7, 13, inner, 4)]
    assert whole == [(0, 1, parts[0]), (0, 2, parts[1])]
    rng = random.Random(8)
    for _ in range(200):
        strings = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 8)))
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max([same(a, b) for j, b in enumerate(strings) if j != i], default=0) for i, a in enumerate(strings)]
        assert substring_dedup.common(strings) == want


def test_exact_lines_are_not_shuffled_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 30)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=100)) for _ in range(299)]
    texts.append("#" * 10 + texts[7][10:])
    maps = [f"m{q}" for q in range(line_dedup.MAP_LONGS)]
    rows = spark.createDataFrame([(i, i, 100, 100, t, *[0] * len(maps)) for i, t in enumerate(texts)], "id long, class long, size int, n int, text string, " + ", ".join(m + " long" for m in maps))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    found = line_dedup.cell_pairs(rows, 4, F.lit(True)).collect()
    assert [(r.a, r.b) for r in found] == [(7, 299)]
    assert written() - before < 200_000


def test_rounds_hold_every_block_once():
    counts = {3: 10, 4: 9000, 5: 4000, 9: 1}
    blocks = {band: -(-n // line_dedup.BLOCK) for band, n in counts.items()}
    dealt = line_dedup.rounds(counts, blocks)
    assert sorted(b for some in dealt for b in some) == [(band, at) for band in sorted(blocks) for at in range(blocks[band])]
    assert all(len(some) == 1 or sum(counts[b] / blocks[b] for b, _ in some) <= line_dedup.BLOCK for some in dealt)


def test_texts_that_share_a_passage_alone_are_no_candidates(spark):
    """Unlike texts of one bucket must not pass by chance: such links grow with the square of the bucket and connect all of it."""
    rng = random.Random(31)
    passage = ["p%d" % i for i in range(12)]
    rows = []
    for i in range(300):
        own = ["v%d" % rng.randrange(3000) for _ in range(rng.choice([30, 60, 120, 250]))]
        rows.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]), "x"))
    rows.append((1000, rows[7][1] + " other", "x"))
    made = near_dedup.sketch_documents(spark.createDataFrame(rows, DOCS)).select("doc_id", "n", "map").collect()
    bucket = near_dedup.TextBucket([r.doc_id for r in made], np.array([r.n for r in made]), [bytes(r.map) for r in made])
    assert bucket.links() == [(7, 1000)]


def test_letter_rings_turn_down_unlike_lines_and_no_similar_one(spark):
    """Rings differ by no more than letters do, whatever the counts; lines of other words are mostly told apart by them."""
    rng = random.Random(41)
    letters = "etaoinshrdlu" * 6 + "cmfwypvbgk" * 2 + "jqxz019äé東" + " " * 12
    line = lambda n: "".join(rng.choices(letters, k=n))
    pairs = []
    for n in (1, 2, 5, 30, 90, 255):
        for _ in range(12):
            a = line(n)
            b = list(a)
            for _ in range(rng.randrange(1, n // 5 + 2)):
                at, kind = rng.randrange(len(b) + 1), rng.random()
                b[at : at + (kind < 0.7)] = [rng.choice(letters)] if kind < 0.4 or kind >= 0.7 else []
            pairs.append((a, "".join(b) or "x", 0))
    pairs += [("e" * n, "e" * m, 0) for n, m in ((0, 16), (15, 17), (16, 40), (31, 64), (3, 250))]
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=range(26, 0, -1), k=rng.randrange(2, 10)))
    pairs += [(" ".join(word() for _ in range(8))[:40], " ".join(word() for _ in range(8))[:40], 1) for _ in range(100)]
    frame = spark.createDataFrame(pairs, "a string, b string, kind int")
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(line_dedup.letter_rings(F.col("a")), line_dedup.letter_rings(F.col("b")), strict=True)), F.lit(0))
    down = 0
    for r in frame.select("a", "b", "kind", apart.alias("apart")).collect():
        bound = r.apart + abs(len(r.a) - len(r.b))
        assert bound <= 2 * word_distance(list(r.a), list(r.b))
        down += r.kind and bound > 2 * (max(len(r.a), len(r.b)) // 5)
    assert down >= 60


def test_pipeline_removes_lines_that_share_no_key(spark):
    """Similar lines with a typo in every longer word have no key in common, and the pipeline's stage must still drop the later one."""
    import corpus_pipeline

    lines = ["harvest wagons rolled slowly toward the distant valley", "harvezt wagonz rolxed slowxy towarz the distanz valleq"]
    assert word_distance(list(lines[0]), list(lines[1])) <= 0.2 * len(lines[0])
    frame = spark.createDataFrame([(i, line, "x") for i, line in enumerate(lines)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.drop_lines(spark, frame, "").collect()] == [0]
    assert line_dedup.dedup_lines(frame, exact=False).count() == 2
