"""A large group of near copies gives its candidate pairs once, not once for each sketch."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import near_dedup


def test_a_group_gives_about_a_pair_a_text(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.04 else f"e{rng.random()}" for w in base) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = near_dedup.sketch_documents(docs).cache()
    links = near_dedup.candidate_links(sketched, docs.select(F.col("doc_id").alias("rep")))
    assert links.count() <= 3 * len(texts)
    assert {r.class_id for r in near_dedup.near_classes(docs).collect()} == {0}


def test_class_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(2, 14))
        near = rng.random((n, n)) < 0.15
        near |= near.T
        classes = rng.integers(0, 4, n)

        class Fake:
            ids = list(range(n))

            def alike(self, x, others):
                return others[near[x][others]]

        def groups(pairs):
            label = list(range(n))
            for a, b in pairs:
                label = [label[a] if v == label[b] else v for v in label]
            return [[label[i] == label[j] for j in range(n)] for i in range(n)]

        inside = [(i, j) for i in range(n) for j in range(n) if classes[i] == classes[j]]
        least = {c: int(np.flatnonzero(classes == c)[0]) for c in set(classes.tolist())}
        classes = np.array([least[c] for c in classes.tolist()])
        found = near_dedup.class_links(Fake(), classes)
        assert len(found) < len(set(classes.tolist())) + (not found)
        assert groups(inside + found) == groups(inside + [(i, j) for i in range(n) for j in range(n) if near[i, j]])


def test_texts_with_a_common_passage_are_hardly_aligned(monkeypatch):
    """Bit maps leave many pairs of texts that share a passage; the words shared turn down nearly all of them before alignment."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**62, 120)
    texts = [np.concatenate([passage, rng.integers(0, 2**62, int(rng.integers(40, 60)))]) for _ in range(200)]
    texts += [np.r_[t[:150], rng.integers(0, 2**62, 1), t[151:]] for t in texts[:20]]
    asked = []
    near = near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda a, b: asked.append(1) or near(a, b))
    links = near_dedup.aligned_links(list(range(len(texts))), texts)
    assert sorted(links) == [(i, 200 + i) for i in range(20)]
    assert len(asked) < 100


def test_aligned_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 30, int(n)) for n in rng.integers(0, 60, 12)]
    texts = base + [np.where(rng.random(len(t)) < 0.15, rng.integers(0, 30, len(t)), t) for t in base for _ in range(4)]
    whole = near_dedup.aligned_links(list(range(len(texts))), texts)
    every = [(i, j) for i in range(len(texts)) for j in range(i) if len(texts[i]) and near_dedup.similar(texts[i], texts[j])]
    every += [(i, j) for i in range(len(texts)) for j in range(i) if not len(texts[i]) and not len(texts[j])]

    def classes(links):
        at = list(range(len(texts)))
        for a, b in links:
            at = [min(at[a], at[b]) if c in (at[a], at[b]) else c for c in at]
        return at

    assert classes(whole) == classes(every)


def test_alignment_that_ends_early_agrees_with_the_plain_one():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = rng.integers(0, 6, int(rng.integers(1, 40)))
        b = np.where(rng.random(len(a)) < rng.random(), rng.integers(0, 6, len(a)), a)
        b = np.delete(b, rng.integers(0, len(b), int(rng.integers(0, 3))))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            last, row = row, [i]
            for j, y in enumerate(b.tolist(), 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        most = int(rng.integers(0, 30))
        assert min(near_dedup.edit_distance(a, b, most), most + 1) == min(row[-1], most + 1)
