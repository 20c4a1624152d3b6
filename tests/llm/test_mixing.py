"""The mix moves each text twice: to its place, and to its block."""

import random
import re

from tallyforge.llm import mixing


def test_texts_are_shuffled_twice_and_not_as_word_arrays(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.choice([0, 5, 300]))), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(7, rows[7][1], rows[7][2]), (None, "no id", "a"), (50, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.mix_sources(docs, block_words=16)
    plan = spark._jvm.PythonSQLUtils.explainString(mix._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning", plan)
    assert not any(re.search(r"\b(words|first)#", m) for m in moved)
    assert sum(bool(re.search(r"\b(text|part|parts|buf)#", m)) for m in moved) == 2
    out = mix.collect()
    texts: dict = {}
    for i, t, s in rows:
        texts.setdefault((i, s), []).append(t or "")
    for r in out:  # a block is made of runs of its documents, in order
        words = r.text.split(" ")
        assert len(words) <= 16 and len(r.doc_ids) >= 1
        known = {w for i in r.doc_ids for t in texts[(i, r.source)] for w in t.split(" ")}
        assert set(words) <= known
