"""CRF, toxicity, HTML extraction, quality rules, mixing and the pipeline against plain Python on small fixtures."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import crf, decontaminate, html_text, mixing, near_dedup, quality_rules, toxicity


def test_crf_equals_enumeration():
    """Marginals and Viterbi of two chains against all labellings."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        starts = np.array([0, 4, 4, 9])
        e, moves = rng.normal(size=9), rng.normal(size=(2, 2))
        model, chains = crf.Model(np.zeros(1), moves), crf.Chains(starts)
        p, y = model.marginals(e, chains), model.viterbi(e, chains)
        for a, b in ((0, 4), (4, 9)):
            labellings = list(itertools.product((0, 1), repeat=b - a))
            score = np.array([sum(e[a + i] * v for i, v in enumerate(z)) + sum(moves[z[i - 1], z[i]] for i in range(1, len(z))) for z in labellings])
            weight = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
            assert p[a:b] == pytest.approx(weight @ np.array(labellings, float))
            assert tuple(y[a:b].astype(int)) == labellings[int(score.argmax())]


def toxic_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    clean, bad = ["word%d" % i for i in range(200)], ["zork", "blarg", "fnord"]
    rows = []
    for i in range(n):
        words = rng.choices(clean, k=rng.choice([5, 30, 80]))
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=2)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(300, 1)
    more = [(1000, None), (1001, ""), (1002, "word1 " * 60_000), (0, rows[0][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) + len(more)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in toxicity.remove_toxic(docs, labels).collect()}
    assert {1000, 1001, 1002} <= kept
    spans = {r.doc_id: r.spans for r in toxicity.toxic_spans(docs, toxicity.fit_tagger(docs, labels)).collect()}
    text = dict(docs.collect())[4]
    assert any(text[s.lo : s.hi] in ("zork", "blarg", "fnord") or set(text[s.lo : s.hi].split()) <= {"zork", "blarg", "fnord"} for s in spans[4])


def test_toxicity_without_evidence_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some text", 7), (2, None, 8)], "doc_id long, text string, toxicity int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.remove_toxic(docs, none)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "some text", 7), (2, None, 8)]
    assert {r.predicted for r in toxicity.toxicity_report(docs, none).collect()} == {0}
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0


def page(i: int, article: str = "article") -> tuple[str, str]:
    rng = random.Random(i)
    say = lambda k: " ".join(rng.choices(["river", "stone", "walks", "over", "light", "and", "the"], k=k)).capitalize() + "."
    body = [say(20), say(35), say(12)]
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choices(["home", "news", "about", "shop"], k=5))
    html = f'<html><head><title>{say(3)}</title><style>p{{}}</style></head><body class="has-sidebar"><nav><ul>{nav}</ul></nav><{article}>' + "".join(f"<p>{b} &amp;\n more</p>" for b in body)
    html += f'</{article}><aside class="promo"><p>{say(6)}</p></aside><section id="comments"><p>{say(9)}</p></section><script>var a = "<p>no</p>"</script><footer>&copy; {say(4)}</footer></body></html>'
    return html, "\n".join(f"{b} & more" for b in body)


def test_html_pages_with_and_without_article(spark):
    pages = [page(i) for i in range(60)]
    hidden = [page(100 + i, "div") for i in range(30)]
    rows = [(i, "u", h) for i, (h, _) in enumerate(pages)] + [(100 + i, "u", h) for i, (h, _) in enumerate(hidden)] + [(500, None, None), (501, "u", ""), (502, "u", "<div>x" * 3000), (0, "u", pages[0][0])]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(r.n_chars == len(r.text) for r in got) and text[500] == text[501] == ""
    assert all(text[i] == t for i, (_, t) in enumerate(pages))
    assert sum(text[100 + i] == t for i, (_, t) in enumerate(hidden)) >= 27
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_blocks_of_markup():
    blocks = html_text.leaf_blocks("<p>a<p>b <b>c</b><br>d<!-- x --><div>e &lt;f</div><style>no</style>")
    assert [b.text for b in blocks] == ["a", "b c d", "e <f"]
    said = lambda h: [b.said for b in html_text.leaf_blocks(h)]
    assert said("<div class=sidebar-left><article>t</article></div>") == ["main"]
    assert said("<div class=comments><article>t</article></div>") == ["aside"]
    assert said("<article><div class=ad>t</div></article>") == ["aside"]
    assert said("<nav><article>t</article></nav>") == ["aside"]


def base_counts(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_base_counts_and_rules(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n\t", "a b\na b\nc", "é#* $|\x0b x", "one two three four five six seven eight " * 4]
    for _ in range(40):
        words = [rng.choice("abcde") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        texts.append(re.sub(r" a+ ", "\n", " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")], "doc_id long, text string, kept string")
    got = quality_rules.quality_report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, chars, symbols, lines, repeat = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), texts[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and r.kept == (not r.base_failed)


def test_rules_need_two_conditions():
    """Rejected are only rows with both a high and b low; the list must find the conjunction and prune the rest."""
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.3)
    rules = quality_rules.learn(x, bad, ["a", "b", "noise"])
    hit = np.zeros(len(x), bool)
    for rule in rules.rules:
        assert {n for n, _, _ in rule} >= {"a", "b"}
        hit |= rules.rejects(x, ["a", "b", "noise"], rule)
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(len(x), bool), ["a", "b", "noise"]).rules == []


def test_mix_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(["w"] * rng.choice([0, 3, 400]))) for i in range(120)] + [(500, "a", None), (7, "b", "w w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    size, taken = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    weight, total = {"a": 3, "b": 1, None: 2}, 1.5 * sum(size.values())
    target, open_ = {}, set(size)
    while open_:  # sources above twice their size stop there, the rest share by weight
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * size[s] for s in over}
        open_ -= over
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in size)
    empty = docs.limit(0)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 1, 2, 3, 4)], "doc_id long, text string, _id int, _gone int, spans int, _spans int")
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items, "spans")
    assert out.columns == docs.columns and out.first().text == "one "
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_pipeline_stages(spark):
    """Each stage on a small corpus: what it must drop goes, clean documents stay, columns stay."""
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda k: "\n".join(" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 11))) for _ in range(12)) for _ in range(k))
    rows = [(r[0], r[1], "en", "src%d" % (r[0] % 3)) for r in toxic_rows(80, 2)] + [(200 + i, text(6), "en", "src1") for i in range(20)]
    near = rows[-1][1].split(" ")
    near[3] = "changed"
    rows += [(300, " ".join(near), "en", "src2"), (301, rows[-2][1], "en", "src0"), (302, None, "en", None)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows.append((303, text(4) + "\n" + leak, "en", "src1"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = spark.createDataFrame([(r[0], 1, r[2]) for r in toxic_rows(80, 2)], "doc_id long, quality int, toxic int")
    import tempfile

    sf = tempfile.mkdtemp(prefix="spark-pipeline-")
    docs.write.parquet(f"{sf}/documents.parquet")
    folder.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    calm = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert calm.columns == docs.columns and {r[0] for r in rows if r[0] >= 200} <= ids(calm) and 0 not in ids(calm)
    lines = corpus_pipeline.drop_lines(spark, docs, sf)
    assert lines.columns == docs.columns and 301 not in ids(lines) and 302 in ids(lines)
    one = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert one.columns == docs.columns and not {300, 301} & ids(one) and {219, 302} <= ids(one)
    safe = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert safe.columns == docs.columns and ids(docs) - ids(safe) == {303}
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.select(F.explode("doc_ids")).distinct().count() > 50
