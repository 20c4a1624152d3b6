"""Chat round trip, mixing totals and decontamination edges on small frames."""

import hashlib

from tallyforge.llm import chat_format, decontaminate, mixing, warc


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<b>\\l"), (1, 1, "user", ""), (1, 2, "assistant", "<end>ok"), (1, 2, "assistant", "<end>ok"), (2, None, None, None), (None, 0, "system", "x")]
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = "user\na<b>\\l\nuser\n\nassistant\n<end>ok\nassistant\n<end>ok\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"<end>ok<end>ok").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and None in got


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 30)), ["a", "b", None][i % 3]) for i in range(300)] + [(900, None, "a"), (901, "", "b")]
    out = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] for r in out)
    for s in ("a", "b", None):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 32
    assert sum({r.source: r.target for r in out}.values()) - 1.5 * sum(r["size"] for r in out) < 1e-6


def test_decontamination_edges(spark):
    text = "One two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, None), (3, ""), (None, text), (4, "short item")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, "SHORT, item!"), (9, None), (10, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontamination_report(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[4].n_hit, got[None].n_hit, got[2].n_words) == (11, 1, 2, 11, 0)
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {2, 3}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}[1] == "x y"


def test_warc_revisits(spark):
    pages = spark.createDataFrame([(5, "u", "p\r\n\r\nWARC/1.1"), (3, "v", "p\r\n\r\nWARC/1.1"), (4, None, None), (6, "w", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_report(pages).collect()}
    assert got == {3: (13, "response", None), 5: (13, "revisit", 3), 4: (0, "response", None), 6: (0, "revisit", 4)}
