"""Conversation repair against a search over all edits, and whitening against NumPy's eigenvectors."""

import hashlib
import heapq
import random
import re
import zlib
from decimal import Decimal

import numpy as np
import pytest

from tallyforge.llm import chat_repair, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]")
STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def search(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """Cheapest, then least repair of (role, text, fault) rows, by best-first search over whole audits."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, i, before, out = heapq.heappop(heap)
        if i == len(rows) and before in ("", "a"):
            return cost, audit, list(out)
        if (i, before) in seen and (cost, audit, i, before) in seen:
            continue
        seen |= {(i, before), (cost, audit, i, before)}
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, before, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in STATES[before]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for made in ("user", "assistant"):
                    if made[0] in STATES[before]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, made[0], (*out, f"{made}:{text}")))
        if cost <= 4 * len(rows):
            for made in ("user", "assistant"):
                if made[0] in STATES[before]:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, made[0], (*out, f"{made}:")))


def fault_of(rows: list[tuple[str, str]], i: int) -> str:
    role, text = rows[i]
    found = WORD.findall(text)
    if not found:
        return "blank"
    if (role, text) in rows[:i]:
        return "duplicate"
    return "" if found[-1] in ".!?" else "truncated"


def expected(rows: list[tuple]) -> dict:
    """The report, row by row in plain Python, of (conv_id, turn, role, text) rows."""
    after = {}
    for conv, turn, role, text in rows:
        mine = after.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, mine in after.items():
        mine.sort()
        turns = [t for known, t, *_ in mine if known]
        pairs = [(r, t) for *_, r, t in mine]
        faults = [fault_of(pairs, i) for i in range(len(pairs))]
        cost, audit, repaired = search([(r, t, f) for (r, t), f in zip(pairs, faults, strict=True)])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def chats(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Hi.", "Ok!", "why?", "no end", " \n", None, "Hi.", "é. ", "a. "])
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.randrange(2) * conv % 3, role, text))
    return rows


def test_repair_report_equals_search(spark):
    rows = chats(250, 5) + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (900, -4, "user", "x."), (900, 9, "assistant", "y.")]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, audit int, symbol string")
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.repair_report(df).collect()}
    assert got == expected(rows)


def test_very_long_texts_and_one_huge_conversation(spark):
    rows = [(1, 0, "user", "word " * 60_000 + "end."), (1, 1, "assistant", "x" * 200_000), (1, 2, "user", "word " * 60_000 + "end.")]
    rows += [(2, i, "user" if i % 2 else "assistant", "same." if i % 3 else f"text {i}.") for i in range(1500)]
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2} and got[2][2] > 500 and len(got[2][6].replace("I", "")) > 1400
    assert got[1] == expected(rows[:3])[1]


def test_repair_of_empty_and_dropped(spark):
    df = spark.createDataFrame([(1, 2, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert chat_repair.repair_report(df.limit(0)).count() == 0 and chat_repair.repair_conversations(df.limit(0)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = chat_repair.repair_report(spark.createDataFrame([(gone, 0, "user", "a.")], df.schema)).first()
    assert tuple(one)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "tool", "c."), (2, 0, "system", "only.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in chat_repair.repair_conversations(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, "K", "user", "a."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "b."), (1, 4, "R", "assistant", "c.")]
    assert chat_repair.audits(df.where("conv_id = 2")).first().audit == "D"


def test_long_conversations_in_blocks():
    """Letters cut off at block ends and joined again give what one wide integer gives."""
    rng = random.Random(2)
    for n in (0, 1, 5, 40, 300, 700):
        symbols = bytes(rng.choices(b"suuuaaaxUAX-", k=n))
        got = []
        for block in (2, 256, 10_000):
            chat_repair.BLOCK, before = block, chat_repair.BLOCK
            try:
                got.append(chat_repair.repair(symbols))
            finally:
                chat_repair.BLOCK = before
        assert got[0] == got[1] == got[2]
        assert len(got[0][1].replace("I", "")) == n


def numpy_whitening(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, centred = len(x), x - x.sum(0) / len(x)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return e, centred @ u[:, :8] / np.sqrt(e[:8]), ((n * x - x.sum(0)) ** 2).sum(1)


@pytest.mark.parametrize("d", [3, 9, 12])
def test_whitening_equals_numpy(spark, d):
    rng = np.random.default_rng(d)
    c = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + 50
    rows = [(i, [float(v) for v in np.float32(r)], "x") for i, r in enumerate(c)]
    odd = [(1000, None, "x"), (1001, [None] * d, "x"), (1002, [float("nan")] * d, "x"), (1003, [float("inf")] + [0.0] * (d - 1), "x"), (1004, [1.0], "x"), (1005, [], "x")]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<float>, component string")
    got = whitening.whiten(df.repartition(5)).toPandas()
    x = np.floor(np.float32(c).astype(float) * 1024).astype(int) + 100000
    x = np.vstack([x, x[:1]])
    e, white, deviation = numpy_whitening(x)
    k = min(8, d)
    assert len(got) == 301 * k and set(got.n) == {301} and set(got.vec_id) == set(range(300))
    assert sorted(set(got.explained), reverse=True) == pytest.approx(list(e[:k] / e.sum()), rel=1e-9)
    assert got.identity_error.max() < 1e-9
    first = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(first) - np.abs(white[:300])).max() < 1e-7
    signs = np.sign(first * white[:300, :k])
    assert (signs == signs[:1]).mean() > 0.99
    assert list(got.drop_duplicates("vec_id").sort_values("vec_id").deviation) == [Decimal(int(v)) for v in deviation[:300]]


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0])] * 5)).count() == 0
    flat = whitening.whiten(frame([(i, [float(i), 2.0 * i, 7.0]) for i in range(4)] + [(None, [1.0, 2.0, 7.0])])).toPandas()
    assert set(flat.component) == {1} and len(flat) == 5 and flat.explained.tolist() == pytest.approx([1.0] * 5) and flat.identity_error.max() < 1e-12
    big = whitening.whiten(frame([(i, [2.0**40 * i, float(i % 2)]) for i in range(6)])).toPandas()
    x = [[2**50 * i + 100000, 1024 * (i % 2) + 100000] for i in range(6)]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {int(r.vec_id): int(r.deviation) for r in big.itertuples()} == {i: sum((6 * v - t) ** 2 for v, t in zip(r, s, strict=True)) for i, r in enumerate(x)}
