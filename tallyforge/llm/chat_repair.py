"""Repair of conversations' structure by a dynamic program over integer weights.

A conversation is repaired by keeping, re-roling, deleting and inserting turns
until its roles' initials are ``(s?(ua)+)?``. Every partial repair is one
integer: the high digits are its cost, the low digits, of fixed width and filled
up with zeros at the end, the letters of its edits. The smaller integer is the
cheaper repair, and of equally cheap ones that of the ASCII-least audit, so
plain integer minima decide all.

Rows are damaged and judged by Spark expressions (blank, duplicate, truncated).
For the program a row is one byte. Rows are dealt by conversation and sorted by
Spark, which spills, and streamed; a task holds the bytes of one conversation,
never its texts. Texts stream by a second time, next to their audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: What edits cost, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows whose letters one integer holds; the letters of rows behind are put aside, see ``repair``.
BLOCK = 256
LETTERS = "?DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
#: What stands before: nothing, a system turn, a user turn, an assistant turn. The turn that may be made there, and what stands there then.
MADE, THEN = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = (0, None, None, 0)

WORD = "[^\\x20\\x09-\\x0D]"


def repair(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest, then ASCII-least repair.

    A row is one byte: its initial (``s``, ``u``, ``a``, or ``x`` for others), in
    upper case if truncated, or ``-`` if it must go. The program runs from the last row to the
    first. Two repairs from one state differ in the first letter in which they
    part, as every edit there has another letter and one outcome; so after each
    ``BLOCK`` rows the letters found may be cut off the weights, which then hold
    the cost alone, and are joined on again at the end.
    """
    digits = 3 * BLOCK + 8  # more inserts than rows + 2 never pay
    width = 3 * digits
    low = (1 << width) - 1
    step = {c: DIGIT[c] << (width - 3) for c in DIGIT}

    def put(letter: str, cost: int, rest: int | None) -> int | None:
        return None if rest is None else (((rest >> width) + cost) << width) | step[letter] | ((rest & low) >> 3)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def inserted(f: list[int | None]) -> list[int | None]:
        user, assistant = least(f[2], put("I", INSERT, f[3])), least(f[3], put("I", INSERT, f[2]))
        return [least(f[0], put("I", INSERT, user)), least(f[1], put("I", INSERT, user)), user, assistant]

    aside: list[list[str | None]] = []
    f = inserted(list(ENDS))
    for nth, byte in enumerate(reversed(symbols), 1):
        c = chr(byte)
        more = TRUNCATED if c.isupper() else 0
        g = [put("D", DELETE, w) for w in f]
        if c != "-":
            keep = KEPT.get(c.lower(), (None,) * 4)
            g = [least(g[q], put("K", more, f[keep[q]]) if keep[q] is not None else None, put("R", REROLE + more, f[THEN[q]])) for q in range(4)]
        f = inserted(g)
        if nth % BLOCK == 0:
            aside.append([None if w is None else letters(w & low, digits) for w in f])
            f = [None if w is None else (w >> width) << width for w in f]
    audit, at, state = [letters(f[0] & low, digits)], 0, 0
    while aside:
        for letter in audit[-1]:
            if letter in "IR":
                state = THEN[state]
            elif letter == "K":
                state = KEPT[chr(symbols[at]).lower()][state]
            at += letter != "I"
        audit.append(aside.pop()[state])
    return f[0] >> width, "".join(audit)


def letters(number: int, digits: int) -> str:
    octal = f"{number:0{digits}o}".rstrip("0")
    return "".join(LETTERS[int(d)] for d in octal)


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults that crc32 of ``conv_id:turn`` deals out: dropped, emptied, unpunctuated, repeated, made a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = table.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("fault"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_time"))
    return out.drop("_time")


def sort_keys() -> list[Column]:
    """Order of a conversation's rows: turn (nulls first), role, the text's first 64 characters, a hash of it."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("h1")]


def judged(rows: DataFrame) -> DataFrame:
    """Slim rows: conv_id, turn, role, head and h1 (for order), symbol, and whether the same role and text stands at an earlier turn (``again``) or may be repeated beside it (``h1``, ``h2``)."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    last = F.regexp_extract("text", f"({WORD})[\\x20\\x09-\\x0D]*\\z", 1)
    symbol = F.when(~F.col("text").rlike(WORD), "-").when(last.rlike("^[.!?]$"), kind).otherwise(F.upper(kind))
    slim = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(7)).alias("h2"), symbol.alias("symbol"), initial.alias("initial"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = slim.groupBy(F.col("conv_id").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1")
    joined = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), "left")
    return joined.select("conv_id", "turn", "role", "head", "h1", "h2", "symbol", "initial", F.coalesce(order > F.col("first"), F.lit(False)).alias("again"))


class Judge:
    """What one conversation's rows add up to, in their order."""

    def __init__(self) -> None:
        self.symbols, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.turns: list[int] = [0, 0, 0]  # least, largest, how many
        self.before: tuple | None = None

    def add(self, turn: int | None, h1: int, h2: int, symbol: str, initial: str, again: bool) -> None:
        if turn is not None and not self.turns[2]:
            self.turns = [turn, turn, 1]
        elif turn is not None and turn != self.turns[1]:
            self.turns = [self.turns[0], turn, self.turns[2] + 1]
        again = again or (self.before is not None and self.before[:3] == (turn, h1, h2))
        if self.before is not None and self.before[3] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = (turn, h1, h2, initial)
        if symbol == "-":
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif symbol.isupper():
            self.truncated += 1
        self.symbols += b"-" if again else symbol.encode()

    def result(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns[2] else 0
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *repair(bytes(self.symbols)))


def _groups(batches: Iterator[pa.RecordBatch], fresh: Callable, add: Callable, done: Callable) -> Iterator[tuple]:
    """What ``add`` and ``done`` give for rows sorted by conv_id; they get a conversation's state, ``done`` its id first."""
    key, state = None, None
    for batch in batches:
        for conv, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if state is None or conv != key:
                if state is not None:
                    yield from done(key, state)
                key, state = conv, fresh()
            yield from add(key, state, *rest)
    if state is not None:
        yield from done(key, state)


def _stream(df: DataFrame, form: str, fresh: Callable, add: Callable, done: Callable) -> DataFrame:
    """``df``, dealt and sorted by conv_id, through ``_groups``; ``form`` has the output's columns after conv_id, longs but for ``text`` ones."""
    names, most = ["conv_id", *[c.split()[0] for c in form.split(", ")]], 2000
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in form.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("conv_id").type, *kinds]
        rows = _groups(chain([first], batches), fresh, add, done)
        while lot := list(islice(rows, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot, strict=True), types, strict=True)], names=names)

    return df.mapInArrow(run, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {form}")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has ``rows`` (conv_id, turn, role, text)."""
    dealt = judged(rows).repartition("conv_id").sortWithinPartitions("conv_id", *sort_keys())
    slim = dealt.select("conv_id", F.col("turn").cast("long").alias("turn"), "h1", "h2", "symbol", "initial", "again")

    def add(_, state: Judge, *row) -> tuple:
        state.add(*row)
        return ()

    return _stream(slim, ", ".join(f"{c} long" for c in COUNTS) + ", audit string", Judge, add, lambda key, state: [(key, *state.result())])


class Mender:
    """Applies an audit to rows as they come."""

    def __init__(self) -> None:
        self.audit, self.at, self.state, self.made = "", 0, 0, 0

    def insert(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.turn("I", MADE[self.state], "", THEN[self.state])

    def turn(self, letter: str, role: str, text: str, state: int) -> tuple:
        self.at, self.state, self.made = self.at + 1, state, self.made + 1
        return self.made, letter, role, text

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.insert()
        letter = self.audit[self.at]
        if letter == "K":
            yield self.turn("K", role, text, KEPT[role[0]][self.state])
        elif letter == "R":
            yield self.turn("R", MADE[self.state], text, THEN[self.state])
        else:
            self.at += 1


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text): each conversation's audit, then its rows in order."""
    order = rows.select("conv_id", F.lit(1).alias("part"), F.lit("").alias("audit"), "turn", "role", "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("role", "text").alias("h1"))
    heads = found.select("conv_id", F.lit(0).alias("part"), "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("head"), F.lit(0).cast("long").alias("h1"))
    both = heads.unionByName(order).repartition("conv_id").sortWithinPartitions("conv_id", "part", *sort_keys())
    return both.select("conv_id", "part", "audit", "role", "text")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place from 1, edit K, R or I, role, text) of the repaired conversations; ``found``: what ``audits`` gave."""

    def add(key, state: Mender, part: int, audit: str, role: str, text: str) -> Iterator[tuple]:
        if part == 0:
            state.audit = audit
            return
        for turn in state.row(role, text):
            yield (key, *turn)

    def done(key, state: Mender) -> Iterator[tuple]:
        for turn in state.insert():
            yield (key, *turn)

    return _stream(_beside_audits(rows, found), "place long, edit string, role string, text string", Mender, add, done)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): lower-case hex of each repaired ``role:text``, joined by newlines."""

    class Digest(Mender):
        def __init__(self) -> None:
            super().__init__()
            self.hash = hashlib.sha256()

        def feed(self, turns: Iterator[tuple]) -> tuple:
            for place, _, role, text in turns:
                self.hash.update((f"{role}:{text}" if place == 1 else f"\n{role}:{text}").encode())
            return ()

    def add(_, state: Digest, part: int, audit: str, role: str, text: str) -> tuple:
        if part == 0:
            state.audit = audit
            return ()
        return state.feed(state.row(role, text))

    def done(key, state: Digest) -> list[tuple]:
        state.feed(state.insert())
        return [(key, state.hash.hexdigest())]

    return _stream(_beside_audits(rows, found), "repaired_sha256 string", Digest, add, done)


def repair_conversations(table: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): ``table`` (conv_id, turn, role, text), repaired.

    Nulls in role and text count as one space. Rows are taken by turn, nulls
    first; rows of one turn by role, then text. Rows with a null conv_id are one
    conversation. Conversations of which nothing can stay have no rows here, and
    an empty table gives none. Other columns are ignored, whatever their names.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = table.select("conv_id", "turn", blank("role"), blank("text"))
    return repaired_turns(rows, materialize(audits(rows), "audits"))


def repair_report(table: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``table`` after ``damaged``; zeros, no letters and the hash of nothing where no row is left."""
    rows = damaged(table)
    found = materialize(audits(rows), "audits")
    hashes = repaired_digests(rows, found).withColumnRenamed("conv_id", "_h")
    ids = table.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("audit").isNotNull(), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")) & F.col("repaired_sha256").isNotNull(), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
