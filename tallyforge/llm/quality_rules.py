"""Quality rules: ordered lists of threshold conjunctions, learned by sequential covering.

Rules are grown one condition at a time on two thirds of the labelled
statistics (by information gain) and pruned on the rest, until no rule beats
its class. They are emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: At most so many labelled documents are learned from, the first by hash of their id.
TRAIN_DOCS = 6000
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_digits", "n_stops", "n_marks", "longest_word", "top_word"]
#: Statistics that rules may test; each is a ratio or a size, by SQL over BASE and MORE.
TESTED = {
    "n_words": "n_words", "mean_word": "word_chars / n_words", "symbol_share": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words", "distinct_share": "n_distinct_words / n_words", "upper_share": "n_upper / word_chars", "digit_share": "n_digits / word_chars",
    "stop_share": "n_stops / n_lines", "mark_share": "n_marks / n_words", "longest_word": "longest_word", "line_words": "n_words / n_lines", "top_share": "top_word / n_words",
}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words found twice or more in the text; exact."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h + mixed[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0  # equal windows have equal hashes, so there are none
    ranks, have = ids, 1
    while have < width:  # exact ranks of windows, by doubling
        step = min(have, width - have)
        m = len(ranks) - step
        ranks = np.unique(ranks[:m] * np.int64(len(words) + 1) + ranks[step : step + m], return_inverse=True)[1]
        have += step
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """BASE then MORE of one text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    stops = sum(x.rstrip(BLANKS)[-1] in '.!?…"' for x in lines)
    marks = sum(map(text.count, "!?;:,."))
    if words:
        distinct = set(words)
        top = max(np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)[1])
        longest = max(map(len, distinct))
    else:
        distinct, top, longest = (), 0, 0
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(distinct), upper, digits, stops, marks, longest, int(top))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus BASE and MORE (long), over whole texts."""

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE + MORE))
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = np.array([text_statistics(t) for t in texts], np.int64).reshape(-1, len(BASE + MORE))
            yield pd.DataFrame(rows, columns=BASE + MORE)

    return docs.select(*keep, statistics(F.col("text")).alias("_s")).select(*keep, "_s.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def tested(name: str) -> Column:
    """The statistic as double; ratios of nothing are 0."""
    over, _, under = TESTED[name].partition(" / ")
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")) if under else F.col(over).cast("double"), F.lit(0.0))


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (statistic, at_least, threshold) that reject together. Else a document is kept."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def rejects(self, x: np.ndarray, names: list[str], rule: list[tuple[str, bool, float]]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, at_least, t in rule:
            v = x[:, names.index(name)]
            hit &= (v >= t) if at_least else (v < t)
        return hit

    def expression(self) -> Column:
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for name, at_least, t in rule:
                test &= (tested(name) >= t) if at_least else (tested(name) < t)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def text(self) -> list[str]:
        return [" and ".join(f"{n} {'>=' if g else '<'} {t:g}" for n, g, t in r) + " -> reject" for r in self.rules] + ["else -> keep"]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 4, least: int = 8) -> DecisionList:
    """Sequential covering: grow on two thirds by information gain, prune on the rest, drop what a rule covers, repeat."""
    out = DecisionList()
    if not bad.any() or bad.all():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:])) for j in range(len(names))]
    part = np.arange(len(x)) % 3
    left = np.ones(len(x), bool)
    overall = bad.mean()
    for _ in range(max_rules):
        grow, prune = left & (part < 2), left & (part == 2)
        rule, inside = [], grow.copy()
        while len(rule) < max_conditions:
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if not p or not n:
                break
            best = (0.0, None)
            for j, name in enumerate(names):
                v, y = x[inside, j], bad[inside]
                for t in cuts[j]:
                    high = v >= t
                    for at_least in (True, False):
                        m = high if at_least else ~high
                        q, total = int((m & y).sum()), int(m.sum())
                        if q >= least:
                            gain = q * (np.log2(q / total) - np.log2(p / (p + n)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (name, at_least, float(t)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= out.rejects(x, names, [best[1]])

        def worth(r: list) -> float:
            m = prune & out.rejects(x, names, r)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & out.rejects(x, names, rule) if rule else np.zeros(len(x), bool)
        rate = (hit & bad).sum() / max(hit.sum(), 1)
        if not rule or worth(rule) <= 0 or rate < max(0.5, 2 * overall if overall < 0.4 else overall) or (hit & bad).sum() < least:
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DecisionList:
    """Learns from at most ``train_docs`` labelled documents' statistics; their texts stay on the executors.

    Null labels and ids are left out; with labels of one kind, no rule is learned.
    """
    pick = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_docs)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id"), "quality-sample")  # else filters on statistics run over all documents below the join
    rows = with_statistics(sample, ["doc_id", "quality"])
    rows = rows.where(~base_failed()).select("doc_id", "quality", *[tested(n).alias(n) for n in TESTED]).orderBy(F.xxhash64("doc_id"), "doc_id", "n_words").limit(2 * train_docs).toPandas()
    discard(sample)
    return learn(rows[list(TESTED)].to_numpy(float), (rows["quality"] == 0).to_numpy(), list(TESTED))


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, BASE, MORE, base_failed, kept) for every document; null texts have no words and fail the base."""
    out = with_statistics(docs, ["doc_id"]).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rules.expression()))


def quality_report(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    return apply_rules(docs, fit_rules(docs, labels, train_docs)).select("doc_id", *BASE, "base_failed", "kept")
