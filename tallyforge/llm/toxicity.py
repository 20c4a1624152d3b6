"""Toxicity: a linear-chain CRF tags toxic tokens; forward-backward marginals score documents.

Token labels come from labelled documents: a token of a toxic document is
labelled toxic if its word keeps to toxic documents (by document counts of the
training sample); tokens of other documents never are. The CRF learns from
word, affix and neighbour features. A document's score is a logistic function
of its marginals' sum and maximum, fitted on the same sample.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .shared import free_name

#: At most so many labelled documents are learned from, the first by hash of their id.
TRAIN_DOCS = 4000
BUCKETS = 1 << 16
CHAIN = 128
WORD = re.compile(r"[^\W_]+")
SPAN_AT = 0.5
#: One in so many of the chains without a toxic token is learned from.
CLEAN_CHAINS = 4
#: Texts are tagged together up to about so many characters, so that memory does not grow with a batch.
SLICE_CHARS = 1 << 21
#: The same for the sample, beside which its features are held.
TRAIN_SLICE = 1 << 20


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of ``texts`` of at most ``most`` characters; a longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


#: Checksums of the kinds of features, which those of words go on from.
OWN, PREFIX, SUFFIX, BEFORE, AFTER = (crc32(kind) for kind in (b"w:", b"p:", b"s:", b"<:", b">:"))


def token_features(word: str) -> tuple[list[int], int, int]:
    """Buckets of a word's own features, and of it as the word before and after another."""
    b = lambda kind, s: crc32(s.encode(), kind) % BUCKETS
    return [b(OWN, word), b(PREFIX, word[:3]), b(SUFFIX, word[-3:])], b(BEFORE, word), b(AFTER, word)


class Known(dict):
    """Numbers of words as they are written, given out in the order they are first met; ``fresh`` has those without scores."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


@dataclass
class Tagger:
    model: crf.Model
    scale: np.ndarray

    def __post_init__(self) -> None:
        self._known = Known()
        self._table = np.zeros((0, 3))

    def __getstate__(self) -> dict:
        return {"model": self.model, "scale": self.scale}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def _scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-odds of its own, and what it adds to the next and to the previous word."""
        at = np.array([(*own, before, after) for own, before, after in map(token_features, map(str.lower, words))], np.int64)
        w = self.model.weights[at]
        return np.column_stack([w[:, 0] + w[:, 1] + w[:, 2] + self.model.weights[BUCKETS], w[:, 3], w[:, 4]])

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all tokens, starts of the texts); whole texts, one chain each."""
        if len(self._known) > 500_000:
            self.__post_init__()
        known, ids, starts = self._known, [], [0]
        for text in texts:
            ids += map(known.__getitem__, WORD.findall(text))
            starts.append(len(ids))
        at, starts = np.array(ids, np.int64), np.array(starts)
        if not len(at):
            return np.zeros(0), starts
        if known.fresh:  # only new words are added, lest each slice pay for all words met before
            self._table = np.concatenate([self._table, self._scores(known.fresh)])
            known.fresh.clear()
        table = self._table
        e = table[at, 0]
        inner = np.ones(len(at), bool)
        inner[starts[:-1][np.diff(starts) > 0]] = False
        later = np.flatnonzero(inner)
        e[later] += table[at[later - 1], 1]
        e[later - 1] += table[at[later], 2]
        return self.model.marginals(e, crf.Chains(starts)), starts

    def document_features(self, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log of the expected toxic tokens, and the greatest marginal, per text."""
        n = len(starts) - 1
        full = np.flatnonzero(np.diff(starts) > 0)
        total, top = np.zeros(n), np.zeros(n)
        if len(full):
            total[full] = np.add.reduceat(p, starts[:-1][full])
            top[full] = np.maximum.reduceat(p, starts[:-1][full])
        return np.column_stack([np.log1p(total), top])

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.document_features(*self.marginals(texts))
        return crf.sigmoid(x @ self.scale[:2] + self.scale[2])


def lexicon(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Words that keep to toxic documents: six standard deviations over chance, and three in five of their documents."""
    n, bad = Counter(), Counter()
    for text, t in zip(texts, toxic, strict=True):
        if t:
            bad.update({w.lower() for w in WORD.findall(text)})
    for text in texts:
        n.update(bad.keys() & {w.lower() for w in WORD.findall(text)})
    rate = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6) if len(toxic) else 0.5
    return {w for w, a in bad.items() if a >= 0.6 * n[w] and a - n[w] * rate >= 6 * np.sqrt(n[w] * rate * (1 - rate))}


def train(texts: list[str], toxic: np.ndarray) -> Tagger:
    words = lexicon(texts, toxic)
    token, feature, labels, starts = array("i"), array("i"), array("b"), array("q", [0])  # a list of numbers takes ten times as much
    memo: dict[str, tuple[list[int], int, int]] = {}
    for text, t in zip(texts, toxic, strict=True):
        tokens = [w.lower() for w in WORD.findall(text)]
        for lo in range(0, len(tokens), CHAIN):
            part = tokens[lo : lo + CHAIN]
            if not (t and words.intersection(part)) and len(starts) % CLEAN_CHAINS:
                starts.append(starts[-1])  # one in CLEAN_CHAINS is kept
                continue
            known = [memo[w] if w in memo else memo.setdefault(w, token_features(w)) for w in part]
            for i, (own, _, _) in enumerate(known):
                here = [*own, BUCKETS] + ([known[i - 1][1]] if i else []) + ([known[i + 1][2]] if i + 1 < len(known) else [])
                feature.extend(here)
                token.extend([len(labels)] * len(here))
                labels.append(bool(t) and part[i] in words)
            starts.append(len(labels))
    del memo
    model = crf.fit(np.frombuffer(token, np.int32), np.frombuffer(feature, np.int32), np.frombuffer(labels, np.int8), np.array(starts, np.int64), BUCKETS + 1)
    del token, feature
    tagger = Tagger(model, np.array([0.0, 0.0, -1.0]))  # without evidence, below a half
    if len(texts):
        rows = []
        for part in slices(texts, TRAIN_SLICE):
            rows.append(tagger.document_features(*tagger.marginals(part)))
            tagger.__post_init__()  # words met are not kept
        x = np.column_stack([np.concatenate(rows), np.ones(len(texts))])
        w = np.zeros(3)
        for _ in range(25):  # Newton steps of a ridge logistic fit
            p = crf.sigmoid(x @ w)
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - toxic) + 0.1 * w)
        tagger.scale = w
    return tagger


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_tagger(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Tagger:
    """Learns from at most ``train_docs`` labelled documents that are not held out.

    Only labels pick the sample; one task gathers their texts, a bounded number, and learns.
    Null labels, ids and texts are left out; an empty sample gives a tagger
    whose scores are all the same, below 0.5. Ties in the order of the sample
    are settled by id and label; rows that repeat a document count each.
    """
    pick = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").where("text is not null").orderBy("doc_id", "text", "toxic").limit(2 * train_docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(toxic, float)))], pa.binary())], names=["tagger"])

    # The ordered limit leaves one partition; only the weights come back.
    made = rows.select("text", "toxic").mapInArrow(learn, "tagger binary").collect()
    return pickle.loads(made[0].tagger) if made else train([], np.zeros(0))


def score_documents(docs: DataFrame, tagger: Tagger, name: str = "toxicity") -> DataFrame:
    """``docs`` plus ``name`` double: whole texts; null and empty texts get the score of no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.scores(part) for part in slices([t or "" for t in texts])] or [np.zeros(0)]))

    return docs.withColumn(name, score(F.col("text")))


def toxic_spans(docs: DataFrame, tagger: Tagger, at: float = SPAN_AT) -> DataFrame:
    """(doc_id, spans): runs of tokens with a marginal of at least ``at``, as code point offsets (lo, hi)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        if not (p >= at).any():
            return out
        hit = False
        for m, q in zip(WORD.finditer(text), p, strict=True):
            if q >= at and hit:
                out[-1]["hi"] = m.end()
            elif q >= at:
                out.append({"lo": m.start(), "hi": m.end()})
            hit = q >= at
        return out

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[dict[str, int]]] = []
            for part in slices([t or "" for t in texts]):
                p, starts = shared.value.marginals(part)
                out += [spans(t, p[a:b]) for t, a, b in zip(part, starts[:-1], starts[1:], strict=True)]
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", tag(F.col("text")).alias("spans"))


def toxicity_report(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score_documents(docs.select("doc_id", "text"), fit_tagger(docs, labels, train_docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without documents that score 0.5 or more; null and empty texts stay, and all where nothing was learned. Columns pass through, whatever their names."""
    name = free_name("toxicity", docs)
    kept = score_documents(docs, fit_tagger(docs, labels, train_docs), name)
    return kept.where((F.col(name) < 0.5) | F.col("text").isNull() | (F.col("text") == "")).drop(name)
