"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model of its words
and their beginnings; the document's is their noisy-or, 1 - prod(1 - p). Only documents are labelled: the
gradient of the noisy-or finds which sentences to blame.

The classifier learns from a bounded sample: `SAMPLE` labels at most, those with the
least hash of doc_id, and of the texts of those documents that have at most `LONG`
characters `SAMPLE` at most. A null or empty text has no sentence; it is scored as one
sentence without words. Conflicting or repeated labels count once each; null labels, and
those of a null doc_id, do not. A null doc_id is not held out. A score of just 0.5 is
predicted toxic. Very long texts are scored whole. Repeated rows give repeated rows; other
columns are passed over, whatever their names. An empty table gives an empty table;
without labels all documents score low.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.llm.common import parts, released, small_batches, tables, written

#: Most training texts; fewest documents of a word; most words of the model.
SAMPLE, FEWEST, MOST = 4500, 4, 3000
#: Characters of a training text at most; words whose weights a worker remembers.
LONG, REMEMBERED = 100_000, 200_000
#: Lengths of the beginnings of words that are features beside whole words.
STEMS = (4, 5, 6, 7)
SENTENCE = re.compile(r"[.!?…。！？\n\r]+")
SPACES = str.maketrans({c: " " for c in ",;:\"()[]{}<>|*_#«»„“”‘’"})


def sentences(text: str | None) -> list[str]:
    """Lower-case sentences; one empty sentence if there is none."""
    return [s for s in SENTENCE.split((text or "").lower().translate(SPACES)) if s.strip()] or [""]


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def train(rows: list[tuple[str | None, int]], rounds: int = 500, rate: float = 0.5, l2: float = 2e-6) -> dict:
    """Full-batch gradient ascent with per-weight step sizes on the noisy-or likelihood."""
    if not rows:
        return {"bias": -2.0, "weights": {}}
    # features by number; of each instance those of its words, of each document those it has
    numbers: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    idx, sizes, doc = array("i"), array("i"), array("i")
    y = np.array([v for _, v in rows], np.float64)
    had: list[np.ndarray] = []
    for d, (text, _) in enumerate(rows):
        began = len(idx)
        for s in sentences(text):
            before = len(idx)
            for word in sorted(set(s.split())):
                if word not in of_word:
                    of_word[word] = [numbers.setdefault(f, len(numbers)) for f in features(word)]
                idx.extend(of_word[word])
            sizes.append(len(idx) - before)
            doc.append(d)
        had.append(np.unique(np.frombuffer(idx, np.int32)[began:].copy()) if len(idx) > began else np.zeros(0, np.int32))
    seen, toxic = np.zeros(len(numbers)), np.zeros(len(numbers))
    for own, v in zip(had, y):
        seen[own] += 1
        toxic[own] += v > 0
    del of_word, had
    # the words whose share of toxic documents departs most from the common share, for their number
    rate_all, names = (y.sum() + 0.5) / (len(y) + 1), list(numbers)
    odd = np.abs(toxic - seen * rate_all) / np.sqrt(np.maximum(seen, 1) * rate_all * (1 - rate_all))
    chosen = sorted(np.flatnonzero(seen >= FEWEST).tolist(), key=lambda f: (-odd[f], names[f]))[:MOST]
    vocabulary, place = {names[f]: i for i, f in enumerate(chosen)}, np.full(len(names) + 1, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    doc, idx = np.array(doc, np.int64), place[np.frombuffer(idx, np.int32)] if len(idx) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(doc), dtype=np.int32), np.frombuffer(sizes, np.int32))
    row, idx = row[idx >= 0].astype(np.int64), idx[idx >= 0].astype(np.int64)
    w, b = np.zeros(len(vocabulary)), float(np.log(1e-3))
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.clip(b + np.bincount(row, weights=w[idx], minlength=len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, weights=np.log1p(-p), minlength=len(y))  # log of no toxic sentence
        keep = np.exp(np.minimum(none, -1e-12))
        # d log likelihood / d z: p for its share of a toxic bag, minus p for a clean one
        blame = np.where(y > 0, keep / (1 - keep), -1.0)[doc] * p / len(y)
        dw, db = np.bincount(idx, weights=blame[row], minlength=len(w)) - l2 * w, blame.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w + rate * dw / np.sqrt(gw), b + rate * db / np.sqrt(gb)
    return {"bias": float(b), "weights": {x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 1e-3}}


class Scorer:
    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]
        self.plain = float(np.log1p(np.exp(min(30.0, self.bias))))  # -log(1 - p) of a sentence without known words
        self.words: dict[str, float] = {}

    def weight(self, word: str) -> float:
        x = self.words.get(word)
        if x is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            x = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return x

    def hazards(self, text: str | None) -> list[float]:
        """-log(1 - p) of each sentence."""
        found = [s.split() for s in sentences(text)]
        known = {w: x for w in {w for s in found for w in s} if (x := self.weight(w))}
        if not known:
            return [self.plain] * len(found)
        out, names = [], known.keys()
        for s in found:
            hit = names & s
            out.append(float(np.log1p(np.exp(min(30.0, self.bias + sum(known[w] for w in sorted(hit)))))) if hit else self.plain)
        return out

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-sum(self.hazards(text))))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, float]]:
        """(number, score) of the sentences that are toxic by themselves."""
        return [(i, float(-np.expm1(-h))) for i, h in enumerate(self.hazards(text)) if -np.expm1(-h) >= least]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Learns from labels whose document is not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    # `sample` rows at most, so this side can be sent to every executor
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    texts = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= LONG).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = texts.join(chosen, "doc_id").withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "toxic", "key"])
    rows = rows.orderBy("key", "doc_id", "toxic", "text").limit(sample).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        scorer = Scorer(model)
        for b in parts(batches):
            s = np.array([scorer.score(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def offending(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, sentence, score) of each sentence that is toxic by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        scorer = Scorer(model)
        for b in parts(batches):
            rows = [(d, i, s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, s in scorer.offending(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, sentence int, score double")


def cleaned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; all columns stay. Written."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        scorer = Scorer(model)
        for b in parts(batches):
            yield b.filter(pa.array([scorer.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    with small_batches(docs.sparkSession):
        return written(docs.mapInArrow(run, docs.schema), "cleaned")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = tables(spark, folder, "documents", "labels")
    return scored(docs, fit(docs, labels))
