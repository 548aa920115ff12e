"""Language-model scoring by a hashed maximum-entropy model.

P(word | context) = P(class | context) P(word | class). The classes are the most frequent
words alone, the other words by cluster and band of frequency, and one class of all rarer
words and words never seen. A cluster holds words of like documents: each document has a
vector, the sum of random signs of the words that are frequent where it is counted, each
word the sum of the vectors of the documents it is in, and those sums fall into `CLUSTERS`
groups. So context tells, through classes, which of many words can come.

A softmax over classes reads features of the context: by hash the word before and the two
words before; the classes of the two words before, and, skipping those, the classes of the
two before them. It is trained by distributed gradient updates: in each
of `ROUNDS` rounds the partitions run minibatch AdaGrad from the same weights over the
round's share of the training documents (each document is in one round), and their weights
are averaged by tokens, summed in a tree of `FAN` at a time. The number of hashed rows
follows the number of training tokens up to `ROWS`. Texts are scored in numpy batches with
sparse rows of weights.

Within a class a word's probability is its share of the class's tokens. The class of
rarer words also holds one unseen word, with as many tokens as there are words seen once
(Good and Turing's estimate).

Counts are taken over all training documents by the 64-bit hash of a word. The words of
the `TABLE` highest counts at most are sent to every task (a bounded table); tokens of
rarer words meet their counts in a shuffled join, so a vocabulary of any size is counted
and based alike, and the table's bound decides only which words have a class by context. The
end of a text is a word of its own. A null text is as an empty one; a null doc_id is not
held out. Words of equal counts are ordered by their hashes. Very long texts are scored
whole, some 100 bytes a token. Repeated rows give repeated rows; other columns are passed
over, whatever their names. An empty table gives an empty table; without training documents
every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.llm.common import released, removed, small_batches, tables, written
from colonnade.llm.simhash import LOWER

TABLE, ALONE, CLUSTERS, BANDS, ROUNDS = 400_000, 7, 6, 4, 2
CLASSES = ALONE + CLUSTERS * BANDS + 1  # the last is of rarer and unseen words
#: Hashed rows of weights at most, and training tokens to a row below that.
ROWS, TOKENS = 1 << 18, 64
BATCH, RATE = 1 << 13, 0.15
#: Numbers of a document's vector; a word's share of tokens from which on it counts there.
SIGNS, FREQUENT = 8, 0.001
#: Weights of one stretch are summed over so many partitions at a time; rows of a stretch.
FAN, STRETCH = 64, 1 << 12
END = xxhash.xxh64_intdigest(b"")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 7 == 2, F.lit(False))


def hashes(text: str | None) -> list[int]:
    """A text's words by hash, then the end."""
    h = xxhash.xxh64_intdigest
    out = [h(w) for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()]
    out.append(END)
    return out


def token_batches(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, tokens of each text) for runs of whole texts."""
    first, found, sizes = 0, [], []
    for i, t in enumerate(texts):
        h = hashes(t)
        found += h
        sizes.append(len(h))
        if len(found) >= most:
            yield first, np.array(found, np.uint64), np.array(sizes)
            first, found, sizes = i + 1, [], []
    if sizes:
        yield first, np.array(found, np.uint64), np.array(sizes)


def counted(docs: DataFrame) -> DataFrame:
    """(h, c, v0 ..): each word's tokens and vector; partial sums before the shuffle."""
    kinds = [f"v{k}" for k in range(SIGNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, sizes in token_batches(b.column(0).to_pylist(), 1 << 19):
                words, back, n = np.unique(h, return_inverse=True, return_counts=True)
                signs = 2 * np.unpackbits(((words * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)[:, None], axis=1).astype(np.int8) - 1
                signs[(n < FREQUENT * len(h)) | (words == np.uint64(END))] = 0
                of_doc = np.add.reduceat(signs[back], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                of_doc = np.rint(127 * of_doc / np.maximum(1e-9, np.linalg.norm(of_doc, axis=1, keepdims=True)))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                vectors = [np.bincount(back, weights=of_doc[:, k][doc]).astype(np.int64) for k in range(SIGNS)]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64)), *map(pa.array, vectors)], names=["h", "c", *kinds])

    found = docs.select("text").mapInArrow(run, "h bigint, c bigint, " + ", ".join(f"{k} bigint" for k in kinds))
    return found.groupBy("h").agg(F.sum("c").alias("c"), *(F.sum(k).alias(k) for k in kinds))


def clustered(vectors: np.ndarray, weights: np.ndarray, count: int = CLUSTERS, rounds: int = 12) -> np.ndarray:
    """The cluster of each vector: weighted k-means of directions, begun at the heaviest and then at those farthest from all before."""
    x = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    if not len(x):
        return np.zeros(0, np.int64)
    heavy = np.argsort(-weights, kind="stable")[:2000]
    centers = x[heavy[:1]]
    for _ in range(count - 1):
        centers = np.vstack([centers, x[heavy[np.argmin((x[heavy] @ centers.T).max(axis=1))]]])
    for _ in range(rounds):
        best = (x @ centers.T).argmax(axis=1)
        sums = np.stack([np.bincount(best, weights=weights * x[:, k], minlength=count) for k in range(x.shape[1])], axis=1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(1e-9, norms), centers)
    return (x @ centers.T).argmax(axis=1)


class Model:
    """A table of words with their classes and log shares, and the weights of the features."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, once: int, vectors: np.ndarray | None = None):
        order = np.argsort(words, kind="stable")
        self.words, self.counts = words[order], counts[order].astype(np.int64)
        self.total, self.distinct = total, distinct
        clusters = np.zeros(len(order), np.int64) if vectors is None else clustered(vectors[order].astype(np.float64), self.counts.astype(np.float64))
        by = np.lexsort((self.words, -self.counts))  # by rank
        self.classes = np.full(len(order), CLASSES - 1, np.int16)
        self.classes[by[:ALONE]] = np.arange(min(ALONE, len(by)))
        for k in range(CLUSTERS):  # bands of equal mass
            own = by[ALONE:][clusters[by[ALONE:]] == k]
            mass = np.cumsum(self.counts[own])
            self.classes[own] = ALONE + k * BANDS + np.minimum(BANDS - 1, (mass - self.counts[own]) * BANDS // max(1, mass[-1] if len(mass) else 1))
        mass = np.bincount(self.classes, weights=self.counts, minlength=CLASSES)
        self.share = np.log10(self.counts / mass[self.classes]) if len(order) else np.zeros(0)
        self.rare = total - int(self.counts.sum())  # tokens of words beyond the table
        self.unseen = max(1, once)
        self.prior = np.log((mass + 1.0 + np.where(np.arange(CLASSES) == CLASSES - 1, self.rare + self.unseen, 0)) / (mass.sum() + self.rare + self.unseen + CLASSES)).astype(np.float32)
        self.bits = min(ROWS, max(1 << 12, total // TOKENS)).bit_length() - 1
        self.weights = np.zeros(((1 << self.bits) + 2 * (CLASSES + 1) ** 2, CLASSES), np.float32)

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model that has these parts; broadcasts carry the parts, which need no package to be read."""
        m = cls.__new__(cls)
        m.__dict__.update(state)
        return m

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which hashes are in it."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def class_of(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, self.classes[at] if len(self.words) else 0, CLASSES - 1)

    def features(self, h: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """(tokens, 4) rows of the weights: one word before, two before, the two classes before, and the two before those, a skip."""
        n = len(h)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[place < 1], two[place < 2] = 0, 0
        k, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - self.bits)
        before = np.full((5, n), CLASSES, np.int64)  # the class of what is before the start
        for d in range(1, 5):
            before[d, d:] = np.where(place[d:] >= d, classes[: max(0, n - d)], CLASSES)
        side, first = CLASSES + 1, 1 << self.bits
        hashed = [(one * k) >> shift, ((one ^ (two * k)) * k + np.uint64(1 << 60)) >> shift]
        return np.stack([*hashed, first + before[1] * side + before[2], first + side * side + before[3] * side + before[4]], axis=1).astype(np.int32)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """(tokens, classes) sums of weights, the greatest of a token 0."""
        w = self.weights
        z = w.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            z += w.take(rows[:, k], axis=0)
        z += self.prior
        z -= z.max(axis=1, keepdims=True)
        return z

    def log_classes(self, rows: np.ndarray) -> np.ndarray:
        """(tokens, classes) log probabilities."""
        z = self.logits(rows)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def learn(self, texts: Iterator[list[str | None]]) -> int:
        """AdaGrad over minibatches; the number of tokens."""
        seen, squares = 0, np.full(len(self.weights), 1e-2, np.float32)
        for part in texts:
            for _, h, sizes in token_batches(part):
                words, back = np.unique(h, return_inverse=True)
                classes = self.class_of(*self.look_up(words))[back]
                rows = self.features(h, sizes, classes)
                for i in range(0, len(h), BATCH):
                    r, y = rows[i : i + BATCH], classes[i : i + BATCH]
                    g = self.logits(r)
                    np.exp(g, out=g)
                    g /= g.sum(axis=1, keepdims=True)
                    g[np.arange(len(y)), y] -= 1
                    for k in range(r.shape[1]):
                        order = np.argsort(r[:, k])
                        at = r[:, k].take(order)
                        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        total, touched = np.add.reduceat(g.take(order, axis=0), starts, axis=0), at[starts]
                        # a row's gradient counts by the root of its tokens
                        scale = 1 / np.sqrt(np.diff(np.r_[starts, len(at)]).astype(np.float32))
                        size = squares.take(touched) + np.einsum("ij,ij->i", total, total) * scale * scale * np.float32(1 / CLASSES)
                        squares[touched] = size
                        total *= (scale * np.float32(RATE) / np.sqrt(size))[:, None]
                        self.weights[touched] -= total
                seen += len(h)
        return seen


def averaged(parts: DataFrame, most: int) -> list:
    """Rows (stretch, n, moved): sums of n times the 16-bit numbers of parts (part, stretch, n, moved), as 32-bit ones.

    They are summed over `FAN` of the partitions 0 to `most` at a time, so no task holds
    more than that of a stretch.
    """

    def adding(kind: str):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = 0.0
            for m, n in zip(group.moved, group.n):
                total = total + np.frombuffer(m, kind).astype(np.float32) * np.float32(n if kind == "<f2" else 1)
            return pd.DataFrame({"part": [int(group.part.iloc[0]) // FAN], "stretch": [int(group.stretch.iloc[0])], "n": [int(group.n.sum())], "moved": [total.tobytes()]})

        return add

    now, kind = parts, "<f2"
    while True:
        with small_batches(now.sparkSession, 16):
            sums = now.groupBy(F.floor(F.col("part") / FAN), "stretch").applyInPandas(adding(kind), "part int, stretch int, n bigint, moved binary")
            last, now = now, written(sums, "moved")
        removed(last)
        if most < FAN:
            break
        most, kind = most // FAN, "<f4"
    rows = list(now.toLocalIterator())  # one for each stretch; a part of the table at a time
    removed(now)
    return rows


def trained(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The weights after `rounds` rounds, each over its own share of the documents."""
    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(dict(model.__dict__))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model.of(sent.value)
            start = own.weights
            own.weights = start.copy()
            n = own.learn(b.column(0).to_pylist() for b in batches)
            if n:
                part = TaskContext.get().partitionId()
                for i in range(0, len(start), STRETCH):
                    moved = (own.weights[i : i + STRETCH] - start[i : i + STRETCH]).astype("<f2")
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i // STRETCH], pa.int32()), pa.array([n], pa.int64()), pa.array([moved.tobytes()], pa.binary())], names=["part", "stretch", "n", "moved"])

        share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text")
        sums = averaged(share.mapInArrow(run, "part int, stretch int, n bigint, moved binary"), share.rdd.getNumPartitions())
        sent.destroy()  # the sums are written; its blocks stay in the driver otherwise
        while sums:
            r = sums.pop()
            at = r["stretch"] * STRETCH
            model.weights[at : at + STRETCH] += (np.frombuffer(r["moved"], np.float32) / np.float32(r["n"])).reshape(-1, CLASSES)
        released()
    return model


def fit(docs: DataFrame, table: int = TABLE) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words."""
    counts = written(counted(docs), "counts")
    # words by quarter octaves of their counts: a few hundred rows
    bands = counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least"), F.count_if(F.col("c") == 1).alias("once")).orderBy(F.desc("band")).collect()
    least, held = None, 0
    for r in bands:
        held += r["words"]
        if held > table or r["least"] < 2:  # words seen once stand for the unseen
            break
        least = r["least"]
    kept = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    words = kept.column("h").to_numpy().view(np.uint64) if kept else np.zeros(0, np.uint64)
    vectors = np.stack([kept.column(f"v{k}").to_numpy() for k in range(SIGNS)], axis=1) if kept else np.zeros((0, SIGNS))
    model = Model(words, kept.column("c").to_numpy() if kept else np.zeros(0, np.int64), sum(r["tokens"] for r in bands), sum(r["words"] for r in bands), sum(r["once"] for r in bands), vectors)
    del kept, words, vectors
    released()
    return trained(docs, model), counts


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(model.__dict__))
    names = ["doc_id", "held_out", "th", "n_tokens", "n_known", "base", "score", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(sent.value)
        logs = np.log10(m.counts + 1.0)
        for b in batches:
            texts = b.column(2).to_pylist()
            for first, h, sizes in token_batches(texts):
                words, back = np.unique(h, return_inverse=True)
                at, known = m.look_up(words)
                classes, at, known = m.class_of(at, known)[back], at[back], known[back]
                rows, p = m.features(h, sizes, classes), np.empty(len(h))
                for i in range(0, len(h), BATCH):
                    z = m.log_classes(rows[i : i + BATCH])
                    p[i : i + BATCH] = z[np.arange(len(z)), classes[i : i + BATCH]]
                p /= np.log(10)
                ends = np.cumsum(sizes)
                if len(m.words):
                    p += np.where(known, m.share[at], 0.0)
                base = np.where(known, logs[at], 0.0) if len(m.words) else np.zeros(len(h))
                sums = [np.add.reduceat(x, ends - sizes) for x in (known.astype(np.int64), base, p)]
                rare, times = [], []
                for a, e in zip(ends - sizes, ends):
                    w, n = np.unique(h[a:e][~known[a:e]], return_counts=True)
                    rare.append(w.view(np.int64))
                    times.append(n.astype(np.int32))
                part, th = b.slice(first, len(sizes)), [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts[first : first + len(sizes)]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(th, np.uint64).view(np.int64)), pa.array(sizes.astype(np.int64)), *map(pa.array, sums), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=names)

    found = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, th bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<int>")
    found = written(found, "scored")
    sent.destroy()
    released()
    # tokens of words beyond the table meet their counts; no such word is frequent
    rare = found.select("doc_id", "th", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("doc_id", "th", F.col("r.rare").alias("h"), F.col("r.times").alias("n"))
    mass = float(model.rare + model.unseen)
    rare = rare.join(counts.select("h", "c"), "h", "left").select("doc_id", "th", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"), (F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(model.unseen)) / F.lit(mass))).alias("score"))
    own = found.select("doc_id", "th", "held_out", "n_tokens", "n_known", "base", "score", F.lit(1).alias("copies"))
    more = rare.select("doc_id", "th", F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("bigint").alias("n_tokens"), F.col("known").cast("bigint").alias("n_known"), "base", "score", F.lit(0).alias("copies"))
    total = own.union(more).groupBy("doc_id", "th").agg(F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base", "score", "copies")))
    each = {c: F.col(c) / F.col("copies") for c in ("base", "score")}
    space = float(np.log10(model.total + model.distinct + 1.0))
    out = total.select("doc_id", "held_out", "n_tokens", (F.col("n_known") / F.col("copies")).cast("bigint").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), (each["base"] - F.col("n_tokens") * F.lit(space)).alias("base_score"), each["score"].alias("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_"))
    return out.drop("_")


def op9_maxent(spark: SparkSession, folder: str) -> DataFrame:
    (docs,) = tables(spark, folder, "documents")
    return scored(docs, *fit(docs.where(~held_out())))
