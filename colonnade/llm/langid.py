"""Language identification of mixed text.

Each word gets a score for every language from character n-grams (naive Bayes with
word boundaries). The word's script first narrows the languages to those seen with
it. Viterbi with a penalty for each change of language then labels the words, and a
document's language is the one whose spans hold most letters.

A word is a run of letters (Unicode category L) with the marks on them, so numbers,
also such as a half or a circled two, are none.

The classifier learns from a bounded sample: about `SAMPLE` whole texts of at most
`LONG` characters of each of the `LANGUAGES` most frequent languages, those with the
least hash of doc_id and text. Null texts and texts without a letter are `und` with score
0. A null doc_id is not held out. Of languages with equal letters the first by name is
predicted. Very long texts are labelled whole (a word costs some hundred bytes
meanwhile). Repeated rows give repeated rows; other columns are passed over, whatever
their names. With no labelled text at all every document is `und`; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.llm.common import parts, released, small_batches, tables, written

#: Expected number of training texts of each language, n-grams kept of each, longest n-gram.
SAMPLE, KEPT, LONGEST = 400, 20_000, 4
#: Languages that are learned at most, and characters of a training text at most.
LANGUAGES, LONG = 200, 100_000
#: Words whose scores a worker remembers.
REMEMBERED = 250_000
PENALTY = 6.0
UND = "und"
#: First code points of script ranges and their names; fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]
WORD, MARK = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"\p{M}")
#: Finds the same where no mark and no letter-like number is in the text, and faster.
PLAIN = re.compile(r"[^\W\d_]+")


def marked(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return MARK.search(text) is not None


def words(text: str | None) -> list[str]:
    """Lower-case words of a text."""
    low = (text or "").lower()
    if not marked(low):
        found = PLAIN.findall(low)
        if not found or "".join(found).isalpha():
            return found
    return WORD.findall(low)


def script(c: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1]


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [*word, *[w[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(w) - n + 1)]]


def train(rows: list[tuple[str | None, str]]) -> dict:
    """rows: texts and their languages."""
    counts: dict[str, Counter] = {}
    scripts: dict[str, Counter] = {}
    for text, lang in rows:
        found = Counter(words(text))
        g, s = counts.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
        for w, n in found.items():
            s[script(w[0])] += n
            for x in grams(w):
                g[x] += n
    langs = sorted(counts)
    kept = sorted({x for c in counts.values() for x, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:KEPT]})
    totals = {k: sum(counts[k].values()) + 0.5 * (len(kept) + 1) for k in langs}
    # the last row is of n-grams that are not kept
    matrix = np.array([[math.log((counts[k][x] + 0.5) / totals[k]) for k in langs] for x in kept] + [[math.log(0.5 / totals[k]) for k in langs]], np.float32)
    allowed = {s: np.array([scripts[k][s] >= 0.001 * max(1, sum(scripts[k].values())) for k in langs]) for s in {s for c in scripts.values() for s in c}}
    return {"langs": langs, "rows": {x: i for i, x in enumerate(kept)}, "matrix": matrix, "allowed": allowed}


class Labeller:
    """Scores words, remembering the last many of them, and labels texts."""

    def __init__(self, model: dict, penalty: float = PENALTY):
        self.langs, self.rows, self.matrix, self.allowed, self.penalty = model["langs"], model["rows"], model["matrix"], model["allowed"], penalty
        self.narrows_latin = not self.allowed.get("latin", np.ones(1, bool)).all()
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, max(1, len(self.langs))))

    def learn(self, words: list[str]) -> None:
        """Scores words that are not known yet: the log probability of each language given the word.

        It is evened by the word's number of n-grams and is 0 at most.
        """
        get, none = self.rows.get, repeat(len(self.rows))
        found, sizes = array("q"), []
        for w in words:
            g = grams(w)
            found.extend(map(get, g, none))
            sizes.append(len(g))
        sizes = np.array(sizes)
        s = np.add.reduceat(self.matrix.take(found, axis=0).astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        for i, w in enumerate(words):
            fit = self.allowed.get(script(w[0])) if not w[0].isascii() or self.narrows_latin else None
            if fit is not None and fit.any():
                s[i, ~fit] = s[i].min() - 60.0
        s -= s.max(axis=1, keepdims=True)
        s = np.maximum(s - np.log(np.exp(s).sum(axis=1, keepdims=True)), -12.0)
        at = len(self.ids)
        while at + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at : at + len(words)] = s
        self.ids.update(zip(words, range(at, at + len(words))))

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), gain]), axis=0)[:-1]
        if (gain - low).max() < self.penalty:  # no run gains what one change costs
            return np.full(len(s), best)
        back, v = np.empty(s.shape, np.int8), s[0].tolist()
        kinds = range(s.shape[1])
        for t, row in enumerate(s[1:].tolist(), 1):
            top = max(v)
            j, moved = v.index(top), top - self.penalty
            came = [k if v[k] >= moved else j for k in kinds]
            v = [(v[k] if v[k] >= moved else moved) + row[k] for k in kinds]
            back[t] = came
        out = np.empty(len(s), np.int64)
        k = v.index(max(v))
        for t in range(len(s) - 1, -1, -1):
            out[t] = k
            k = back[t, k] if t else k
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, start, end) in characters of the text, in order."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.langs:
            return []
        # lower-casing word by word: the length of a text can change with its case
        labels = self.path(self.scores_of([m[0].lower() for m in found]))
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(found)]
        return [(self.langs[labels[a]], found[a].start(), found[b - 1].end()) for a, b in zip(cuts, cuts[1:])]

    def scores_of(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > REMEMBERED:
            self.forget()
        get = self.ids.get
        new = set(words).difference(self.ids)
        if new:
            self.learn([w for w in dict.fromkeys(words) if w in new])
        return self.scores.take(np.fromiter(map(get, words), np.int64, len(words)), axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.langs:
            return UND, 0.0
        labels = self.path(self.scores_of(found))
        letters = np.bincount(labels, weights=np.fromiter(map(len, found), np.float64, len(found)), minlength=len(self.langs))
        k = int(letters.argmax())
        return self.langs[k], float(letters[k] / letters.sum())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Learns from text and lang of the rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.char_length("text") <= LONG))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return train([])
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(sample / r["n"])) for r in sizes), F.lit(0.0))
    key = F.xxhash64(F.col("doc_id").cast("bigint"), "text")
    place = F.shiftrightunsigned(key, 11) / F.lit(2.0**53)
    # rows that repeat a text and doc_id have the same place; one stays, and the limit holds in any case
    chosen = rows.where(place < share).select("lang", "text", key.alias("key")).dropDuplicates(["lang", "key"])
    chosen = chosen.orderBy("key", "lang", "text").limit(2 * sample * len(sizes)).collect()
    return train([(r["text"], r["lang"]) for r in chosen])


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        labeller = Labeller(model)
        for b in parts(batches):
            found = [labeller.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the documents of no language, and those of which no language holds `least` of the letters. Written."""
    model, at = fit(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        labeller = Labeller(model)
        for b in parts(batches):
            found = [labeller.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UND and score >= least for lang, score in found], pa.bool_()))

    with small_batches(docs.sparkSession):
        return written(docs.mapInArrow(run, docs.schema), "identified")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    (docs,) = tables(spark, folder, "documents")
    return predicted(docs, fit(docs))
