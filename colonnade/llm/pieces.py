"""SentencePiece encoding and decoding by max-plus Viterbi.

A text is cut into vocabulary pieces so that the sum of their scores is greatest (at
equal sums the longest last piece wins, at every end). Characters outside the
vocabulary cost more than any piece and become bytes. Spaces are written as U+2581
and one is put in front, as the vocabulary file asks; decoding undoes both.

Where no piece holds a space after another character, a text falls apart before each
run of spaces. Such units are searched together, as lanes of numpy arrays that walk the
vocabulary's trie, and remembered.

A text longer than `CHUNK` characters is cut into chunks, wherever the cut falls, that
other tasks can take. A chunk gives a matrix: the best score from each state at its
start to each state at its end, a state being how far a piece reaches over the boundary.
Matrices are combined associatively by (max, +), in pairs at doubling distances, which
gives the scores of the states at every boundary; with them each chunk finds, by the
same choice at equal sums, from which state at its start each state at its end comes.
That fixes the states, and each chunk is then traced back on its own, so the pieces are
those of the text taken whole, whatever `CHUNK` is.

Null and empty texts have no pieces. Very long texts: a task holds one chunk of text at
a time, and of one text the matrices of all chunks (a 16th of the text's size). Ties
as above. Repeated rows, and rows with a null doc_id, give a row each. An empty table
gives an empty table. Other columns stay as they are, whatever their names. A U+2581 in
a text is decoded as a space, so such a text does not come back as it was.

The vocabulary file used was made for merging pairs, and its scores are ranks of merges.
The SentencePiece library, told by the file to merge, finds other ids, whose sum of
scores is never greater; it decodes these ids to the same text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colonnade.llm.common import fresh, lasting, released, removed, small_batches, tables, written

SPACE = "▁"
CHUNK = 1 << 15
#: Characters of the units whose pieces a worker remembers.
REMEMBERED = 1_000_000
#: Longer units are searched one by one.
LANE = 64
FILE = "piece_bpe_32k.model"
NONE = float("-inf")


def vocabulary(path: str | None = None) -> dict:
    """Pieces, scores and bytes of a SentencePiece file, small enough to travel with a task."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or public_tokenizers.path(FILE))
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    return {"pieces": [sp.id_to_piece(i) for i in range(n)], "scores": [float(sp.get_score(i)) for i in range(n)], "special": special, "bytes": [sp.is_byte(i) for i in range(n)]}


class Trie:
    """Pieces by their characters, as arrays: steps from node to node are looked up many at a time."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        letters = sorted({c for p in pieces for c in p})
        self.kinds = len(letters) + 1
        #: The number of each character, 0 of those in no piece.
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.kinds)
        nodes, parents, kinds, number = {"": 0}, [0], [0], {c: i for i, c in enumerate(letters, 1)}
        for p in pieces:
            for j in range(1, len(p) + 1):
                if p[:j] not in nodes:
                    nodes[p[:j]] = len(parents)
                    parents.append(nodes[p[: j - 1]])
                    kinds.append(number[p[j - 1]])
        self.score, self.id = np.full(len(parents), NONE), np.full(len(parents), -1, np.int32)
        for p, (score, i) in pieces.items():
            self.score[nodes[p]], self.id[nodes[p]] = score, i
        self.inner = np.zeros(len(parents), bool)
        self.inner[parents[1:]] = True
        self.first = np.full(self.kinds, -1, np.int64)
        keys = np.array(parents[1:], np.int64) * self.kinds + np.array(kinds[1:])
        top = np.array(parents[1:]) == 0
        self.first[np.array(kinds[1:])[top]] = np.flatnonzero(top) + 1
        # an open hash table: a node's key is its parent and its last character
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        rest, at = np.arange(len(keys)), self.slot(keys)
        while len(rest):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[at[put]], self.nodes[at[put]] = keys[rest[put]], rest[put] + 1
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, at = rest[left], (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The nodes one character on; -1 where there is none."""
        keys = nodes * self.kinds + kinds
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.nodes[at], -1).astype(np.int64)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.nodes[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Pieces:
    def __init__(self, v: dict):
        self.names = v["pieces"]
        plain = [i for i in range(len(self.names)) if not v["special"][i] and not v["bytes"][i]]
        self.score = {self.names[i]: (v["scores"][i], i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if v["bytes"][i]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.score))
        self.unknown = min(v["scores"][i] for i in plain) - 10.0
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.apart else "(?s).+")
        self.cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" if self.apart else "(?!)")
        self.trie = Trie(self.score)
        #: Scores of all beginnings of pieces; None of those that are none themselves.
        self.walk = {p[:j]: None for p in self.score for j in range(1, len(p))}
        self.walk.update((p, s) for p, (s, _) in self.score.items())
        self.known: dict[str, bytes] = {}
        self.held = 0
        # what each id is in a text, and its part of a sum: a character outside the vocabulary counts with its first byte
        skip = {i for i in range(len(self.names)) if v["special"][i]}
        self.raw = pa.array([b"" if i in skip else bytes((self.byte_of[i],)) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)], pa.binary())
        self.value = np.array([0.0 if self.byte_of.get(i, 0) & 0xC0 == 0x80 else self.unknown if i in self.byte_of else s for i, s in enumerate(v["scores"])])

    @staticmethod
    def normal(text: str | None) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def ids_of(self, piece: str) -> tuple[int, ...]:
        found = self.score.get(piece)
        return (found[1],) if found else tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))

    def search(self, s: str, start: list[float], end: int) -> tuple[list[float], list[int]]:
        """start: scores at the first places of s. The best score of each place, and the length of the last piece there.

        Pieces begin before `end` and may reach over it. 0: no piece ends there, or one that came over the start.
        """
        n, walk, longest = len(s), self.walk, self.longest
        best, back = (list(start) + [NONE] * (n + 1))[: n + 1], [0] * (n + 1)
        for i in range(min(end, n)):
            here = best[i]
            if here == NONE:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                cost = walk.get(s[i:j], False)
                gain = cost if cost is not None and cost is not False else self.unknown if j == i + 1 else NONE
                if here + gain > best[j]:
                    best[j], back[j] = here + gain, j - i
                if cost is False:
                    break
        return best, back

    def spelled(self, s: str, back: list[int], j: int, to: int = 0) -> list[int]:
        """Ids of the pieces from place `to` to place j."""
        found = []
        while j > to:
            found.append(self.ids_of(s[j - back[j] : j]))
            j -= back[j]
        return [x for ids in reversed(found) for x in ids]

    def solved(self, units: list[str]) -> list[bytes]:
        """Pieces of texts that do not fall apart, as little-endian 32-bit ids."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] <= LANE) & (sizes[order] > 0)]
        out: list[bytes] = [b""] * len(units)
        if len(order):
            ids, ends = self.lanes(np.frombuffer("".join([units[k] for k in order]).encode("utf-32-le", "surrogatepass"), "<u4"), sizes[order])
            flat, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
            for k, a, b in zip(order.tolist(), [0, *ends], ends):
                out[k] = flat[a:b]
        for k in np.flatnonzero(sizes > LANE).tolist():
            s = units[k]
            out[k] = np.array(self.spelled(s, self.search(s, [0.0], len(s))[1], len(s)), "<i4").tobytes()
        return out

    def lanes(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of these sizes, in descending order, and where those of each end; points: their characters."""
        t, n, kinds = self.trie, len(sizes), self.trie.kind[points]
        place = np.cumsum(sizes) - sizes + np.arange(n)  # of each unit's start: one place more than characters
        best, back, last = np.full(len(kinds) + n, NONE), np.zeros(len(kinds) + n, np.int64), np.zeros(len(kinds) + n, np.int32)
        best[place] = 0.0
        for i in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -i))  # units longer than i
            slot, left = place[:m] + i, sizes[:m] - i
            at = slot - np.arange(m)
            here, node, d = best[slot], t.first[kinds[at]], 1
            alone = np.flatnonzero((node < 0) | (t.id[node] < 0))
            if len(alone):  # characters outside the vocabulary, by their code points
                worse = best[slot[alone] + 1] < here[alone] + self.unknown
                to = slot[alone[worse]] + 1
                best[to], back[to], last[to] = here[alone[worse]] + self.unknown, 1, ~points[at[alone[worse]]].astype(np.int32)
                real = np.flatnonzero(node >= 0)
                at, slot, left, here, node = at[real], slot[real], left[real], here[real], node[real]
            while len(at):
                total = here + t.score[node]
                better = np.flatnonzero(total > best[slot + d])
                to = slot[better] + d
                best[to], back[to], last[to] = total[better], d, t.id[node[better]]
                go = np.flatnonzero((left > d) & t.inner[node])
                node = t.step(node[go], kinds[at[go] + d])
                go = go[node >= 0]
                at, slot, left, here, node, d = at[go], slot[go], left[go], here[go], node[node >= 0], d + 1
        units, slot, floor = np.arange(n), place + sizes, place
        found, of = [], []
        while len(units):
            found.append(last[slot])
            of.append(units)
            slot = slot - back[slot]
            on = slot > floor
            units, slot, floor = units[on], slot[on], floor[on]
        of, found = np.concatenate(of[::-1]), np.concatenate(found[::-1])
        order = np.argsort(of, kind="stable")
        of, found = of[order], found[order]
        if (found < 0).any():  # bytes of unknown characters
            spelled = {c: self.ids_of(chr(~c)) for c in np.unique(found[found < 0]).tolist()}
            many = np.ones(len(found), np.int64)
            for c, ids in spelled.items():
                many[found == c] = len(ids)
            first, whole = np.cumsum(many) - many, np.repeat(found, many)
            for c, ids in spelled.items():
                whole[first[found == c][:, None] + np.arange(len(ids))] = ids
            of, found = np.repeat(of, many), whole
        return found, np.cumsum(np.bincount(of, minlength=n))

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """Pieces of each text, as little-endian 32-bit ids."""
        units, texts = set(), [self.normal(t) for t in texts]
        for t in texts:
            units.update(self.units.findall(t))
        self.learn(units)
        # texts are split again: their units together take many times the room of the texts
        known = self.known
        return [b"".join([known[u] for u in self.units.findall(t)]) for t in texts]

    def learn(self, units: set[str]) -> None:
        if self.held > REMEMBERED:  # frequent units come again soon
            self.known, self.held = {}, 0
        new = list(units.difference(self.known))
        self.known.update(zip(new, self.solved(new)))
        self.held += sum(map(len, new))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded([text])[0], "<i4").tolist()

    def sum(self, ids: np.ndarray) -> float:
        return float(self.value[ids].sum())

    def texts(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids."""
        raw = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.raw.take(ids.values)), b"")
        return [(r or b"").decode("utf-8", "replace").removeprefix(" ") for r in raw.to_pylist()]

    def decode(self, ids: list[int]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int32())))[0]

    # chunks of giant texts: `own` characters of s, and what follows them up to the longest piece

    def cuts(self, s: str, own: int) -> tuple[int, int] | None:
        """The first and last places inside a chunk where the text falls apart, over which no piece reaches."""
        found = self.cut.search(s, 0, own)
        if not found or not 0 < found.start() < own:
            return None
        last = s.rfind(SPACE, 0, own)
        while s[last - 1] == SPACE or last == own:
            last -= 1
        return found.start(), last

    def middle(self, s: str) -> bytes:
        units = self.units.findall(s)
        self.learn(set(units))
        return b"".join([self.known[u] for u in units])

    def reach(self, s: str, end: int, width: int) -> np.ndarray:
        """(width, places): the best score of each place from each state at the start, where pieces begin before `end`."""
        n, walk = len(s), self.walk
        best = np.full((n + 1, width), NONE)
        k = min(width, n + 1)
        best[np.arange(k), np.arange(k)] = 0.0
        for i in range(min(end, n)):
            here = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                cost = walk.get(s[i:j], False)
                gain = cost if cost is not None and cost is not False else self.unknown if j == i + 1 else NONE
                if gain > NONE:
                    np.maximum(best[j], here + gain, out=best[j])
                if cost is False:
                    break
        return best.T

    def matrix(self, s: str, own: int) -> np.ndarray:
        k = self.longest
        out = np.full((k, k), NONE)
        if cut := self.cuts(s, own):
            a, b = cut
            head = self.reach(s[:a], a, k)[:, a]
            tail = np.array(self.search(s[b:], [0.0], own - b)[0][own - b :][:k])
            out[:, : len(tail)] = head[:, None] + (self.sum(np.frombuffer(self.middle(s[a:b]), "<i4")) + tail)[None, :]
        else:
            found = self.reach(s, own, k)[:, own : own + k]
            out[:, : found.shape[1]] = found
        return out

    def ways(self, s: str, own: int, arrive: np.ndarray) -> np.ndarray:
        """For each state at the end of a chunk the state at its start, if those there have the scores `arrive`."""
        out = np.zeros(self.longest, np.int32)
        cut = self.cuts(s, own)
        end, s = (cut[0], s[: cut[0]]) if cut else (own, s)
        best, back = self.search(s, arrive.tolist(), end)
        for o in range(1 if cut else min(self.longest, len(s) + 1 - end)):
            j = end + o
            if best[j] > NONE:
                while back[j]:
                    j -= back[j]
                out[o] = j
        if cut:  # all ways come through the first cut
            out[:] = out[0]
        return out

    def trace(self, s: str, own: int, into: int, out: int) -> bytes:
        """Pieces of a chunk between its states at the start and at the end."""
        start, end = [NONE] * into + [0.0], own + out
        pack = lambda ids: np.array(ids, "<i4").tobytes()
        if cut := self.cuts(s, own):
            a, b = cut
            head = pack(self.spelled(s, self.search(s[:a], start, a)[1], a, into))
            last = s[b:end]
            return head + self.middle(s[a:b]) + pack(self.spelled(last, self.search(last, [0.0], own - b)[1], len(last)))
        return pack(self.spelled(s, self.search(s[:end], start, own)[1], end, into))


def loaded(v: dict) -> Pieces:
    """The pieces of v; a worker keeps those it used last, and what they remember, until another operator runs in it."""
    if not lasting or lasting[0][0] != v:
        released()
        lasting.append((v, Pieces(v)))
    return lasting[0][1]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) products of the matrices a[i] and b[i]."""
    out = np.full(np.broadcast_shapes(a.shape[:-1] + (1,), b.shape[:-2] + (1, b.shape[-1])), NONE)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return out


def arriving(matrices: np.ndarray) -> np.ndarray:
    """The best score of each state before each chunk of a text that starts in state 0.

    An inclusive scan at doubling distances: after a round each matrix stands for twice
    as many chunks, in any order of combination.
    """
    total, step = matrices.copy(), 1
    while step < len(total):
        total[step:] = combined(total[:-step], total[step:])
        step *= 2
    out = np.full((len(matrices), matrices.shape[-1]), NONE)
    out[0, 0] = 0.0
    out[1:] = total[:-1, 0]
    return out


def _giants(docs: DataFrame, v: dict, chunk: int) -> DataFrame:
    """(digest, ids) of texts (digest, text) of more than `chunk` characters; each different one once. Written."""
    longest, key = max(map(len, v["pieces"])), "digest string, k int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for digest, text in zip(b.digest, b.text):
                s = Pieces.normal(text)
                for i in range(0, len(s), 16 * chunk):
                    rows = [(digest, j // chunk, s[j : j + chunk + longest], min(chunk, len(s) - j)) for j in range(i, min(len(s), i + 16 * chunk), chunk)]
                    yield pd.DataFrame(rows, columns=["digest", "k", "s", "own"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = loaded(v)
        for b in batches:
            yield b[["digest", "k"]].assign(m=[p.matrix(s, n).astype("<f8").tobytes() for s, n in zip(b.s, b.own)])

    def arrive(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        side = int((len(group.m.iloc[0]) // 8) ** 0.5)
        found = arriving(np.stack([np.frombuffer(m, "<f8").reshape(side, side) for m in group.m]))
        return group[["digest", "k"]].assign(a=[x.astype("<f8").tobytes() for x in found])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = loaded(v)
        for b in batches:
            yield b[["digest", "k"]].assign(w=[p.ways(s, n, np.frombuffer(a, "<f8")).astype("<i4").tobytes() for s, n, a in zip(b.s, b.own, b.a)])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group, states = group.sort_values("k"), [0]
        for w in reversed(list(group.w)):
            states.append(int(np.frombuffer(w, "<i4")[states[-1]]))
        states.reverse()
        return group[["digest", "k"]].assign(into=states[:-1], out=states[1:])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = loaded(v)
        for b in batches:
            yield b[["digest", "k"]].assign(ids=[p.trace(s, n, i, o) for s, n, i, o in zip(b.s, b.own, b.into, b.out)])

    # each step is written, so that one kind of Python worker runs at a time and its batches are small
    with small_batches(docs.sparkSession, 64):
        rows = written(docs.dropDuplicates(["digest"]).mapInPandas(cut, f"{key}, s string, own int").repartition("digest", "k"), "chunks")
        matrices = written(rows.mapInPandas(measure, f"{key}, m binary"), "matrices")
        arrived = written(matrices.groupBy("digest").applyInPandas(arrive, f"{key}, a binary"), "arrived")
        ways = written(rows.join(arrived, ["digest", "k"]).mapInPandas(go, f"{key}, w binary"), "ways")
        states = written(ways.groupBy("digest").applyInPandas(scan, f"{key}, into int, out int"), "states")
        found = written(rows.join(states, ["digest", "k"]).mapInPandas(trace, f"{key}, ids binary"), "traced")
    removed(rows, matrices, arrived, ways, states)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: F.hex(x["ids"])), "")
    out = written(found.groupBy("digest").agg(F.unhex(joined).alias("ids")), "giants")
    removed(found)
    return out


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encoded(docs: DataFrame, v: dict, to: str = "token_ids", chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """docs and the piece ids of each whole text, as a written table. `keep`: the columns that stay, all by default.

    A column that is named as `to` is replaced.
    """
    spark, keep = docs.sparkSession, [c for c in keep or docs.columns if c.lower() != to.lower()]
    of, digest, giant = fresh(docs, "text_of", "digest_of", "giant_of")
    text = F.col("text")
    size, big_text = F.coalesce(F.char_length(text), F.lit(0)), docs.where(F.char_length(text) > chunk).select(F.md5(text.cast("binary")).alias("digest"), "text")
    giants = None if big_text.isEmpty() else _giants(big_text, v, chunk)
    kept = [F.col(f"`{c}`") for c in keep]
    # a text that stays is sent once
    at = next((i for i, c in enumerate(keep) if c.lower() == "text"), len(keep))
    small = docs.where(size <= chunk).select(*kept, *([text.alias(of)] if at == len(keep) else []))
    schema = T.StructType([*small.schema.fields[: len(keep)], T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(v)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], _lists(p.encoded(b.column(at).to_pylist()))], names=schema.names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(b.column(b.num_columns - 1).to_pylist())], names=schema.names)

    with small_batches(spark, 500):
        out = small.mapInArrow(run, schema)
        if giants is not None:
            big = docs.where(size > chunk).withColumn(digest, F.md5(text.cast("binary"))).join(giants.toDF(digest, giant), digest)
            out = out.union(big.select(*kept, giant).mapInArrow(unpack, schema))
        out = written(out, "pieces")
    removed(giants)
    return out


def decoded(df: DataFrame, v: dict, ids: str = "token_ids") -> DataFrame:
    """doc_id and, from the ids alone, n_tokens, ids_crc32 and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(v)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                # the slice may begin within its values
                ends, values = part.column(1).offsets.to_numpy(), part.column(1).values.to_numpy()
                values, ends = values[ends[0] : ends[-1]].astype("<i4", copy=False), ends - ends[0]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(p.texts(lists), pa.string())], names=["doc_id", "n_tokens", "ids_crc32", "decoded"])

    return df.select(F.col("doc_id").cast("bigint"), ids).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded string")


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), and the SHA-256 of the text decoded from them."""
    v = vocabulary()
    ids = encoded(tables(spark, folder, "documents")[0].select("doc_id", "text"), v, keep=["doc_id"])
    return decoded(ids, v).select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
