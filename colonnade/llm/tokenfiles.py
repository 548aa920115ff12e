"""Token-id files coded by an adaptive context-mixing range coder.

Texts are tokenised, an end id is appended to each, and the ids of ascending doc_ids are
written as frames: rows of a Parquet table in the shared folder, each with whole
documents, whose payload can be decoded by itself. A payload is `CMR3`, the number of
blocks, and for each block its tokens, its 16-bit words and the CRC-32 of its ids,
all little-endian unsigned 32-bit, then the words of all blocks. Every block starts from
the same state (it is reset), so a damaged block harms no other; reading checks each sum.

The words of a block begin with its head: its different ids (ascending; their low bits, and their high parts as gaps between ones)
and the classes of their counts in the block, powers of two. The ids are then numbered by descending class, and the range coder has the block as these ranks.
The model's order 2 guesses the id last seen after the two ids before, its order 1 the
one last seen after the id before, each with how often in a row it was right. That of order 2 is asked if it was right before, else that
of order 1. Whether it is right is a yes-or-no question, whose probability is mixed from three: estimates of
order 2 and of order 1, and the share that order 0 gives the guessed id; estimates and the weights of the
mix are learned at fixed places of a block, from what was asked since the last. If the guess is wrong, order 0 codes the id by
its class, in the same step. All arithmetic gives the same on any machine: it is in integers, or in divisions of floats whose
whole parts are exact. All blocks of a task are coded in step, a block to a lane of numpy arrays.

Ids are below 65,536. A null text is as an empty one; null doc_ids come first. Equal
doc_ids follow each other by their texts, and lie in one range of the table, so a table
whose doc_ids are largely the same has a long range. Very long texts are tokenised whole
and lie in one frame. Repeated rows give a row each. Other columns are passed over, whatever
their names; an empty table gives no file rows.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colonnade.llm.common import lasting, released, tables, written

BLOCK, FRAME, LANES = 4096, 1 << 20, 2048  # tokens of a block, of a frame (at least), blocks in step
CONTEXTS = 1 << 10
SHARES, WEIGHT = 1 << 13, 1 << 18
#: The places of a block at which the model of guesses learns, and its end.
LEARNED = [*range(0, 64, 16), *range(64, 512, 64), *range(512, BLOCK + 1, 128)]
RATE = 13  # of the weights, as a power of two that divides
#: How often guesses of order 1 and of order 2 are right at first, of 2, in 256ths: by whether both are the same, by runs.
PRIOR = np.array([[[20, 100, 160, 200], [60, 200, 300, 360]], [[20, 160, 240, 300], [60, 240, 340, 400]]], np.int64)
FILE, END_ID = "byte_bpe_50k.json", 0
KEPT_WORDS = 600_000  # words whose ids a worker keeps
MARKS = ".,;:!?$&%*#"  # cut from the ends of words
SLICE = 1 << 23  # bytes of text whose words are looked up at a time
_DESCENDING = np.uint8(16)
_NONE, _ONE, _TWO, _RUN, _FOUR, _RANK = map(np.uint16, (0, 1, 2, 3, 4, 16))

class Tokens:
    """The tokenizers library; strings of special tokens in a text are those tokens, as the library has it, unless `plain`.

    A byte-level tokenizer ends a piece before every space that a visible character follows, and before the first of several
    white characters, so such texts are split at spaces and line ends, the library encodes each distinct word (with its space, or
    its line end) once, and the ids of words are kept. It also ends a piece between a letter and marks: a word that ends in marks is put together
    from the word without them and those. Texts with other spaces, with several line ends where that does not hold or with strings of added tokens, and all
    texts of other tokenizers, go to the library whole.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not rules.get("normalizer")
        # for words of ASCII letters behind spaces, cut there without the rules; each comes once, so nothing is kept inside
        self.letters = Tokenizer.from_file(path) if self.by_words else self.tokenizer
        if self.by_words:
            self.letters.pre_tokenizer = pre_tokenizers.Metaspace(replacement="\u0120", prepend_scheme="never", split=True)
            self.letters.model._resize_cache(0)
        self.added = [t["content"] for t in rules.get("added_tokens", [])]
        self.spaced = np.zeros(1 << 16, bool)
        self.spaced[[i for word, i in rules["model"]["vocab"].items() if word[0] in "\u0120\u010a"]] = True
        # the places of words in the lists below, -1 for those that cannot stand alone; place 0 is an end, those of first words have no space
        self.places: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.chars = 0
        self.ids, self.n_ids = np.full(1 << 16, END_ID, np.uint16), 1
        self.starts, self.lengths, self.met, self.n = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1

    def forget(self) -> None:
        """Keeps the words met in two slices or more since the last time, if they are not too many or too long."""
        kept = self.met[: self.n] > 1
        self.firsts, self.met[:] = {}, 0
        words = {w: p for w, p in self.places.items() if kept[p] and p > 0}
        if len(words) > KEPT_WORDS // 2 or sum(map(len, words)) > 8 * KEPT_WORDS:
            words = {}
        ids, lengths = self.gathered(np.fromiter(words.values(), np.int64, len(words)))
        self.places, self.chars, self.n, self.n_ids = {}, 0, 1, 1
        self.keep(self.places, list(words), ids, lengths)

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        lengths = self.lengths.take(places)
        return self.ids.take(np.repeat(self.starts.take(places) - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())), lengths

    def library(self, texts: list[str], letters: bool = False) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in (self.letters if letters else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, places: dict[str, int], words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        def room(a: np.ndarray, n: int) -> np.ndarray:
            return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

        k, n = self.n + len(words), self.n_ids + len(ids)
        self.ids, self.starts, self.lengths, self.met = room(self.ids, n), room(self.starts, k), room(self.lengths, k), room(self.met, k)
        self.ids[self.n_ids : n], self.lengths[self.n : k] = ids, lengths
        self.starts[self.n : k] = self.n_ids + np.cumsum(lengths) - lengths
        places.update(zip(words, range(self.n, k)))
        self.chars += sum(map(len, words))
        self.n, self.n_ids = k, n

    def looked_up(self, words: list[str], first: bool) -> np.ndarray:
        """The places of different words; new ones are encoded."""
        known = self.firsts if first else self.places
        out = np.fromiter(map(known.get, words, repeat(-2)), np.int64, len(words))
        at = np.flatnonzero(out == -2)
        if odd := [i for i in at.tolist() if _odd(words[i], first)]:
            out[odd] = -1
            known.update((words[i], -1) for i in odd)
            at = np.flatnonzero(out == -2)
        bare = [words[i] if first else words[i].rstrip(MARKS) for i in at.tolist()]
        marked = np.array([len(b) < len(words[i]) and b[-1:].isalpha() and b[-1] < "\u0250" for i, b in zip(at.tolist(), bare)], bool)
        plain = at[~marked]
        letters = np.array([not first and words[i].isascii() and words[i].isalpha() for i in plain.tolist()], bool)
        for own, cut in ((plain[letters], True), (plain[~letters], False)):
            if len(own):
                new = [words[i] for i in own.tolist()]
                ids, lengths = self.encoded(new, first, cut)
                out[own] = np.arange(self.n, self.n + len(new))
                self.keep(known, new, ids, lengths)
        if marked.any():
            new, bare = [words[i] for i in at[marked].tolist()], [bare[k] for k in np.flatnonzero(marked).tolist()]
            both = [(bare, False), ([w[len(b) :] for w, b in zip(new, bare)], True)]
            places = np.empty((len(new), 2), np.int64)
            for k, (texts, alone) in enumerate(both):
                different = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                places[:, k] = self.looked_up(list(different), alone).take(np.fromiter(map(different.get, texts), np.int64, len(texts)))
            ids, lengths = self.gathered(places.reshape(-1))
            out[at[marked]] = np.arange(self.n, self.n + len(new))
            self.keep(known, new, ids, lengths.reshape(-1, 2).sum(axis=1))
        return out

    def encoded(self, words: list[str], first: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words one after the other, and how many each has."""
        texts = words if first else [w if w[0] == "\n" else " " + w for w in words]
        if not first:  # strings of many words are faster than those of one or of all
            ids = np.concatenate(self.library(["".join(texts[i : i + 256]) for i in range(0, len(texts), 256)], letters))
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(words):
                return ids, np.diff(starts, append=len(ids))
        own = self.library(texts, letters)
        return np.concatenate(own), np.array(list(map(len, own)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, with the end."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.full(len(texts), not self.by_words)
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        if len(rows := np.flatnonzero(~whole)):
            parts = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)) if whole.any() else texts, "\n", " \n"), " ")
            ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
            heads = np.concatenate([[0], ends[:-1]])
            words = parts.flatten().dictionary_encode()
            if len(self.places) + len(self.firsts) > KEPT_WORDS or self.chars > 16 * KEPT_WORDS:
                self.forget()
            distinct, heads_of = words.dictionary.to_numpy(zero_copy_only=False), words.indices.take(pa.array(heads)).to_numpy()
            places = self.looked_up(distinct.tolist(), False)
            self.met[places[places > 0]] += 1
            place = places.take(words.indices.to_numpy())
            # three white characters or more, or two at the end
            ends_line = words.indices.to_numpy() == pc.index(words.dictionary, "\n").as_py()
            place[1:][ends_line[1:] & ends_line[:-1]] = -1
            different, back = np.unique(heads_of, return_inverse=True)
            place[heads] = self.looked_up(distinct[different].tolist(), True)[back]
            whole[rows] = np.minimum.reduceat(place, heads) < 0
            # an end behind the words of each text
            with_ends = np.zeros(len(place) + len(rows), np.int64)
            with_ends[np.arange(len(place)) + np.repeat(np.arange(len(rows)), ends - heads)] = np.maximum(place, 0)
            ids, n = self.gathered(with_ends)
            cuts = np.cumsum(n)[ends + np.arange(len(rows))]
            for row, a, e in zip(rows.tolist(), [0, *cuts.tolist()], cuts.tolist()):
                out[row] = ids[a:e]
        if len(rows := np.flatnonzero(whole)):
            for row, ids in zip(rows.tolist(), self.library(texts.take(pa.array(rows)).to_pylist())):
                out[row] = np.append(ids, np.uint16(END_ID))
        return out


def _odd(word: str, first: bool) -> bool:
    """Whether a word, which begins a text or follows a space if it has no line end before it, can't be encoded by itself."""
    if first:
        return word[-1:].isspace()
    return not word or word != "\n" and (word[-1].isspace() or word[0].isspace() and (word[0] != "\n" or word[1].isspace()))


def kept_tokens(path: str) -> Tokens:
    """What a worker keeps from task to task: the words it has met need not be encoded again."""
    if not lasting or lasting[0][0] != ("tokens", path):
        released()
        lasting.append((("tokens", path), Tokens(path)))
    return lasting[0][1]


def _squash_table() -> np.ndarray:
    """12-bit probabilities of logits from -2047 to 2047 in 256ths. Exact halves are rounded the same everywhere."""
    return np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


SQUASH = _squash_table()
#: The first logit at which `SQUASH` reaches a share, in `SHARES`.
STRETCH = (np.searchsorted(SQUASH, np.minimum(np.arange(SHARES + 1) * 4096 // SHARES, 4095)) - 2047).clip(-2047, 2047).astype(np.int64)
#: The class of a count: the power of two that is nearest by ratio.
CLASSES = np.array([(n * n).bit_length() // 2 for n in range(BLOCK + 1)], np.uint8)


class Guesses:
    """The id last seen after each context of order 1 and of order 2: a rank, and in the 4 bits below it how often it was right in a row, 3 at most."""

    def __init__(self, lanes: int, wide: int):
        every = np.arange(lanes, dtype=np.int64)
        self.cells = np.zeros(lanes * (wide + 1 + CONTEXTS), np.uint16)
        self.one, self.two = every * (wide + 1), lanes * (wide + 1) + every * CONTEXTS
        self.keys = np.stack([self.one + wide, self.two])  # the start is a context of its own
        self.last = np.zeros(lanes, np.int64)

    def look(self, n: int) -> np.ndarray:
        return self.cells.take(self.keys[:, :n])

    def learn(self, n: int, cells: np.ndarray, now: np.ndarray) -> None:
        """now: ranks, as int64."""
        found = now.astype(np.uint16) << _FOUR
        runs = cells ^ found  # below 16 where the guess was right
        self.cells[self.keys[:, :n]] = found + (np.minimum(runs, _TWO) + _ONE) * (runs < _RANK)
        np.add(self.one[:n], now, out=self.keys[0, :n])
        np.add(self.two[:n], (now * 309 + self.last[:n]) & (CONTEXTS - 1), out=self.keys[1, :n])
        self.last[:n] = now


def guessed(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states of both orders, one of 32, and the rank that is guessed: that of order 2 if it was right before."""
    one, two = cells[..., 0, :], cells[..., 1, :]
    sure = two & _RUN
    states = (((one ^ two) < _RANK).astype(np.uint16) << _TWO | sure) << _TWO | one & _RUN
    return states, np.where(sure > _NONE, two, one) >> _FOUR


class Mixer:
    """The probability that a guess is right in all lanes: estimates of order 2 and of order 1 and the share of order 0, mixed by learned weights. All in integers.

    What a stretch of the block has shown is learned at its end.
    """

    def __init__(self, zero: Zero):
        lanes = len(zero.total)
        # of order 1 and order 2, by run and by whether both guess the same: how often asked and right
        self.asked = np.full((2, lanes, 2, 4), 2, np.int64)
        self.right = np.broadcast_to(PRIOR[:, None], self.asked.shape).copy()
        self.weights = np.full((3, lanes), 22_000, np.int64)
        self.rows, self.class_rows = np.arange(lanes, dtype=np.int64) * 32, np.arange(lanes, dtype=np.int64) * 16
        self.zero = STRETCH.take((SHARES << np.arange(16)) // zero.total[:, None], mode="clip")
        self.renew()

    def renew(self) -> None:
        self.logits = STRETCH.take(self.right * (SHARES // 256) // self.asked)
        one, two = self.logits * self.weights[:2, :, None, None]
        self.sums = ((one[:, :, None, :] + two[:, :, :, None]) >> 16).reshape(-1).astype(np.int32)
        self.zeros = ((self.zero * self.weights[2, :, None] >> 16) + 2047).reshape(-1).astype(np.int32)

    def ask(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """states, kinds (classes of the guesses): of the first lanes, in one place or in several."""
        n = states.shape[-1]
        return SQUASH.take(self.sums.take(self.rows[:n] + states) + self.zeros.take(self.class_rows[:n] + kinds), mode="clip")

    def learn(self, states: np.ndarray, kinds: np.ndarray, p: np.ndarray, right: np.ndarray, there: np.ndarray | None) -> None:
        """What was asked at the places of a stretch (places, lanes). there: if some lanes have ended, those that have not."""
        n = states.shape[1]
        told = (right.astype(np.int64) << 28) + (1 << 20) + p
        error = (right.astype(np.int64) << 12) - p
        if there is not None:
            told, error = told * there, error * there
        told = np.bincount((self.rows[:n] + states).reshape(-1), told.reshape(-1), 32 * n).astype(np.int64).reshape(n, 2, 4, 4)
        told = np.stack([told.sum(axis=2), told.sum(axis=3)])
        asked, found = (told >> 20) & 255, told >> 28
        self.asked[:, :n] += asked
        self.right[:, :n] += found << 8
        errors = (found << 12) - (told & ((1 << 20) - 1))
        self.weights[:2, :n] += (self.logits[:, :n] * errors).sum(axis=(2, 3)) >> RATE
        self.weights[2, :n] += (self.zero.take(self.class_rows[:n] + kinds) * error).sum(axis=0) >> RATE
        np.clip(self.weights, -WEIGHT, WEIGHT, out=self.weights)
        self.renew()


class Zero:
    """Order 0 in all lanes: ids have shares by the classes of their counts in the block, which are powers of two.

    Ranks go by descending class, so each share begins at a multiple of its width. Those of 2 and of 1 begin at multiples of 8, so that
    any 8 shares from such a one on are of one width or of one rank: a table of these leads to the rank of a share.
    """

    def __init__(self, classes: np.ndarray, distinct: np.ndarray, search: bool):
        """classes: (lanes, ranks), descending; of ranks that a lane does not have, any."""
        lanes, self.wide = classes.shape
        row = self.wide + 33
        # a cache line more, as equal places of all would meet in a few sets
        self.rows, self.table_rows = np.arange(lanes, dtype=np.int64) * row, np.arange(lanes, dtype=np.int64) * (SHARES // 8 + 32)
        kinds, firsts = np.zeros((lanes, row), np.uint8), np.zeros((0 if search else lanes, row), np.uint16)
        table, self.total = np.zeros((lanes if search else 0, SHARES // 8 + 32), np.uint16), np.zeros(lanes, np.int64)
        for i in range(0, lanes, 64):
            there = np.arange(self.wide) < distinct[i : i + 64, None]
            own = classes[i : i + 64].astype(np.int64)
            sums = (there << own).sum(axis=1)
            own *= (sums <= SHARES - 16)[:, None]  # else the block is damaged
            sums = (there << own).sum(axis=1)
            own += np.frexp((SHARES - 16) / sums)[1].astype(np.int64)[:, None] - 1
            widths = there << own
            ends = np.cumsum(widths, axis=1)
            for kind in (1, 0):
                before = (widths * (own > kind)).sum(axis=1) if kind else (ends * there).max(axis=1) - (widths * (own == 0)).sum(axis=1)
                ends += (-before & 7)[:, None] * (own <= kind)
            starts = ends - widths
            kinds[i : i + 64, : self.wide], self.total[i : i + 64] = own, (ends * there).max(axis=1)
            if search:
                lane, rank = np.nonzero(there[:, 1:])
                n = SHARES // 8 + 1
                begun = np.bincount(lane * n + ((starts[lane, rank + 1] + 7) >> 3), minlength=len(sums) * n).reshape(-1, n)
                ranks = np.cumsum(begun[:, :-1], axis=1)
                table[i : i + 64, : n - 1] = ranks << 4 | np.take_along_axis(own, ranks, axis=1)
            else:
                firsts[i : i + 64, : self.wide] = starts
        self.kinds, self.firsts, self.table = kinds.reshape(-1), firsts.reshape(-1), table.reshape(-1)
        self.part = (1 << 29) // self.total  # shares are parts of a width by a product, not by a division

    def kind(self, ranks: np.ndarray) -> np.ndarray:
        return self.kinds.take(self.rows[: ranks.shape[-1]] + ranks)


def _low_bits(distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp((top + 1) // distinct)[1].astype(np.int64) - 1, 0)


def _heads(ids: list[np.ndarray], classes: list[np.ndarray]) -> list[np.ndarray]:
    """The words before the code words of each block: how many ids, the last of them, the bits of the classes; then the low bits of ids, their high parts and the classes, both as gaps between ones."""
    if not ids:
        return []
    distinct = np.array(list(map(len, ids)), np.int64)
    starts = np.cumsum(distinct) - distinct
    every, kinds = np.concatenate(ids).astype(np.int64), np.concatenate(classes).astype(np.int64) + 1
    top, own = every[starts + distinct - 1], np.arange(len(every)) - np.repeat(starts, distinct)
    low, unary = _low_bits(distinct, top), np.add.reduceat(kinds, starts)
    words = (distinct * (low + 1) + (top >> low) + unary + 15) // 16
    at = 16 * (np.cumsum(words) - words)
    bits = np.zeros(16 * words.sum(), np.uint8)
    lows, ats = np.repeat(low, distinct), np.repeat(at, distinct) + own * np.repeat(low, distinct)
    for b in range(int(low.max())):
        some = lows > b
        bits[ats[some] + b] = every[some] >> b & 1
    high = at + distinct * low
    bits[np.repeat(high, distinct) + (every >> lows) + own] = 1
    sums = np.cumsum(kinds)
    bits[sums - 1 + np.repeat(high + distinct + (top >> low) - (sums[starts] - kinds[starts]), distinct)] = 1
    packed = np.packbits(bits, bitorder="little").view("<u2")
    at //= 16
    return [np.concatenate([np.array([d, t, u], np.uint16), packed[a : a + n]]) for d, t, u, a, n in zip(distinct.tolist(), top.tolist(), unary.tolist(), at.tolist(), words.tolist())]


def _ones(bits: np.ndarray, at: np.ndarray, length: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The places of so many ones of each lane in its bits, of that length from at on."""
    begin = np.cumsum(length) - length
    found = np.flatnonzero(bits.take(np.repeat(at - begin, length) + np.arange(length.sum())))
    lane = np.searchsorted(begin, found, side="right") - 1
    n = np.bincount(lane, minlength=len(at))
    rank = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    some = rank < distinct[lane]
    out = np.zeros((len(at), int(distinct.max(initial=0))), np.int64)
    out[lane[some], rank[some]] = (found - begin[lane])[some]
    return out


def _headed(codes: list[np.ndarray], distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids and classes (lanes, ranks) by the heads of blocks, and where their code words begin. In a damaged block they may be any."""
    top, unary = (np.array([int(c[k]) if len(c) > k else 0 for c in codes], np.int64) for k in (1, 2))
    low = _low_bits(distinct, top)
    words = (distinct * (low + 1) + (top >> low) + unary + 15) // 16
    at = np.cumsum(words) - words
    every = np.zeros(words.sum(), "<u2")
    for c, a, n in zip(codes, at.tolist(), words.tolist()):
        own = c[3 : 3 + n]
        every[a : a + len(own)] = own
    bits, at = np.unpackbits(every.view(np.uint8), bitorder="little"), at * 16
    own = np.arange(int(distinct.max(initial=0)))
    ids = np.zeros((len(codes), len(own)), np.int64)
    for b in range(int(low.max(initial=0))):
        lane = np.flatnonzero(low > b)
        ids[lane] |= bits.take((at + b)[lane, None] + low[lane, None] * own, mode="clip").astype(np.int64) << b
    high = at + distinct * low
    ids |= (_ones(bits, high, distinct + (top >> low), distinct) - own).clip(0) << low[:, None]
    classes = np.diff(_ones(bits, high + distinct + (top >> low), unary, distinct), axis=1, prepend=-1) - 1
    return ids.astype(np.uint16), classes.clip(0, 12), 3 + words


def _coded(io: Writer | Reader, sizes: np.ndarray, zero: Zero, ranks: np.ndarray | None) -> np.ndarray | None:
    """Codes the ranks of all lanes (places, lanes), or decodes them if there are none. sizes: of the lanes, in descending order.

    The rank of an id is its place among the ids of its block.
    """
    lanes, longest = len(sizes), int(sizes[0]) if len(sizes) else 0
    out = np.zeros((longest, lanes), np.uint16) if ranks is None else None
    guesses, mixer = Guesses(lanes, zero.wide), Mixer(zero)
    longer = np.searchsorted(-sizes, -np.arange(longest)).tolist()
    for begin, end in zip(LEARNED, LEARNED[1:]):
        end = min(end, longest)
        if begin >= end:
            break
        io.grow()
        n = longer[begin]
        if ranks is None:
            states, kinds = np.zeros((end - begin, n), np.uint16), np.zeros((end - begin, n), np.uint8)
            p, right = np.zeros((end - begin, n), np.int16), np.zeros((end - begin, n), bool)
            for t in range(begin, end):
                n = longer[t]
                cells = guesses.look(n)
                state, guess = guessed(cells)
                kind = zero.kind(guess)
                sure = mixer.ask(state, kind)
                now, found = io.bit(sure, guess, zero)
                guesses.learn(n, cells, now)
                k = t - begin
                states[k, :n], kinds[k, :n], p[k, :n], right[k, :n], out[t, :n] = state, kind, sure, found, now
        else:
            cells = np.zeros((end - begin, 2, n), np.uint16)
            for t in range(begin, end):
                n = longer[t]
                cells[t - begin, :, :n] = own = guesses.look(n)
                guesses.learn(n, own, ranks[t, :n].astype(np.int64))
            n = longer[begin]
            states, guess = guessed(cells)
            kinds, own = zero.kind(guess), ranks[begin:end, :n]
            p, right = mixer.ask(states, kinds), own == guess
            first, kind = zero.firsts.take(zero.rows[:n] + own).astype(np.int64), zero.kind(own).astype(np.int64)
            for t in range(begin, end):
                k, n = t - begin, longer[t]
                io.bit(p[k, :n], right[k, :n], first[k, :n], kind[k, :n], zero)
        n = longer[begin]
        if end < longest:
            mixer.learn(states, kinds, p, right, np.arange(begin, end)[:, None] < sizes[:n] if longer[end - 1] < n else None)
    return out


class Writer:
    """A range coder of many lanes: 48-bit states, 16-bit code words. Carries wait in the words until the end."""

    def __init__(self, lanes: int, room: int):
        self.low, self.width = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
        self.words, self.first = np.zeros((lanes, room), np.uint32), np.arange(lanes, dtype=np.int64) * room
        self.at, self.flat = self.first.copy(), self.words.reshape(-1)

    def grow(self) -> None:
        """Room for the words of 128 places more, of 48 bits at most each."""
        if len(self.at) and int((self.at - self.first).max()) + 512 > (room := self.words.shape[1]):
            wider = np.zeros((len(self.at), 2 * room + 512), np.uint32)
            wider[:, :room] = self.words
            first = np.arange(len(self.at), dtype=np.int64) * wider.shape[1]
            self.words, self.flat, self.at, self.first = wider, wider.reshape(-1), self.at - self.first + first, first

    def bit(self, p: np.ndarray, right: np.ndarray, first: np.ndarray, kind: np.ndarray, zero: Zero) -> None:
        """Whether a guess is right, and if not, a share."""
        n = len(p)
        width, low, at = self.width[:n], self.low[:n], self.at[:n]
        edge = (width >> 12) * p
        part = (width - edge >> 6) * zero.part[:n] >> 23
        low += np.where(right, 0, edge + part * first)
        width = np.where(right, edge, part << kind)
        # the word that is next is written anyway, with its carry, and stands if the width is short
        short = width < 1 << 32
        self.flat[at] = (low >> 32).astype(np.uint32)
        at += short
        low[:] = np.where(short, (low & 0xFFFFFFFF) << 16, low)
        self.width[:n] = width = np.where(short, width << 16, width)
        while len(out := np.flatnonzero(width < 1 << 32)):
            self.flat[at[out]] = low[out] >> 32
            at[out] += 1
            low[out] = (low[out] & 0xFFFFFFFF) << 16
            self.width[out] = width[out] << 16
            width = self.width[:n]

    def ended(self) -> list[np.ndarray]:
        """The words of all lanes: one of the state, a bit above the low end, is enough."""
        self.grow()
        self.low += np.minimum(self.width - 1, (1 << 32) - 1)
        self.flat[self.at] = self.low >> 32
        while len(over := np.flatnonzero(self.flat > 0xFFFF)):
            carry = self.flat[over] >> np.uint32(16)
            self.flat[over] &= np.uint32(0xFFFF)
            self.flat[over - 1] += carry
        return [self.flat[a : e + 1].astype(np.uint16) for a, e in zip(self.first.tolist(), self.at.tolist())]


class Reader:
    def __init__(self, codes: list[np.ndarray]):
        lanes, room = len(codes), max(map(len, codes), default=0) + 8
        words = np.zeros((lanes, room), np.uint16)
        for k, c in enumerate(codes):
            words[k, : len(c)] = c
        self.x = (words[:, 0].astype(np.int64) << 32) | (words[:, 1].astype(np.int64) << 16) | words[:, 2].astype(np.int64)
        self.width, self.at, self.flat = np.full(lanes, (1 << 48) - 1, np.int64), np.arange(lanes, dtype=np.int64) * room + 3, words.reshape(-1)

    def grow(self) -> None:
        pass

    def bit(self, p: np.ndarray, guess: np.ndarray, zero: Zero) -> tuple[np.ndarray, np.ndarray]:
        """The ranks, and whether they are those guessed."""
        n = len(p)
        width, x = self.width[:n], self.x[:n]
        edge = (width >> 12) * p
        right = x < edge
        part, x = (width - edge >> 6) * zero.part[:n] >> 23, x - edge
        # exact: numbers are below 2 ** 48, and what is short of a whole share is so by 2 ** -36 at least
        share = np.minimum((x / part).astype(np.int64), SHARES - 1)
        cell = zero.table.take(zero.table_rows[:n] + (share >> 3), mode="clip").astype(np.int64)
        kind = cell & 15
        width, x = np.where(right, edge, part << kind), np.where(right, x + edge, x - part * (share >> kind << kind))
        short = width < 1 << 32
        at = self.at[:n]
        self.x[:n] = np.where(short, x << 16 | self.flat.take(at, mode="clip"), x)
        at += short
        self.width[:n] = width = np.where(short, width << 16, width)
        while len(out := np.flatnonzero(width < 1 << 32)):
            self.x[out] = self.x[out] << 16 | self.flat.take(at[out], mode="clip")
            at[out] += 1
            self.width[out] = width[out] << 16
            width = self.width[:n]
        return np.where(right, guess, (cell >> 4) + ((share & 7) >> kind)), right


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """16-bit words of each block, of `BLOCK` ids at most: its head, and the code words of its ranks."""
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    longest = int(sizes[0]) if order else 0
    ranks, ids, kinds, rank_of = np.zeros((len(order), longest), np.uint16), [], [], np.zeros(1 << 16, np.uint16)
    for lane, i in enumerate(order):
        own = np.sort(blocks[i], kind="stable")
        at = np.flatnonzero(own[1:] != own[:-1]) + 1
        ids.append(own[np.concatenate([[0], at])])
        kinds.append(CLASSES[np.diff(at, prepend=0, append=len(own))])
        rank_of[ids[-1][np.argsort(_DESCENDING - kinds[-1], kind="stable")]] = np.arange(len(at) + 1)
        ranks[lane, : len(own)] = rank_of.take(blocks[i])
    distinct = np.array(list(map(len, ids)), np.int64)
    classes = np.zeros((len(order), int(distinct.max(initial=0))), np.uint8)
    for lane, own in enumerate(kinds):
        classes[lane, : len(own)] = np.sort(own)[::-1]
    io = Writer(len(order), longest // 2 + longest // 8 + 512)
    _coded(io, sizes, Zero(classes, distinct, False), np.ascontiguousarray(ranks.T))
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for i, head, words in zip(order, _heads(ids, kinds), io.ended()):
        out[i] = np.concatenate([head, words])
    return out


def decode_blocks(codes: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    order = sorted((i for i in range(len(codes)) if lengths[i]), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order], np.int64)
    # in a damaged block the number may be any; no other block may suffer
    distinct = np.array([min(max(1, int(codes[i][0])), lengths[i], BLOCK) if len(codes[i]) else 1 for i in order], np.int64)
    ids, classes, at = _headed([codes[i] for i in order], distinct)
    by_class = np.argsort(np.where(np.arange(ids.shape[1]) < distinct[:, None], _DESCENDING - classes, 255).astype(np.uint8), axis=1, kind="stable")
    ids, classes = np.take_along_axis(ids, by_class, axis=1), np.take_along_axis(classes, by_class, axis=1)
    io = Reader([codes[i][a:] for i, a in zip(order, at.tolist())])
    ranks = np.ascontiguousarray(_coded(io, sizes, Zero(classes, distinct, True), None).T)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(codes)
    for lane, i in enumerate(order):
        out[i] = ids[lane].take(ranks[lane, : lengths[i]], mode="clip")
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def packed(frames: list[np.ndarray]) -> list[bytes]:
    """The payload of each frame's ids."""
    blocks = [f[i : i + BLOCK] for f in frames for i in range(0, len(f), BLOCK)]
    codes, out, at = encode_blocks(blocks), [], 0
    for f in frames:
        n = -(-len(f) // BLOCK)
        own = range(at, at + n)
        head = b"".join(struct.pack("<III", len(blocks[i]), len(codes[i]), crc(blocks[i])) for i in own)
        out.append(b"CMR3" + struct.pack("<I", n) + head + b"".join(codes[i].astype("<u2").tobytes() for i in own))
        at += n
    return out


def unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload; raises ValueError if a block's sum is wrong."""
    codes, lengths, sums, counts = [], [], [], []
    for p in payloads:
        if p[:4] != b"CMR3":
            raise ValueError("not a frame of token ids")
        (n,) = struct.unpack_from("<I", p, 4)
        head = np.frombuffer(p, "<u4", 3 * n, 8).reshape(n, 3)
        at = 8 + 12 * n
        for size, words, check in head.tolist():
            codes.append(np.frombuffer(p, "<u2", words, at))
            lengths.append(size)
            sums.append(check)
            at += 2 * words
        counts.append(n)
    blocks = decode_blocks(codes, lengths)
    for i, (b, check) in enumerate(zip(blocks, sums)):
        if crc(b) != check:
            raise ValueError(f"block {i} is damaged")
    ends = np.cumsum([0, *counts])
    return [np.concatenate(blocks[a:e]) if e > a else np.zeros(0, np.uint16) for a, e in zip(ends, ends[1:])]


def by_size(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have so many bytes at most, or one row."""
    ends, at = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end


FRAMES = "part int, seq int, doc_ids array<bigint>, sizes array<bigint>, payload binary"


def framed(docs: DataFrame, tokenizer: str, partitions: int) -> DataFrame:
    """Frames of the ids of docs by ascending doc_id; (part, seq) is their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_tokens(tokenizer)
        part, seq = 0, 0
        frames: list[list] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal seq
            payloads = packed([np.concatenate(f[1]) for f in frames])
            rows = [(part, seq + i, f[0], [len(x) for x in f[1]], p) for i, (f, p) in enumerate(zip(frames, payloads))]
            seq += len(rows)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "seq", "doc_ids", "sizes", "payload"])

        for b in batches:
            for rows in by_size(b, 2, SLICE):
                part = rows.column(0)[0].as_py()
                for d, ids in zip(rows.column(1).to_pylist(), tokens.encode(rows.column(2))):
                    if not frames or frames[-1][2] >= FRAME:
                        if held >= LANES * BLOCK - FRAME:
                            yield out()
                            frames, held = [], 0
                        frames.append([[], [], 0])
                    f = frames[-1]
                    f[0].append(d)
                    f[1].append(ids)
                    f[2] += len(ids)
                    held += len(ids)
        if frames:
            yield out()

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FRAMES)


def read_back(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the frames alone."""
    own = frames.select("part", "seq", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    # a row for each frame, then one for each part
    parts = own.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("seq")
    starts = own.select("part", "seq", (F.sum("n").over(w) - F.col("n")).alias("inner")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = []
            for (part, seq, docs, sizes, _), ids in zip(rows, unpacked([r[4] for r in rows])):
                ends = np.cumsum(sizes)
                found += [(part, seq, d, int(e - n), n, crc(ids[e - n : e])) for d, n, e in zip(docs, sizes, ends)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

        released()
        rows, held = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(r)
                held += sum(r[3])
                if held >= LANES * BLOCK - FRAME:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    docs = frames.mapInArrow(run, "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op3_tokenfiles(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    frames = framed(tables(spark, folder, "documents")[0], public_tokenizers.path(FILE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_back(written(frames, "token-files"))
