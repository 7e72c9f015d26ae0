"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is ``times`` * q words long
at least, and ``least`` words, and that no neighbouring word extends with period q.

Texts are worked on many at a time, as one array of word numbers. Prefix doubling numbers every dyadic length (two
places of one text have the same number at level l exactly if the same 2^l words begin there) and ends in a suffix array for each
text, over which a wavelet tree answers range successor: the next place, from a given one on, among the suffixes that begin with a block.
A run of period q, 2^l <= q < 2^(l+1), holds an aligned block of m = 2^l words that stands again q words on.
So each aligned block asks for its occurrences that begin m to 2m - 1 words after it. These are one or two, each a candidate period, or
a progression whose difference p is the block's own smallest period; then the only candidate is the distance between the ends of the
two stretches of period p that hold the block and the progression (a run that held both in one stretch would have period p itself). A
candidate grows both ways by comparing dyadic numbers, longest first, and of those that fill the same words the least period stays.
Time and memory of a text of n words are in proportion to n log n, whatever repeats in it.

Defined results: a null text has no words, hence no runs and the collapsed text ''. Words are separated by space, tab,
line feed, vertical tab, form feed and carriage return alone, and compared as they are. Rows that repeat
have a result each. Only the named columns are read; the new ones replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches

LEAST, TIMES = 6, 4
#: Words that are worked on at a time (one text may have more): the arrays then stay in the processor's cache.
TOGETHER = 1 << 16

FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class Dyadic:
    """Numbers of the dyadic blocks of several texts, and their suffixes in order."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n = len(words)
        ends = np.cumsum(lengths)
        self.begin, self.end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        key = np.repeat(np.arange(len(lengths)), lengths) * (words.max() + 1) + words
        self.suffixes = np.argsort(key, kind="stable")
        key = key[self.suffixes]
        head = np.r_[True, key[1:] != key[:-1]]
        number = np.empty(n, np.int32)  # of a place: the first slot of the suffixes that begin like it
        number[self.suffixes] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.numbers, self.heads = [number], [np.flatnonzero(head)]
        size = 1
        while size < lengths.max():
            slots = np.flatnonzero(~(head & np.r_[head[1:], True]))  # those that share their number
            if not len(slots):
                break
            at = self.suffixes[slots]
            on = at + size
            rest = np.where(on < self.end[at], number[np.minimum(on, n - 1)], -1)
            key = number[at].astype(np.int64) * (n + 1) + rest + 1
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.suffixes[slots] = at
            new = np.r_[True, key[1:] != key[:-1]]
            head[slots[new]] = True
            number = number.copy()
            number[at] = np.maximum.accumulate(np.where(new, slots, 0))
            self.numbers.append(number)
            self.heads.append(np.flatnonzero(head))
            size *= 2

    def shared(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The aligned blocks of a level that stand elsewhere, too, and the slots (from, to) of all suffixes that begin so."""
        size, number, heads = 1 << level, self.numbers[level], self.heads[level]
        begins = np.arange(len(number)) if level == 0 else np.flatnonzero((np.arange(len(number)) - self.begin) % size == 0)
        begins = begins[begins + 2 * size <= self.end[begins]]
        low = number[begins]
        high = np.r_[heads, len(number)][np.searchsorted(heads, low, "right")]
        keep = high - low > 1
        return begins[keep], low[keep].astype(np.int64), high[keep]

    def onward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal, in the text of j."""
        return self._grow(i, j, self.end[np.minimum(j, len(self.end) - 1)], 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal."""
        return self._grow(i, j, self.begin[i], -1)

    def _grow(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
        far, last = np.zeros(len(i), np.int64), len(self.end) - 1
        for level in range(len(self.numbers) - 1, -1, -1):
            size, number = 1 << level, self.numbers[level]
            live = np.arange(len(i))
            while len(live):
                a, b = (i + far)[live] if way > 0 else (i - far - size)[live], (j + far)[live] if way > 0 else (j - far - size)[live]
                fits = b + size <= limit[live] if way > 0 else a >= limit[live]
                live = live[fits & (number[np.clip(a, 0, last)] == number[np.clip(b, 0, last)])]
                far[live] += size
                if level < len(self.numbers) - 1:  # what a longer block didn't match, a shorter one matches once at most
                    break
        return far


class Wavelet:
    """Wavelet tree over whole numbers below 2^bits: the values of a range of slots by their order."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of slots low to high - 1 are less than ``value``, itself below 2^bits."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros, ones_at in self.levels:
            l0, h0 = zeros[low], zeros[high]
            one = (value >> bit & 1).astype(bool)
            count += np.where(one, h0 - l0, 0)
            low, high = np.where(one, ones_at + low - l0, l0), np.where(one, ones_at + high - h0, h0)
        return count

    def ordered(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of slots low to high - 1 that k of them come before in order of size, k < high - low."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, ones_at in self.levels:
            l0, h0 = zeros[low], zeros[high]
            left = h0 - l0
            one = k >= left
            value += one * (1 << bit)
            k = np.where(one, k - left, k)
            low, high = np.where(one, ones_at + low - l0, l0), np.where(one, ones_at + high - h0, h0)
        return value


def candidates(text: Dyadic, tree: Wavelet, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): what the blocks of a level give."""
    size = 1 << level
    at, low, high = text.shared(level)
    begin = text.begin[at]
    here = at - begin
    # range successor: the first value from here + size on is the one that all less ones come before
    k = tree.below(low, high, here + size)
    some = k < high - low
    at, low, high, begin, here, k = (x[some] for x in (at, low, high, begin, here, k))
    first = tree.ordered(low, high, k)
    some = first < here + 2 * size
    at, low, high, begin, here, k, first = (x[some] for x in (at, low, high, begin, here, k, first))

    def after(which: np.ndarray, step: int) -> np.ndarray:
        """The step-th value after the first one, -1 if it lies outside the window."""
        out = np.full(len(at), -1)
        rows = np.flatnonzero(which & (k + step < high - low))
        value = tree.ordered(low[rows], high[rows], k[rows] + step)
        out[rows] = np.where(value < here[rows] + 2 * size, value, -1)
        return out

    second = after(np.full(len(at), level > 0), 1)
    third = after(second >= 0, 2)
    alone, pair = third < 0, (third < 0) & (second >= 0)
    run = np.flatnonzero(third >= 0)
    own = (second - first)[run]
    s, f = at[run], (first + begin)[run]
    distance = (f + text.onward(f, f + own)) - (s + text.onward(s, s + own))
    good = (distance >= size) & (distance < 2 * size)
    return (np.concatenate([at[alone], at[pair], s[good]]),
            np.concatenate([(first - here)[alone], (second - here)[pair], distance[good]]))


def runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) by start and period, start counted over all texts: ``words`` holds the texts' word numbers one after another."""
    if times < 4:
        raise ValueError("times must be 4 at least: shorter runs need not hold an aligned block and its next occurrence")
    if not len(words):
        return np.zeros((0, 3), np.int64)
    text = Dyadic(words, lengths)
    tree = Wavelet(text.suffixes - text.begin[text.suffixes], max(1, int(lengths.max() - 1).bit_length()))
    found = []
    for level in range(len(text.numbers)):
        if (times << level) > lengths.max():
            break
        at, period = candidates(text, tree, level)
        back, on = text.backward(at, at + period), text.onward(at, at + period)
        length = back + on + period
        keep = length >= np.maximum(least, times * period)
        found.append(np.c_[(at - back)[keep], length[keep], period[keep]])
    found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # by start, length, period: of one stretch the least period comes first
    found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)][:len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def search(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[tuple[np.ndarray, list[bytes]]]:
    """For each text, given by its words, its runs and the words that stay: a run keeps its first period."""
    out: list = [None] * len(texts)
    by_length = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(by_length):
        part, n = [], 0
        while at < len(by_length) and (not part or n + len(texts[by_length[at]]) <= TOGETHER):
            part.append(by_length[at])
            n += len(texts[by_length[at]])
            at += 1
        flat = [w for i in part for w in texts[i]]
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        lengths = np.array([len(texts[i]) for i in part])
        found = runs(np.fromiter(map(number.__getitem__, flat), np.int64, n), lengths, least, times)
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, found[:, 0] + found[:, 2], 1)
        np.add.at(covered, found[:, 0] + found[:, 1], -1)
        covered = np.cumsum(covered)
        ends = np.cumsum(lengths)
        cut = np.searchsorted(found[:, 0], np.r_[0, ends])
        for j, i in enumerate(part):
            mine = found[cut[j]:cut[j + 1]]
            begin = int(ends[j] - lengths[j])
            stay = texts[i]
            if len(mine):
                stay = [stay[k] for k in np.flatnonzero(covered[begin:ends[j]] == 0).tolist()]
            out[i] = (mine - [begin, 0, 0], stay)
    return out


def find_runs(df: DataFrame, text_col: str = "text", id_col: str | None = None,
              rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``df`` with the columns ``runs`` (array of start, length, period, by start and period; starts count words from 0) and
    ``collapsed`` (the words that stay, joined by a space; a word goes if any run holds it after that run's first period).

    ``rewrite(id, words)`` may give other words to search in place of a text's own."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf(FOUND)
    def find(ids: pa.Array, texts: pa.Array) -> pa.Array:
        words = [(t or "").encode().split() for t in texts.to_pylist()]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words)]
        found = search(words, least, times)
        table = np.concatenate([r for r, _ in found]) if found else np.zeros((0, 3), np.int64)
        parts = [pa.array(np.ascontiguousarray(table[:, c])) for c in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r) for r, _ in found]]), pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
        return pa.StructArray.from_arrays([lists, pa.array([b" ".join(w) for _, w in found], pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    d = df.withColumn("_found", find(F.col(id_col) if id_col else F.lit(None), F.col(text_col)))
    return d.withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")
