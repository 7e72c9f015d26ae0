"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding of that prefix ends in one
well-defined token. ``PrefixTable`` stores that token for each prefix: the last token
of prefix ``i`` is the one token that ends at ``i`` and may follow the last token of the
prefix before it. Walking back over the stored tokens gives the encoding. So appending
bytes only adds table entries (no earlier one can change), and after an
edit the entries in front of it stay, while those behind it are taken over again as soon as
one longest token's worth of entries agrees.

A token may follow another exactly if merging their joined bytes never merges across the
border between them; ``Vocabulary.may_follow`` decides that by undoing the later of the merges
on both sides of the border, step by step.

Each match of the pattern is encoded by itself; a match that is a token as a whole is
that token. Words are cached (bounded) in the worker, as their four-byte ids.

Defined results: null and empty texts have no tokens and decode to no bytes;
each repeated row gets its own equal result; an empty table gives an empty table;
all other columns pass through and a clashing result column is replaced.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, cycles_kept

CACHE_WORDS = 500_000


class Vocabulary:
    """Ranks of byte strings. ``parts[t]``: the two tokens whose merge makes t."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # the tokens that merging makes; others can only be a whole match
        self.made = {b: r for b, r in ranks.items() if self.split(r) != (-1, -1)}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """Merging by rank, as defined: the lowest rank first, leftmost on ties."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The pair that the last merge of a token joins, None for one byte;
        (-1, -1) for a token that merging never makes."""
        try:
            return self.parts[token]
        except KeyError:
            pass
        b, found = self.bytes[token], None
        if len(b) > 1:
            # merging with all ranks below this token's own must leave two parts
            parts = [b[k:k + 1] for k in range(len(b))]
            found = (-1, -1)
            while len(parts) > 2:
                rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and self.ranks[parts[0] + parts[1]] == token:
                found = self.ranks[parts[0]], self.ranks[parts[1]]
        self.parts[token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # (left, right) meet at the border while their own merges are not undone. A merge across
        # the border happens if it comes before the merge that uses up either side.
        ranks, names = self.ranks, self.bytes
        up_left, up_right = 1 << 60, 1 << 60  # the merge that uses up left, right
        while True:
            cross = ranks.get(names[left] + names[right], 1 << 60)
            # ties go to the leftmost pair: the merge inside the left token comes before the
            # border's, that inside the right token after it
            if cross < up_left and cross <= up_right and cross != 1 << 60:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            # go back to before the later of the two last merges (on ties, the right one is later)
            if b is None or (a is not None and left > right):
                up_left, left = left, a[1]
            else:
                up_right, right = right, b[0]


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.first = vocabulary, b"", [], []
        self.append(data)

    def _grow(self, data: bytes, begin: int, end: int) -> None:
        """Compute the entries of the prefixes of ``data`` that end at begin + 1 .. end."""
        v, last, first = self.v, self.last, self.first
        made, pairs, may_follow, longest = v.made.get, v.pairs.get, v.may_follow, v.longest
        for e in range(begin + 1, end + 1):
            # only one start can be right, so the order of trial is free: first the
            # start of the last token so far, then the last byte alone, then all others from the longest
            if last:
                s = first[-1]
                token = made(data[s:e])
                if token is None or s and not (pairs((last[s - 1], token)) or may_follow(last[s - 1], token)):
                    s, token = e - 1, made(data[e - 1:e])
                    if token is not None and not (pairs((last[s - 1], token)) or may_follow(last[s - 1], token)):
                        token = None
                if token is not None:
                    last.append(token)
                    first.append(s)
                    continue
            for s in range(e - longest if e > longest else 0, e):
                token = made(data[s:e])
                if token is not None:
                    if not s:
                        break
                    ok = pairs(key := (last[s - 1], token))
                    if ok or ok is None and may_follow(*key):
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)
            first.append(s)

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes and their entries."""
        self.data = self.data[:size]
        del self.last[size:], self.first[size:]

    def append(self, more: bytes) -> None:
        """Add bytes; entries that are there stay."""
        begin = len(self.data)
        self.data += more
        self._grow(self.data, begin, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start..end; returns how many entries were computed anew."""
        tail, tail_last = self.data[end:], self.last[end:]
        self.cut(start)
        self.append(new)
        self.data += tail
        done, agree, base = len(new), 0, start + len(new)
        for k in range(len(tail)):
            # an entry depends on at most `longest` entries before it: once that many
            # agree with the old ones, all later ones do
            if agree >= self.v.longest:
                self.last += tail_last[k:]
                self.first += [base + k + j + 1 - len(self.v.bytes[t]) for j, t in enumerate(tail_last[k:])]
                break
            self._grow(self.data, base + k, base + k + 1)
            done += 1
            agree = agree + 1 if self.first[-1] >= base and self.last[-1] == tail_last[k] else 0
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at = self.first[at - 1]
        return out[::-1]


class Encoder:
    """Whole texts to little-endian four-byte ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v = Vocabulary.from_file(path)
        self.find = regex.compile(pattern).findall
        # a chunk may only begin at a space that follows no white space
        self.unsafe = regex.compile(r"\s ").search
        self.words, self.chunks = Generations(self.new_words, CACHE_WORDS), Generations(self.new_chunks, CACHE_WORDS)
        self.table = np.array([self.v.bytes.get(k, b"") for k in range(max(self.v.bytes, default=-1) + 1)], object)

    def new_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word; in sorted order, so that each takes the entries of the prefix it shares with the one before."""
        table, ranks, out = PrefixTable(self.v), self.v.ranks, {}
        for word in sorted(w.encode("utf-8") for w in words):
            whole = ranks.get(word)
            if whole is None:
                k = 0
                for x, y in zip(table.data, word):
                    if x != y:
                        break
                    k += 1
                table.cut(k)
                table.append(word[k:])
                ids = table.tokens()
            else:
                ids = [whole]
            out[word.decode("utf-8")] = struct.pack(f"<{len(ids)}i", *ids)
        return out

    def new_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        find = self.find
        return self.joined([(c, find(" " + c)) for c in chunks])

    def joined(self, split: list[tuple[object, list[str]]]) -> dict:
        known = self.words.of({w for _, ws in split for w in ws}).__getitem__
        return {c: known(ws[0]) if len(ws) == 1 else b"".join(map(known, ws)) for c, ws in split}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; new words of all texts are encoded together."""
        split, whole = {}, {}  # by place: chunks; what the pattern is matched on in full
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.unsafe(t):
                whole[k] = t
                continue
            chunks = t.split(" ")
            last = " " if len(chunks) > 1 and not chunks[-1] else ""  # a last space stands alone
            whole[k], split[k] = chunks[0], (chunks[1:-1] if last else chunks[1:], last)
        heads = self.joined([(k, self.find(t)) for k, t in whole.items()])
        end = self.joined([(" ", self.find(" "))])[" "]
        known = self.chunks.of(set().union(*(c for c, _ in split.values()))).__getitem__
        rest = {k: b"".join(map(known, c)) + (end if last else b"") for k, (c, last) in split.items()}
        return [heads.get(k, b"") + rest.get(k, b"") for k in range(len(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


class Generations:
    """A bounded cache in two halves: when the newer one is full it becomes the older one, whose entries come back as they are asked for."""

    def __init__(self, make, most: int):
        self.make, self.most, self.new, self.old, self.long = make, most // 2, {}, {}, []

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A table that holds all of ``keys``, until the next call; long ones are not kept longer."""
        for k in self.long:
            self.new.pop(k, None)
        missing = keys.difference(self.new)  # unlike the minus of a set and a table's keys, this walks through the set alone
        if len(self.new) + len(missing) > self.most:
            self.new, self.old, missing = {}, self.new, keys
        old = self.old
        back = [k for k in missing if k in old]
        self.new.update(zip(back, map(old.__getitem__, back)))
        missing = missing.difference(back)
        self.long = [k for k in missing if len(k) > 64]
        self.new.update(self.make(missing))
        return self.new


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_column(text: str | Column, path: str, pattern: str) -> Column:
    """array<int>: the ids of each whole text. ``path`` is read on the executors."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        with cycles_kept():
            raw = encoder(path, pattern).encode(texts.to_pylist())
        ends = np.cumsum([0, *(len(b) // 4 for b in raw)], dtype=np.int64)
        values = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    return encode(F.col(text) if isinstance(text, str) else text)


def decode_column(ids: str | Column, path: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for (null ids: none)."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        e, values, ends = encoder(path, pattern), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return pa.array([e.decode(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``df`` with its token ids and, if named, the bytes decoded from these ids."""
    bounded_batches(df.sparkSession)
    out = df.withColumn(ids_col, encode_column(F.coalesce(F.col(text_col), F.lit("")), path, pattern))
    return out.withColumn(decoded_col, decode_column(ids_col, path, pattern)) if decoded_col else out
