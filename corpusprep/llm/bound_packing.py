"""Best-fit packing with certified bin counts.

Token pieces are packed in blocks, each by best-fit decreasing. Dual-feasible
functions give each block a lower bound of its bin count; a block that reaches its bound is
certified and final. A block with a gap gives its loosest bins back; the documents of such bins,
of all blocks, are dealt out anew over a fraction of the blocks and packed again, until all
are certified, one block is left or the blocks no longer get fewer. Only the loose bins travel, a bounded number for each
block, so no round holds more than the first.

Defined results: null and empty texts are one piece of the end token alone; repeated rows are
packed once for each row; an empty table gives an empty table; other columns
pass through ``cut_pieces`` and ``pack`` unless they have the name of a result column.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, cycles_kept, materialize
from corpusprep.llm.prefix_bpe import Generations

CAPACITY, BLOCK_ROWS, LOOSE_BINS, SHRINK = 2048, 200_000, 64, 8
#: Most chunks and words that a worker keeps, about 150 bytes each; most characters of text that are split at a time (one text at least).
CACHE_WORDS, STEP_CHARS = 500_000, 200_000


class WordTokens:
    """Ids of whole texts. No token spans white space or two of the matches of
    ``SPLIT``, so the ids of a text are those of its chunks between white space, and theirs are those of their matches. Both are kept in one
    cache, as a match that stands alone is a chunk with the same ids. New ones are encoded many at a
    time by the tokenizer's model, joined by spaces; as the last token of each, and no other, is one that ends words, the
    ids fall apart into words again. Texts with other than Latin letters, and those that may hold one of the tokenizer's special strings, go to the tokenizer whole."""

    #: How the tokenizer's file splits words.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.words_only = Tokenizer(self.t.model)  # words that are normalized and split already, their bytes as the model's letters
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.t.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [normalize("NFC", a.content).lower() for a in self.t.get_added_tokens_decoder().values()]
        self.find, self.latin = regex.compile(self.SPLIT).findall, re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*").fullmatch
        # a byte's letter: itself if it prints in Latin-1, else one of those from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.known = Generations(self.new_chunks, CACHE_WORDS)

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def new_words(self, words: set[str]) -> dict[str, bytes]:
        out, words = {}, list(words)
        for k in range(0, len(words), 4000):
            part = words[k:k + 4000]
            joined = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part])
            ids = np.array(self.words_only.encode(joined, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                out.update((w, self.whole(w)) for w in part)
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts], cuts))
        return out

    def new_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        find, new, old = self.find, self.known.new, self.known.old
        split = [(c, [c] if c.isalpha() else find(c)) for c in chunks]
        ids = {w: new[w] if w in new else old.get(w) for _, ws in split for w in ws}
        made = self.new_words({w for w, raw in ids.items() if raw is None})
        ids.update(made)
        out = {c: ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for c, ws in split}
        # the new words are kept as well, if there is room
        more = [w for w in made if w not in out and len(w) <= 64]
        out.update((w, made[w]) for w in more[:max(0, self.known.most - len(new) - len(out))])
        return out

    def encode(self, texts: list[str], end: bytes) -> Iterator[bytes]:
        """The ids of each text, and ``end``, for at most ``STEP_CHARS`` of text at a time."""
        at = 0
        while at < len(texts):
            part, left, split = [], STEP_CHARS, []
            while at < len(texts) and (not part or len(texts[at]) <= left):
                part.append(texts[at])
                left, at = left - len(texts[at]), at + 1
            for t in part:
                plain = normalize("NFC", t).lower() if self.latin(t) else None
                split.append(None if plain is None or any(s in plain for s in self.special) else plain.split())
            known = self.known.of(set().union(*filter(None, split))).__getitem__
            for t, chunks in zip(part, split):
                yield (self.whole(t) if chunks is None else b"".join(map(known, chunks))) + end


@lru_cache(maxsize=1)
def tokens_of(path: str) -> WordTokens:
    return WordTokens(path)


def token_column(text: str | Column, path: str, end_id: int = 0) -> Column:
    """binary: the ids of each whole text and the end id, four bytes each, little-endian."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        end, raw = int(end_id).to_bytes(4, "little"), [t or "" for t in texts.to_pylist()]
        with cycles_kept():
            return pa.array(list(tokens_of(path).encode(raw, end)), pa.binary())

    return ids(F.col(text) if isinstance(text, str) else text)


def cut_pieces(df: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``df`` without its text, a row for each piece: piece, start, length, ids
    (binary). Only documents over ``capacity`` are cut, into full pieces and a rest."""
    bounded_batches(df.sparkSession)
    own = ("piece", "start", "length", "ids", text_col.lower())
    keep = [c for c in df.columns if c.lower() not in own]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), token_column(F.coalesce(F.col(text_col), F.lit("")), path).alias("all"))
    d = d.select("r", "all", F.explode(F.expr(f"sequence(0, cast(floor((octet_length(all) div 4 - 1) / {capacity}) as int))")).alias("piece"))
    cut = F.expr(f"substring(all, piece * {4 * capacity} + 1, {4 * capacity})")
    return d.select("r.*", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
                    (F.octet_length(cut) / 4).cast("long").alias("length"), cut.alias("ids"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual-feasible functions give: the sum of
    the lengths; for a threshold k <= half, long pieces (over capacity - k) counted whole, short ones
    (under k) as nothing; and, for small integers m, every length rounded to
    its share in (m + 1) parts, exact multiples as they are."""
    n = len(lengths)
    if not n:
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = math.ceil(int(sizes @ counts) / capacity)
    half = sizes[sizes * 2 <= capacity]
    for k in np.unique(np.r_[0, half, half + 1]):
        if 2 * k > capacity:
            continue
        u = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, math.ceil(int(u @ counts) / capacity))
    for m in range(1, 21):
        whole = (m + 1) * sizes % capacity == 0
        # in units of 1/(m * capacity): x if (m + 1) x / capacity is whole, else floor((m + 1) x / capacity) / m
        u = np.where(whole, sizes * m, (m + 1) * sizes // capacity * capacity)
        best = max(best, math.ceil(int(u @ counts) / (m * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin; longest
    first, each into the fullest bin that has room for it."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that occur, sorted
    room: list[int] = []
    sizes = np.asarray(lengths).tolist()
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = sizes[i]
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            had = rooms[k]
            bins = by_room[had]
            b = bins.pop()
            if not bins:
                del by_room[had], rooms[k]
        else:
            had, b = capacity, len(room)
            room.append(capacity)
        where[i], offset[i] = b, capacity - had
        left = room[b] = had - size
        if left:
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                bisect.insort(rooms, left)
    return where, offset, np.array(room, np.int64)


def _packer(capacity: int, block_rows: int, loose_bins: int, stage: int):
    """A block's rows with block, bin, offset and open: whether they travel on."""

    def place(batches: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        lengths = t["length"].to_numpy().astype(np.int64)
        where, offset, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        loose = np.zeros(len(room), bool)
        if gap > 0:
            loose[np.argsort(-room, kind="stable")[:max(loose_bins, 2 * gap)]] = True
        n = len(lengths)
        for name, values in (("stage", np.full(n, stage, np.int32)), ("block", np.full(n, block, np.int64)), ("bin", where), ("offset", offset), ("open", loose[where])):
            t = t.append_column(name, pa.array(values))
        yield from t.combine_chunks().to_batches(max_chunksize=10_000)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 12, [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, block_rows - n))
                n, batch = n + held[-1].num_rows, batch.slice(block_rows - n)
                if n == block_rows:
                    yield from place(held, block)
                    held, n, block = [], 0, block + 1
        if held:
            yield from place(held, block)

    return blocks


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, loose_bins: int = LOOSE_BINS, most_rounds: int = 12) -> DataFrame:
    """``pieces`` (a ``length`` of 1 to ``capacity`` in each row) with
    sequence_id and offset. Rows travel with their columns, so keep these few."""
    own = ("stage", "block", "bin", "offset", "open", "sequence_id")
    if not 0 < block_rows <= 1 << 18:
        raise ValueError("block_rows must be at most 2**18")
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in own])
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", stage int, block bigint, bin bigint, offset bigint, open boolean"
    done, todo, before = None, pieces, None
    for stage in range(most_rounds):
        now = materialize(todo.mapInArrow(_packer(capacity, block_rows, loose_bins, stage), schema), "packed")
        blocks, loose, bins = now.agg(F.countDistinct("block"), F.count_if("open"), F.countDistinct(F.when(F.col("open"), F.struct("block", "bin")))).first()
        # the last round is one that is certified, stands alone or did not come down to fewer blocks
        last = not loose or blocks == 1 or stage == most_rounds - 1 or (before is not None and blocks >= before)
        final = now if last else now.where(~F.col("open"))
        done = final if done is None else done.unionByName(final)
        if last:
            break
        before = blocks
        todo = now.where("open").select(*names).repartition(max(1, math.ceil(min(blocks, bins) / SHRINK)))
    # 18 bits of bin, 12 of block in its task, 24 of task, then the round
    number = F.shiftleft(F.col("stage").cast("long"), 54) + F.shiftleft("block", 18) + F.col("bin")
    return done.withColumn("sequence_id", number).drop("stage", "block", "bin", "open")
