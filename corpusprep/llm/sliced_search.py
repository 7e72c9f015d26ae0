"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` reads the texts once. Documents of like numbers of distinct terms (powers of two) share a block of at most ``DOCS``
documents. Each document has a Bloom signature of its (term, step) pairs, step j being held if the term occurs more than
``STEPS[j - 1]`` times; a block keeps its signatures sliced: row by row, one bit for each document. The
AND of the rows of a pair says which documents hold it, with some too many and none too few. So the sum, over an item's
terms and steps, of the weight times what a step can add to the term's score (every step counts as its greatest number of
occurrences) is at least the document's score.

``search`` takes the items in blocks of bounded size. The documents of greatest bound, a few for each item, are
scored exactly from their texts; an item's k-th best of those excludes every document whose bound is less, or equal with a
larger id. All others are scored exactly from their texts. So the result is exact, whatever the signatures' false positives.

Terms, weights and scores are those of op11's contract: integer arithmetic but for the weights' logarithm. An item has its distinct
terms with their numbers of repeats.

Defined results: null texts have no terms and are no documents of the counts; an item without terms, or without a document of
score above 0, has no rows. Each row of the documents counts as a document of its own, so repeated rows are counted and ranked as often as they
stand there. A null doc_id is found, too, and comes after all other ids. Items equal in id and text are one item; an id with several texts is as many items, each
with its own ranks. Only the named columns are read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize

#: Steps of occurrences: 1, 2, 3 to 4, 5 to 8, and so on; each value is the greatest number that a step counts for.
STEPS = (1, 2, 4, 8, 16, 32, 64, 1 << 40)
#: Documents of a block, bits of a signature for each pair in it, rows that a pair sets, bytes that a block's bits may take unpacked.
DOCS, BITS, HASHES, UNPACKED = 1024, 24, 8, 32 << 20
#: Terms that a task counts or whose hashes it keeps at a time.
TERMS = 100_000
#: Bytes of item texts that a block of items holds about.
ITEM_BYTES = 1 << 20
#: Documents of greatest bound that give an item its first exact scores, for each one wanted.
SEEDS = 4

INDEX = "term string, df long, docs long, terms long, ids array<long>, sizes binary, n_rows int, slices binary"
#: Every byte that no term holds (ASCII but digits and letters) becomes a space, A-Z become a-z; other bytes stay.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def pair_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def rows_of(hashes: np.ndarray, steps: np.ndarray, n_rows: int) -> np.ndarray:
    """(pairs, HASHES): the signature rows that (term, step) pairs set."""
    x = hashes + steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    first, skip = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * skip[:, None]) % np.uint64(n_rows)).astype(np.int64)


class Block:
    """Documents of one block as they come in."""

    def __init__(self):
        self.ids, self.sizes, self.lengths, self.most = [], [], [], 1
        self.hashes, self.steps = array("Q"), array("B")  # of all documents, one after another

    def add(self, doc_id, size: int, hashes: list[int], steps: list[int]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.hashes.extend(hashes)
        self.steps.extend(steps)
        self.lengths.append(len(hashes))
        self.most = max(self.most, len(hashes))

    @property
    def n_rows(self) -> int:
        return BITS * self.most

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.ids) * self.n_rows >= UNPACKED

    def row(self) -> dict:
        n, n_rows = len(self.ids), self.n_rows
        bits = np.zeros((n, n_rows), np.uint8)
        at = rows_of(np.frombuffer(self.hashes, np.uint64), np.frombuffer(self.steps, np.uint8), n_rows)
        bits[np.repeat(np.arange(n), self.lengths)[:, None], at] = 1
        slices = np.packbits(bits, axis=0).T
        return {"ids": self.ids, "sizes": np.array(self.sizes, "<i8").tobytes(), "n_rows": n_rows, "slices": np.ascontiguousarray(slices).tobytes()}


SCHEMA = pa.schema([("term", pa.string()), ("df", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("sizes", pa.binary()), ("n_rows", pa.int32()), ("slices", pa.binary())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows: a term and its documents so far (summed up where many have come), the counts of all documents, and blocks."""
    blocks: dict[int, Block] = {}
    df: Counter = Counter()
    hashes: dict[bytes, int] = {}
    docs = terms = 0

    def counted() -> pa.RecordBatch:
        known = {"term": pa.array(df.keys(), pa.binary()).cast(pa.string()), "df": pa.array(df.values(), pa.int64())}
        return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(len(df), f.type)) for f in SCHEMA], schema=SCHEMA)

    for b in batches:
        for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            words = terms_of(text)
            if not words:
                continue
            count = Counter(words)
            docs, terms = docs + 1, terms + len(words)
            df.update(count.keys())
            h = [hashes.get(t) or hashes.setdefault(t, pair_hash(t)) for t in count]
            steps = [0] * len(h)
            for x, n in zip(h[:], count.values()):
                step = 1
                while n > STEPS[step - 1]:
                    h.append(x)
                    steps.append(step)
                    step += 1
            block = blocks.setdefault(len(h).bit_length(), Block())
            block.add(doc_id, len(words), h, steps)
            if block.full():
                yield pa.RecordBatch.from_pylist([blocks.pop(len(h).bit_length()).row()], SCHEMA)
        if len(df) > TERMS:
            yield counted()
            df.clear()
        if len(hashes) > TERMS:
            hashes.clear()
    for block in blocks.values():
        yield pa.RecordBatch.from_pylist([block.row()], SCHEMA)
    if docs:
        yield counted()
        yield pa.RecordBatch.from_pylist([{"docs": docs, "terms": terms}], SCHEMA)


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of the documents, written once."""
    bounded_batches(df.sparkSession)
    return materialize(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_index, INDEX), "sliced-index")


def _item_terms(text_col: str) -> Column:
    @F.arrow_udf("array<struct<term: string, repeats: bigint>>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([[{"term": t.decode(), "repeats": n} for t, n in sorted(Counter(terms_of(x)).items())] for x in texts.to_pylist()],
                        pa.list_(pa.struct([("term", pa.string()), ("repeats", pa.int64())])))

    return split(text_col)


def longest_score(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences in documents of length figure ``m`` give for a weight of 1."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """A block of items: their terms' weights, and what they can score in a block of documents."""

    def __init__(self, weights: list[tuple[int, list[tuple[str, int, int]]]], n: int, total: int):
        """``weights``: of each item its number and (term, weight, repeats); ``n``, ``total``: documents and their terms."""
        self.n, self.total = n, total
        self.numbers = [k for k, _ in weights]
        vocabulary = sorted({t for _, ts in weights for t, w, _ in ts if w > 0})
        place = {t: i for i, t in enumerate(vocabulary)}
        self.hashes = np.array([pair_hash(t.encode()) for t in vocabulary], np.uint64)
        self.own = [(np.array([place[t] for t, w, _ in ts if w > 0], int), np.array([w * r for _, w, r in ts if w > 0], np.int64)) for _, ts in weights]
        self.exact = {k: [(t.encode(), w, r) for t, w, r in ts if w > 0] for k, ts in weights}

    def length_figure(self, sizes):
        return 75 + (25 * sizes * self.n) // self.total

    def bounds(self, n_rows: int, slices: bytes, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item's number and a score that each document of the block can't exceed."""
        n = len(sizes)
        slices = np.frombuffer(slices, np.uint8).reshape(n_rows, -1)
        m = self.length_figure(sizes)
        adds, before = [], 0
        for most in STEPS:
            here = longest_score(np.minimum(most, sizes), m)
            adds.append(here - before)
            before = here
        parts = []
        for at in range(0, len(self.hashes), 4096):  # terms at a time
            hashes = self.hashes[at:at + 4096]
            part, live = np.zeros((len(hashes), n), np.int64), np.arange(len(hashes))
            held = None
            for step, add in enumerate(adds):
                rows = rows_of(hashes[live], np.full(len(live), step, np.uint64), n_rows)
                bits = np.bitwise_and.reduce(slices[rows], 1)
                if held is not None:
                    bits &= held  # no step without those below it
                some = bits.any(1)
                live, held = live[some], bits[some]
                if not len(live):
                    break
                part[live] += np.unpackbits(held, axis=1, count=n) * add
            parts.append(part)
        if not parts:
            return
        for number, (where, weight) in zip(self.numbers, self.own):
            total = np.zeros(n, np.int64)
            for c in np.unique(where >> 12).tolist():
                mine = where >> 12 == c
                total += weight[mine] @ parts[c][where[mine] & 4095]
            yield number, total

    def score(self, number: int, count: Counter, size: int) -> int:
        m = int(self.length_figure(size))
        return sum(w * r * (1_000_000_000 * tf // (1000 * tf + 12 * m)) for t, w, r in self.exact[number] if (tf := count.get(t)))


NO_ID = np.iinfo(np.int64).max


def _numbers(ids: list) -> np.ndarray:
    """Ids for ordering: a null one comes last."""
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def _seeds(items: Items, k: int):
    """(item, id, no_id, bound): each task's ``k`` documents of greatest bound for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                ids = _numbers(r["ids"])
                for number, total in items.bounds(r["n_rows"], r["slices"], np.frombuffer(r["sizes"], "<i8")):
                    some = total > (best[number][0][-1] - 1 if number in best and len(best[number][0]) == k else 0)
                    if some.any():
                        t, i = total[some], ids[some]
                        if number in best:
                            t, i = np.r_[best[number][0], t], np.r_[best[number][1], i]
                        order = np.lexsort((i, -t))[:k]
                        best[number] = t[order], i[order]
        for number, (t, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), number, np.int64)), pa.array(i, mask=i == NO_ID), pa.array(t)], ["item", "id", "bound"])

    return run


def _candidates(items: Items, least: dict[int, tuple[int, int]]):
    """(item, id): every document that an item's exact scores so far (the k-th best and its id) don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = _numbers(r["ids"])
                for number, total in items.bounds(r["n_rows"], r["slices"], np.frombuffer(r["sizes"], "<i8")):
                    score, last = least.get(number, (0, -1))
                    i = ids[(total > score) | ((total == score) & (ids <= last) & (score > 0))]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number, np.int64)), pa.array(i, mask=i == NO_ID)], ["item", "id"])

    return run


def _scores(items: Items):
    """(item, id, score): exactly, from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                words = terms_of(r["text"])
                count = Counter(words)
                out += [(n, r["id"], items.score(n, count, len(words))) for n in r["items"]] if words else []
            out = [x for x in out if x[2] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item. ``index``: of the same documents, from ``build``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = build(docs, id_col, text_col) if index is None else index
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    n, total = index.agg(F.sum("docs"), F.sum("terms")).first()
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    asked = asked.select("item_id", F.octet_length("text").alias("bytes"), _item_terms("text").alias("terms")).where(F.size("terms") > 0)
    asked = materialize(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum("bytes")).first()[0]
    if not n or not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // ITEM_BYTES)
    weight = F.floor(1000 * F.ln((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1)))
    seen = asked.select(F.explode("terms.term").alias("term")).distinct()
    weights = index.where("term is not null").select("term", "df").join(seen, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = weights.select("term", weight.cast("long").alias("w"))
    # a term's weight for each item that has it; items are never gathered with their documents
    weighed = (asked.select("item", F.explode("terms").alias("t")).select("item", "t.term", "t.repeats").join(weights, "term")
               .groupBy("item").agg(F.collect_list(F.struct("term", "w", "repeats")).alias("terms")).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    weighed = materialize(weighed, "weights")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("id"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    slices = index.where("n_rows is not null").select("ids", "sizes", "n_rows", "slices")
    found = None

    def scored(pairs: DataFrame, part: Items) -> DataFrame:
        # written first, so that the join is planned by its size
        pairs = materialize(pairs.groupBy("id").agg(F.collect_set("item").alias("items")), "pairs")
        rows = texts.join(pairs.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of"))).select("id", "text", "items")
        return rows.mapInArrow(_scores(part), "item long, id long, score long")

    for block in range(blocks):
        rows = weighed.where(F.col("block") == block).select("item", "terms").collect()  # about ITEM_BYTES of texts
        part = Items([(r["item"], [(t["term"], t["w"], t["repeats"]) for t in r["terms"]]) for r in rows], n, total)
        seeds = slices.mapInArrow(_seeds(part, SEEDS * k), "item long, id long, bound long")
        seeds = seeds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= SEEDS * k).select("item", "id")
        first = materialize(scored(seeds, part).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k), "seeds")
        least = {r["item"]: (r["score"], NO_ID if r["id"] is None else r["id"]) for r in first.where(F.col("n") == k).collect()}  # one row for each item of the block
        pairs = slices.mapInArrow(_candidates(part, least), "item long, id long")
        best = materialize(scored(pairs, part).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "found")
        found = best if found is None else found.unionByName(best)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
