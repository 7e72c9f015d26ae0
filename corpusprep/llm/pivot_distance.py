"""Exact largest inner products of whole-number vectors, by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it, and the table is sorted by that key and cut into pages of at
most ``PAGE`` vectors: rings about the pivots. By the triangle inequality a ring of distances lo to hi about p holds nothing nearer to a query q than
gap = max(0, d(q, p) - hi, lo - d(q, p)); as 2<q, x> = |q|^2 + |x|^2 - d(q, x)^2, no inner product in it exceeds
(|q|^2 + top - gap^2) / 2, ``top`` being the ring's greatest squared norm. A query visits the ring it lies in itself, then the others
in order of that bound, 8 times as many in each round, and stops where no ring left can reach its k-th best score; the same
bound cuts a visited page down to the annulus that can matter. The result is exact whatever the pivots are; they are means of a
bounded sample (``fit_bytes``).

Rounds are joins of the rings' pages with blocks of the queries that visit them, so no task gathers more than a
page and a block at a time. The rings' bounds, all that the driver and every task hold, are at most ``RINGS`` rows and one for each
pivot and partition: in larger tables a ring has more pages.

Defined results: a component x counts as floor(256 * x). Vectors that are null or hold a null or non-finite component take no part, nor
those whose squared length in whole numbers is over 2^60 (their products need not fit a long). Zero vectors take part. Products are of vectors with
equally many components; empty vectors have product 0 with each other. Rows with a null id are neither candidates nor queries. Rows equal in id and vector
count once; an id with several vectors is as many candidates, and as a query takes the best products of all its vectors, never with its own id. Ties go to the smaller id. Only the id
and the vector are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize

PAGE, PAGE_BYTES, RINGS, BLOCK, PIVOTS, SEED = 1024, 1 << 20, 1 << 16, 512, 256, 5
GREATEST = 1 << 60
EXACT = float(1 << 52)  # sums of whole numbers up to here are exact in doubles, in any order
ROUNDING = 1e-12  # more than what doubles lose of a sum of squares
PAGES = "ring long, dim int, pivot int, lo double, hi double, top long, width int, far binary, v binary, ids binary, copies binary"


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, norm): the vectors that take part, as little-endian longs, and their squared lengths."""

    @F.arrow_udf("struct<v: binary, norm: bigint>")
    def pack(lists: pa.Array) -> pa.Array:
        at = lists.offsets.to_numpy()
        packed, norms = [], []
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(float) * 256)
        for i, there in enumerate(lists.is_valid().to_pylist()):
            a, n = x[at[i]:at[i + 1]], GREATEST + 1
            if there and (np.abs(a) < 1 << 31).all() and float(a @ a) <= 2 * GREATEST:  # false of NaN and infinity
                a = a.astype("<i8")
                n = int(a @ a)
            packed.append(a.tobytes() if n <= GREATEST else None)
            norms.append(n if n <= GREATEST else None)
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(norms, pa.int64())], ["v", "norm"])

    d = df.select(F.col(id_col).cast("long").alias("id"), pack(F.col(vector_col).cast("array<double>")).alias("p"))
    return d.where("id is not null and p.v is not null").select("id", "p.v", "p.norm")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and of ``b``."""
    most = np.sqrt(max((a * a).sum(1).max(initial=0), 0)) * np.sqrt(max((b * b).sum(1).max(initial=0), 0))
    if most <= EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * products(x, pivots), 0))


def slack(d: np.ndarray | float) -> np.ndarray | float:
    """More than the rounding of a distance can come to."""
    return 1e-9 * (d + 1)


def means(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` pivots: rounded means of a few passes over the sample, from rows chosen by a fixed seed."""
    sample = np.unique(sample, axis=0)
    pivots = sample[np.sort(np.random.default_rng(SEED).permutation(len(sample))[:k])]
    for _ in range(5):
        near = distances(sample, pivots).argmin(1)
        count = np.bincount(near, minlength=len(pivots))
        total = np.zeros(pivots.shape)
        np.add.at(total, near, sample)
        pivots = np.where(count[:, None] > 0, np.round(total / np.maximum(count, 1)[:, None]), pivots).astype(np.int64)
    return np.unique(pivots, axis=0)


def fit(classes: DataFrame, rows: int, fit_bytes: int) -> dict[int, np.ndarray]:
    """Pivots by number of components. Vectors of a number that the sample lacks have the zero vector for a pivot."""
    widest = classes.agg(F.max(F.octet_length("v"))).first()[0] or 0
    want = max(1, min(16 * PIVOTS, fit_bytes // max(8, widest)))
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(max(1, rows // want))) == 0).select("v").limit(2 * want)
    by_dim: dict[int, list[bytes]] = {}
    for r in sample.collect():
        by_dim.setdefault(len(r.v) // 8, []).append(bytes(r.v))
    k = max(1, min(PIVOTS, rows // (2 * PAGE)))
    return {dim: means(np.frombuffer(b"".join(v), "<i8").reshape(len(v), dim), k) for dim, v in by_dim.items() if dim}


def origin(dim: int) -> np.ndarray:
    return np.zeros((1, dim), np.int64)


def _keyed(pivots: dict[int, np.ndarray]):
    @F.arrow_udf("struct<dim: int, pivot: int, far: double>")
    def key(vs: pa.Array) -> pa.Array:
        raw = vs.to_pylist()
        dims = np.array([len(v) // 8 for v in raw], np.int32)
        pivot, far = np.zeros(len(raw), np.int32), np.zeros(len(raw))
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = np.frombuffer(b"".join(raw[i] for i in rows), "<i8").reshape(len(rows), dim)
            d = distances(x, pivots.get(dim, origin(dim)))
            pivot[rows], far[rows] = d.argmin(1), d.min(1)
        return pa.StructArray.from_arrays([pa.array(dims), pa.array(pivot), pa.array(far)], ["dim", "pivot", "far"])

    return key


def narrowest(x: np.ndarray) -> np.ndarray:
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(next(f"<i{w}" for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1)))


def _paged(pages_of_ring: int):
    """Pages of rows that come sorted by number of components, pivot and distance; rings are runs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, made, held, of = TaskContext.get().partitionId() << 32, 0, [], None

        def page(rows: list[dict]) -> pa.RecordBatch:
            dim, pivot = of
            x = narrowest(np.frombuffer(b"".join(r["v"] for r in rows), "<i8").reshape(len(rows), dim))
            far = np.array([r["far"] for r in rows], "<f8")
            ids = np.array([i for r in rows for i in r["ids"]], "<i8")
            copies = np.array([len(r["ids"]) for r in rows], "<i4")
            row = {"ring": ring, "dim": dim, "pivot": pivot, "lo": far[0], "hi": far[-1], "top": max(r["norm"] for r in rows), "width": x.itemsize,
                   "far": far.tobytes(), "v": x.tobytes(), "ids": ids.tobytes(), "copies": copies.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("ring", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("top", pa.int64()),
                            ("width", pa.int32()), *[(c, pa.binary()) for c in ("far", "v", "ids", "copies")]])
        for b in batches:
            for r in b.to_pylist():
                same = of == (r["dim"], r["pivot"])
                if held and (not same or len(held) >= min(PAGE, max(1, PAGE_BYTES // max(1, 8 * of[0])))):
                    yield page(held)
                    held, made = [], made + 1
                    if not same or made == pages_of_ring:
                        ring, made = ring + 1, 0
                of = (r["dim"], r["pivot"])
                held.append(r)
        if held:
            yield page(held)

    return run


def bound(norm: np.ndarray, top: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """At least the greatest inner product that the triangle inequality and the lengths allow."""
    norm, top = norm.astype(float), top.astype(float)
    by_distance = (norm + top - np.maximum(gap, 0) ** 2) / 2
    return np.minimum(by_distance, np.sqrt(norm * top)) + ROUNDING * (norm + top) + 1


class Rings:
    """The rings' bounds, and which of them a query visits in a round."""

    def __init__(self, rows: list, pivots: dict[int, np.ndarray]):
        self.pivots, self.by_dim = pivots, {}
        for r in sorted(rows, key=lambda r: r["ring"]):
            self.by_dim.setdefault(r["dim"], []).append((r["ring"], r["pivot"], r["lo"], r["hi"], r["top"]))
        self.by_dim = {d: [np.array(c) for c in zip(*v)] for d, v in self.by_dim.items()}

    def visit(self, x: np.ndarray, least: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, ring, distance from its pivot): places ``begin`` to ``end`` - 1 of each row's order, without rings that can't
        reach ``least`` (its k-th best score, -inf if it has fewer)."""
        dim = x.shape[1]
        if dim not in self.by_dim:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        ring, pivot, lo, hi, top = self.by_dim[dim]
        d = distances(x, self.pivots.get(dim, origin(dim)))
        far = d[:, pivot]
        gap = np.maximum(np.maximum(far - hi, lo - far), 0)
        most = bound((x * x).sum(1)[:, None], top[None, :], gap - slack(far + hi))
        home = (gap + (pivot[None, :] != d.argmin(1)[:, None]) * (far.max(initial=0) + hi.max(initial=0) + 1)).argmin(1)
        order = most.copy()
        order[np.arange(len(x)), home] = np.inf
        order = np.argsort(-order, 1, kind="stable")[:, begin:end]
        rows, at = np.nonzero(np.take_along_axis(most, order, 1) >= least[:, None])
        col = order[rows, at]
        return rows, ring[col], far[rows, col]


def _route(rings: Rings, begin: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, least = b.column("v").to_pylist(), np.array([-np.inf if s is None else s for s in b.column("least").to_pylist()])
            dims = np.array([len(v) // 8 for v in raw], int)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), 64):
                    few = mine[at:at + 64]
                    x = np.frombuffer(b"".join(raw[i] for i in few), "<i8").reshape(len(few), dim)
                    rows, ring, far = rings.visit(x, least[few], begin, end)
                    for cut in range(0, len(rows), PAGE):
                        part = slice(cut, cut + PAGE)
                        taken = b.take(pa.array(few[rows[part]]))
                        yield pa.RecordBatch.from_arrays([pa.array(ring[part], pa.int64()), pa.array(far[part]), *[taken.column(c) for c in ("q", "id", "v", "least")]],
                                                         ["ring", "far", "q", "id", "v", "least"])

    return run


def best_of_page(x: np.ndarray, far: np.ndarray, top: int, ids: np.ndarray, copies: np.ndarray, own: np.ndarray, q: np.ndarray, q_far: np.ndarray,
                 least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score): each query's ``k`` best rows of a page that reach ``least``, ties to the smaller id.
    ``far``: the page's distances from its pivot in order; ``q_far``: the queries'; ``own``: the ids that they leave out."""
    norm = (q * q).sum(1)
    both = norm.astype(float) + float(top)
    spare = both * (1 + ROUNDING) + 1 - 2 * least  # at least the squared distance from which on no row reaches ``least``
    reach = np.sqrt(np.maximum(spare, 0)) + slack(q_far + far[-1])
    low, high = np.searchsorted(far, q_far - reach, "left"), np.searchsorted(far, q_far + reach, "right")
    live = np.flatnonzero((low < high) & (spare >= 0))
    if not len(live):
        return live, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = low[live].min(), high[live].max()  # the annulus that some query needs
    score = products(q[live], x[low:high])
    begin = np.cumsum(copies) - copies
    first, copies, begin = ids[begin[low:high]], copies[low:high], begin[low:high]
    nothing = np.iinfo(np.int64).min + 1  # its negative is a long, too
    score[(copies == 1)[None, :] & (first[None, :] == own[live][:, None])] = nothing
    cut = np.full(len(live), nothing + 1) if score.shape[1] <= k else -np.partition(-score, k - 1, 1)[:, k - 1]
    rows, cols = np.nonzero((score >= np.maximum(cut, nothing + 1)[:, None]) & (score >= least[live][:, None]))
    n = copies[cols]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[cols], n)
    rows, scores, found = np.repeat(rows, n), np.repeat(score[rows, cols], n), ids[at]
    keep = found != own[live][rows]
    rows, scores, found = rows[keep], scores[keep], found[keep]
    order = np.lexsort((found, -scores, rows))
    rows, scores, found = rows[order], scores[order], found[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return live[rows[nth < k]], found[nth < k], scores[nth < k]


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                dim = row["dim"].as_py()
                far, ids, copies = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("far", "<f8"), ("ids", "<i8"), ("copies", "<i4")))
                x = np.frombuffer(row["v"].as_buffer() or b"", f"<i{row['width'].as_py()}").reshape(len(far), dim).astype(np.int64)
                asked = row["asked"].values
                q = np.frombuffer(b"".join(asked.field("v").to_pylist()), "<i8").reshape(len(asked), dim)
                least = np.array([-np.inf if s is None else s for s in asked.field("least").to_pylist()])
                number, own, q_far = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("q", "id", "far"))
                rows, found, scores = best_of_page(x, far, row["top"].as_py(), ids, copies, own, q, q_far, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(number[rows], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["q", "vec_id", "score"])

    return run


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", fit_bytes: int = 8 << 20, partitions: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest product with each row that ``is_query`` (a condition on the column ``id``) marks, itself
    left out. ``fit_bytes``: the size of the sample that the pivots are fitted on; ``partitions``: of the index."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = materialize(whole_numbers(df, id_col, vector_col), "whole-numbers")
    # equal vectors are one entry with its k + 1 least ids, all that a ranking with ties to the smaller id can use: the windows cut
    # before and after the exchange, so a vector of a third of all rows sends a few ids from each task
    least_ids = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = materialize(least_ids.groupBy("v").agg(F.first("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    n = classes.count()
    asked = materialize(rows.where(is_query).select("id", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    pivots = fit(classes, n, fit_bytes)
    keyed = materialize(classes.withColumn("key", _keyed(pivots)("v")).select("key.*", "v", "norm", "ids"), "keyed")
    parts = partitions or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * PAGE))))
    order = ["dim", "pivot", "far", "v"]
    pages = materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_paged(-(-n // (PAGE * RINGS)) or 1), PAGES), "pages")
    bounds = pages.groupBy("ring", "dim", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top")).collect()
    rings = Rings([r.asDict() for r in bounds], pivots)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best, begin, end = None, 0, 1
    while begin < len(bounds):
        if best is None:
            left = asked.withColumn("least", F.lit(None).cast("long"))
        else:
            left = asked.join(best.where(F.col("n") == k).select("q", F.col("score").alias("least")), "q", "left")
        visits = materialize(left.mapInArrow(_route(rings, begin, end), "ring long, far double, q long, id long, v binary, least long"), "visits")
        sizes = visits.groupBy("ring").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        blocks = (visits.join(sizes, "ring").groupBy("ring", F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"))
                  .agg(F.collect_list(F.struct("q", "id", "v", "least", F.col("far").alias("far"))).alias("asked")).drop("block"))
        found = pages.join(blocks, "ring").select("dim", "top", "width", "far", "v", "ids", "copies", "asked").mapInArrow(_scan(k), "q long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("q", "vec_id", "score"))
        best = materialize(found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k), "best")
        begin, end = end, 9 * end
    if best is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.join(asked.select("q", F.col("id").alias("query_id")), "q").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
