"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates vectors by three rounds of random signs and a fast Hadamard transform and hashes
each to its nearest signed axis (the coordinate of largest size, with its sign);
``functions`` such rotations together make a bucket. For the largest inner product a vector x gains a
coordinate, [x, sqrt(M^2 - |x|^2)], and a query [q, 0], and both
are scaled to the unit sphere, so that the angle orders as the inner product does among vectors of one M. M is not the greatest norm of all,
by which one long vector would squeeze all others into a point, but the upper end of the vector's own range of norms (powers of
``RATIO``); a query's point doesn't depend on M, so the same probes serve all ranges. The longest vectors, a ``LONG_SHARE`` of the
classes and no more than ``LONGEST``, may be near a query by their length at any angle: they stand in one bucket more, which
every query probes. Where all norms are equal (to a millionth), there are neither the coordinate nor this bucket.

Equal vectors are one class, so copies never fill a bucket: a class keeps its
``k + 1`` least ids, which is all that a ranking with ties to the smaller id can use; equal queries
are searched once. Each query probes the ``probes`` best buckets of each table. In a bucket, whose members and
probes are cut into chunks of about ``chunk`` rows, products rank the members; the best of each chunk travel on, are scored
exactly in double precision on the original vectors, and the k best stay. A query that finds
fewer than it should is searched again over all classes, chunk by chunk.

Defined results: vectors that are null, zero, empty or hold a null or non-finite component take no part, nor those whose squared length is
beyond the range of doubles (lengths over 10^154 or under 10^-162); vectors of
another dimension than most rows' are left out likewise; rows with a null id are no
candidates and no queries; rows that repeat an id count as one candidate (the nearest vector); empty in, empty out.
Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize

TABLES, PROBES, CHUNK, SEED = 16, 12, 4096, 7
ROUNDING = 1e-11  # more than two orders of addition can differ by, of the product of the lengths
PAIRS = 1 << 16  # pairs that are multiplied exactly at a time
PROBED = 1 << 14  # probes that a task makes at a time
RATIO = 1.05  # the width of a range of norms
LONG_SHARE, LONGEST, CELLS = 1 / 16, 1 << 16, 32  # the longest vectors, found by counts of norms in cells of a factor of e^(1/32)
LONG, ALL = -1, -2  # numbers of the tables that have one bucket: the longest vectors, all vectors


@lru_cache(maxsize=64)
def signs(table: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, size]).choice([-1.0, 1.0], (3, size))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform of the rows, padded to a power of two."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :d] = x
    for s in signs(table, size):
        y *= s
        h = 1
        while h < size:
            y = y.reshape(n, -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
            h *= 2
        y = y.reshape(n, size) / np.sqrt(size)
    return y


def best_axes(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each row and their coordinates, nearest first."""
    both = np.concatenate([y, -y], 1)
    most = min(most, both.shape[1])
    at = np.argpartition(-both, most - 1, 1)[:, :most]
    value = np.take_along_axis(both, at, 1)
    order = np.argsort(-value, 1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)


def buckets(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """(rows, probes) bucket numbers, best first: the products of the
    functions' axes in order of the sum of their coordinates."""
    number = value = None
    for f in range(functions):
        axes, coordinate = best_axes(rotate(x, table * functions + f), probes)
        width = 2 << max(0, x.shape[1] - 1).bit_length()
        if number is None:
            number, value = axes.astype(np.int64), coordinate
            continue
        # both sides are in order, so a pair of places (i, j) is beaten by (i + 1) * (j + 1) - 1 others
        i, j = np.nonzero(np.outer(np.arange(1, number.shape[1] + 1), np.arange(1, axes.shape[1] + 1)) <= probes)
        number, value = number[:, i] * width + axes[:, j], value[:, i] + coordinate[:, j]
        order = np.argsort(-value, 1, kind="stable")[:, :probes]
        number, value = np.take_along_axis(number, order, 1), np.take_along_axis(value, order, 1)
    return number


def default_probes(functions: int) -> int:
    """As many axes of each function as of a single one: with a fixed number, each further function would lose neighbours."""
    return PROBES ** functions


def to_sphere(x: np.ndarray, even: bool, query: bool) -> np.ndarray:
    """``even``: all norms are alike."""
    norm = np.sqrt((x * x).sum(1))
    if even:
        return x / norm[:, None]
    if query:
        return np.c_[x / norm[:, None], np.zeros(len(x))]
    end = RATIO ** np.ceil(np.log(norm) / np.log(RATIO))
    return np.c_[x / end[:, None], np.sqrt(np.maximum(1 - (norm / end) ** 2, 0))]


def stacked(raw: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, d): the vectors that take part, as little-endian doubles, and their dimension."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists.to_pylist():
            a = None if not x or None in x else np.array(x, "<f8")
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                square = 0.0 if a is None else float(a @ a)
            out.append(a.tobytes() if 0 < square < np.inf else None)  # false of NaN, too
        return pa.array(out, pa.binary())

    d = df.select(F.col(id_col).cast("long").alias("id"), pack(vector_col).alias("v")).where("id is not null and v is not null")
    return d.withColumn("d", (F.octet_length("v") / 8).cast("int"))


def _hashed(tables: int, functions: int, probes: int, even: bool, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = to_sphere(stacked(b.column("v").to_pylist()), even, query)
            few = max(1, PROBED // probes)  # rows at a time, so that many probes don't fill a batch
            for t, at in product(range(tables), range(0, b.num_rows, few)):
                found = buckets(x[at:at + few], t, functions, probes)
                take = np.repeat(np.arange(at, at + len(found)), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t, np.int32)), pa.array(found.ravel()), b.column("c").take(pa.array(take)), b.column("v").take(pa.array(take))], ["t", "b", "c", "v"])

    return run


def _best(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, out = stacked(rows["v"]), []
        ids, keep = rows["c"].to_numpy(), min(k + 1, len(rows))
        for at in range(0, len(queries), 512):
            part = queries.iloc[at:at + 512]
            q = stacked(part["v"])
            s = q @ x.T
            # all rows that may reach the last place, however many tie there: a matrix product rounds in its own order
            cut = -np.partition(-s, keep - 1, 1)[:, keep - 1]
            room = ROUNDING * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
            at_q, at_x = np.nonzero(s >= (cut - room)[:, None])
            # one order of addition for a pair, wherever it meets
            exact = np.concatenate([(q[at_q[i:i + PAIRS]] * x[at_x[i:i + PAIRS]]).sum(1) for i in range(0, len(at_q), PAIRS)])
            order = np.lexsort((ids[at_x], -exact, at_q))
            at_q, at_x, exact = at_q[order], at_x[order], exact[order]
            best = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, "left") <= k
            out.append(pd.DataFrame({"q": part["c"].to_numpy()[at_q[best]], "c": ids[at_x[best]], "score": exact[best]}))
        return pd.concat(out)

    return run


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES,
           probes: int | None = None, functions: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row
    that ``is_query`` (a condition on the column ``id``) marks, itself left out.

    ``functions``: hash functions of a bucket; by default one for up to 2^20 rows and one more for each further factor of 2^7,
    so that buckets stay of a size. ``probes``: see ``default_probes``."""
    spark = df.sparkSession
    bounded_batches(spark)
    d = materialize(vectors(df, id_col, vector_col), "vectors")
    # dimension, number of rows: one row for each dimension there is
    sizes = d.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = d.where(F.col("d") == sizes[0]["d"]), sizes[0]["count"]
    if functions is None:
        functions = 1 + max(0, -(-((n - 1).bit_length() - 20) // 7))
    if probes is None:
        probes = default_probes(functions)

    @F.arrow_udf("double")
    def norm(v: pa.Array) -> pa.Array:
        x = stacked(v.to_pylist()) if len(v) else np.zeros((0, 1))
        return pa.array(np.sqrt((x * x).sum(1)))

    # classes of equal vectors; c is the least id. Each keeps its k + 1 least ids: the windows cut
    # before and after the exchange, so a class of a third of all rows sends a few ids from each task
    copies = d.select("v", "id").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = copies.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    classes = materialize(classes.select("v", "ids", F.col("ids")[0].alias("c"), norm("v").alias("norm")), "classes")
    # at most some 23,000 cells, as many as the range of doubles has
    cells = classes.groupBy(F.floor(F.ln("norm") * CELLS).alias("cell")).agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    cells = sorted(cells.collect(), key=lambda r: -r.cell)
    even, long = cells[-1].least > cells[0].greatest * (1 - 1e-6), float("inf")
    if not even:
        room = min(LONG_SHARE * sum(r.n for r in cells), LONGEST)
        for r in cells:
            room -= r.n
            if room < 0:
                break
            long = r.least
    # each query and c, the least of the queries that have its vector
    asked = d.where(is_query).select("id", "v").distinct()
    asked = materialize(asked.join(asked.groupBy("v").agg(F.min("id").alias("c")), "v").select("id", "c", "v"), "queries")
    queries = asked.where("id = c").select("c", "v").dropDuplicates(["c", "v"])
    hashed = "t int, b bigint, c bigint, v binary"
    one_bucket = lambda rows, t: rows.select(F.lit(t).alias("t"), F.lit(0).cast("long").alias("b"), "c", "v")
    members = classes.where(F.col("norm") < long).select("c", "v").mapInArrow(_hashed(tables, functions, 1, even, False), hashed)
    probes_of = queries.mapInArrow(_hashed(tables, functions, probes, even, True), hashed)
    if long < float("inf"):
        members = members.unionByName(one_bucket(classes.where(F.col("norm") >= long), LONG))
        probes_of = probes_of.unionByName(one_bucket(queries, LONG))

    def parts(rows: DataFrame, name: str) -> DataFrame:
        """The number of chunks of the buckets that need more than one."""
        return materialize(rows.groupBy("t", "b").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name)).where(F.col(name) > 1), name)

    def dealt(rows: DataFrame, member_parts: DataFrame, probe_parts: DataFrame, own: str, other: str) -> DataFrame:
        """``rows`` in one of their bucket's chunks, and once for each chunk of the other side."""
        one = F.lit(1)
        rows = rows.join(member_parts, ["t", "b"], "left").join(probe_parts, ["t", "b"], "left")
        rows = rows.withColumn(f"at_{own}", F.pmod(F.xxhash64("c", "v"), F.coalesce(own, one)).cast("int"))
        return rows.withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("m", "p")

    def found(probe: DataFrame, members: DataFrame) -> DataFrame:
        """(c, id, score): the k + 1 nearest rows of each probing class of queries."""
        both = parts(members, "m"), parts(probe, "p")
        cell = ["t", "b", "at_m", "at_p"]
        near = (dealt(probe, *both, "p", "m").groupBy(*cell).cogroup(dealt(members, *both, "m", "p").groupBy(*cell))
                .applyInPandas(_best(k), "q bigint, c bigint, score double"))
        near = near.groupBy("q", "c").agg(F.max("score").alias("score"))
        near = near.join(classes.select("c", "ids"), "c").select("q", F.explode("ids").alias("id"), "score")
        near = near.groupBy("q", "id").agg(F.max("score").alias("score"))
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        return near.withColumn("n", order).where(F.col("n") <= k + 1).select(F.col("q").alias("c"), "id", "score")

    def ranked(near: DataFrame) -> DataFrame:
        """Each query's own list: its class's, without itself."""
        mine = asked.select(F.col("id").alias("query_id"), "c").join(near, "c").where("query_id != id")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return (mine.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", order).where(F.col("rank") <= k)
                .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))

    first = materialize(found(probes_of, members), "neighbours")
    # classes short of min(k + 1, rows), the query among them: over all classes
    want = min(k + 1, d.select("id").distinct().count())
    enough = first.groupBy("c").count().where(F.col("count") >= want).select("c")
    short = materialize(queries.join(enough, "c", "left_anti"), "short-queries")
    if short.isEmpty():
        return ranked(first)
    again = found(one_bucket(short, ALL), one_bucket(classes, ALL))
    return ranked(first.join(short.select("c"), "c", "left_anti").unionByName(again))
