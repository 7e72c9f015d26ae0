"""SimHash near-duplicates by tiled exact comparison.

1. one 64-bit fingerprint for each text (majority bits of its shingles' XXH64);
2. equal fingerprints become one class, so copies never meet again;
3. two fingerprints within ``radius`` bits agree on at least all but ``radius`` of
   ``radius + 2`` blocks: rows that share such a choice of blocks form a run.
   Runs are sorted by population count, laid end to end and cut into tiles, which are compared by numpy
   exclusive-or and bit counts; a pair of tiles whose population counts are
   further apart than the radius is skipped. This finds every pair;
4. a run gives a spanning forest of its links (at most one row for each of
   its rows), and stars contract the forests to components.

A run over ``hot_run`` rows is dealt out over pairs of chunks, so no task holds
it whole, and every pair of its rows still meets.

Defined results: a null or blank text has fingerprint zero, linked like any
other; repeated rows keep their own rows and share the component; a null id never
names a component unless all its ids are null; empty in, empty out. Only the
id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE, TILES_AT_ONCE, HOT_RUN, BLOCK = 32, 1024, 100_000, 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of the word shingles of UTF-8
    ``text``, A-Z lower-cased (``bytes.lower`` and ``bytes.split`` know only
    ASCII letters and white space, which is what the definition asks for)."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*[itertools.islice(words, k, None) for k in range(shingle)])) if n > 1 or len(words) == shingle else [b" ".join(words)]
    hashes, ones = map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.zeros(64, np.int64)
    while (h := np.fromiter(itertools.islice(hashes, BLOCK), np.uint64)).size:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """The fingerprint as a signed 64-bit column."""

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pa.array(np.array([fingerprint(t, shingle) for t in raw], np.uint64).astype(np.int64))

    return fp(F.col(text) if isinstance(text, str) else text)


def union_links(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Labels 0..n-1 (the least index reached) after joining the index pairs."""
    label = np.arange(n)
    for a, b in pairs:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            continue
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = k = parent.get(up, up)
            return k

        for u, v in np.unique(np.stack([x[apart], y[apart]], 1), axis=0).tolist():
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(n)
        for k in list(parent):
            to[k] = root(k)
        label = to[label]
    return label


def near_pairs(run: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` bits in one stretch of whole runs, which ``run`` numbers in order, each run
    sorted by population count. The stretch is cut into tiles, whatever the lengths of its runs, and a tile is compared with
    the tiles ``lag`` places on as long as the run at its end goes on there and the population counts at the two edges are
    no further apart than the radius; beyond that, so are all."""
    n = len(fp)
    tiles = -(-n // TILE)
    pad = tiles * TILE - n
    # what fills the last tile is a run of its own, whose pairs are left out
    runs = np.concatenate([run, np.full(pad, run[-1] + 1)]).reshape(tiles, TILE)
    fps = np.concatenate([fp, np.zeros(pad, fp.dtype)]).reshape(tiles, TILE)
    ones = np.bitwise_count(fps).astype(np.int16)
    # with itself, a tile is compared only if two rows of a run stand in it
    live = np.flatnonzero((runs[:, 1:] == runs[:, :-1]).any(axis=1))
    for lag in range(tiles):
        if lag:
            live = np.arange(tiles - 1) if lag == 1 else live[live + lag < tiles]
            live = live[(runs[live, -1] == runs[live + lag, 0]) & (ones[live + lag, 0] - ones[live, -1] <= radius)]
        if not live.size:
            if lag:
                break
            continue
        for at in range(0, live.size, TILES_AT_ONCE):
            t = live[at:at + TILES_AT_ONCE]
            near = np.bitwise_count(fps[t][:, :, None] ^ fps[t + lag][:, None, :]) <= radius
            near &= runs[t][:, :, None] == runs[t + lag][:, None, :]
            if not lag:
                near &= np.tri(TILE, k=-1, dtype=bool).T
            k, x, y = np.nonzero(near)
            x, y = t[k] * TILE + x, (t[k] + lag) * TILE + y
            real = y < n
            if real.any():
                yield x[real], y[real]


def _forest(radius: int):
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def links(df: pd.DataFrame) -> pd.DataFrame:
            fp = df["fp"].to_numpy().astype(np.uint64)
            run = np.cumsum((df[["g", "k", "i", "j"]].diff() != 0).any(axis=1).to_numpy())
            label = union_links(len(fp), near_pairs(run, fp, radius))
            at = np.flatnonzero(label != np.arange(len(fp)))
            return pd.DataFrame({"u": fp[at].astype(np.int64), "v": fp[label[at]].astype(np.int64)})

        for df in batches:
            if df.empty:
                continue
            key = df[["g", "k", "i", "j"]].to_numpy()
            whole = len(df) - int(np.argmin((key == key[-1]).all(axis=1)[::-1])) if (key != key[-1]).any() else 0
            if not whole:  # all of one run
                if rest and (rest[-1][["g", "k", "i", "j"]].to_numpy()[-1] != key[-1]).any():
                    yield links(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(df)
                continue
            rest.append(df.iloc[:whole])
            yield links(pd.concat(rest, ignore_index=True))
            rest = [df.iloc[whole:]]
        if rest:
            yield links(pd.concat(rest, ignore_index=True))

    return forest


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot_run: int = HOT_RUN) -> DataFrame:
    """(u, v): a spanning forest of the links between the distinct ``fp`` of
    ``fps`` in each run; its components are those of all links."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    kinds = [signed(sum(mask[b] for b in c)) for c in itertools.combinations(range(blocks), blocks - radius)]
    runs = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in kinds])).alias("g", "k"))
    hot = (runs.groupBy("g", "k").count().where(F.col("count") > hot_run)
           .select("g", "k", F.ceil(2 * F.col("count") / hot_run).cast("int").alias("parts")))
    runs = runs.join(hot, ["g", "k"], "left").withColumn("c", F.expr("cast(pmod(xxhash64(fp), coalesce(parts, 1)) as int)"))
    runs = (runs.withColumn("o", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
            .select("g", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp"))
    n = F.bit_count("fp")
    return (runs.repartition("g", "k", "i", "j").sortWithinPartitions("g", "k", "i", "j", n, "fp")
            .mapInPandas(_forest(radius), "u bigint, v bigint"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root): the least node reachable from each node that has a link, by
    alternating large and small stars; each round is a table in the shared
    folder, so lost executors cost one round at most."""
    e = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        pairs = both.join(least, "u")
        if large:
            out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    mark = None
    for _ in range(most_rounds):
        e = materialize(star(star(e, True), False), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select("u", F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, hot_run: int = HOT_RUN) -> DataFrame:
    """(id, fp, component_id) for each row; the id may be of any type that has an order."""
    bounded_batches(df.sparkSession)
    rows = materialize(df.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp")), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(classes.select("fp"), radius, hot_run))
    of = classes.join(roots, classes.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "classes")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` that lead their component: one row of each, of
    the least id; rows equal in all columns count as one."""
    from corpusprep.llm.common import row_key

    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), row_key(df).alias("k"))
    ids = d.select(F.struct(F.col(f"r.`{id_col}`").isNull().alias("none"), F.col(f"r.`{id_col}`").alias("id"), "k").alias("id"),
                   F.col(f"r.`{text_col}`").alias("text"))
    lead = near_duplicates(ids, "id", "text", shingle, radius).select(F.col("component_id.k").alias("k")).distinct()
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    return d.join(lead, "k", "left_semi").withColumn("one", one).where("one = 1").select("r.*")
