"""Segments, frame stacking, mask downsampling and vector projection
(G3-G7, G10, D11, D12).

Frame sequences are kept in *long form* - one row per (clip, frame) - so a
long clip is spread over tasks; a group of k frames is the only thing ever
gathered into one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.operators.position import ordered_index


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chunk_starts(n: Column, size: int) -> Column:
    """0..ceil(n/size)-1, empty for n = 0 (``range(0, n, size)``)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)) \
        .otherwise(F.array().cast("array<int>"))


def segment_text(df: DataFrame, key: str, text_col: str, chunk_chars: int,
                 seg_col: str = "seg_no", out: str = "chunk") -> DataFrame:
    """G3 on text: fixed chunks of ``chunk_chars`` code points, last one short.
    The chunk array is built once per row and exploded, so an output row
    carries its chunk only, never another copy of the whole text."""
    t = F.col(text_col)
    chunks = F.transform(_chunk_starts(F.length(t), chunk_chars),
                         lambda i: F.substring(t, i * chunk_chars + 1, F.lit(chunk_chars)))
    return df.select(key, F.posexplode(chunks).alias(seg_col, out))


def segment_array(df: DataFrame, key: str, arr_col: str, chunk_len: int,
                  seg_col: str = "seg_no", out: str = "chunk") -> DataFrame:
    """G3 on samples: ``audio[i:i+L]`` for i in range(0, n, L)."""
    a = F.col(arr_col)
    chunks = F.transform(_chunk_starts(F.size(a), chunk_len),
                         lambda i: F.slice(a, i * chunk_len + 1, F.lit(chunk_len)))
    return df.select(key, F.posexplode(chunks).alias(seg_col, out))


def with_empty(joined: DataFrame, df: DataFrame, key: str, text_col: str, out: str = "text") -> DataFrame:
    """Rows whose text is null or empty have no segment; their rejoined text is empty."""
    none = df.where(F.coalesce(F.length(text_col), F.lit(0)) == 0)
    return joined.unionByName(none.select(key, F.lit("").alias(out)))


def rejoin(df: DataFrame, key, seg_col: str = "seg_no", chunk_col: str = "chunk",
           sep: str = " ", out: str = "text") -> DataFrame:
    """``sep.join(chunks)`` in segment order, one row per key (a key
    is one input row's pieces, or an explicitly bounded piece of a group)."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct(seg_col, chunk_col))).alias("__cp_s"))
              .select(*keys, F.array_join(F.transform("__cp_s", lambda s: s[chunk_col]), sep).alias(out)))


def frame_positions(df: DataFrame, clip_col: str, order_cols, pos_col: str = "frame", **kw) -> DataFrame:
    """0-based frame index inside each clip (skew-safe ordered index)."""
    return ordered_index(df, order_cols, partition_cols=[clip_col], pos_col=pos_col, **kw)


def frame_stack(df: DataFrame, clip_col: str, frame_col: str, vec_col: str, k: int,
                drop_tail: bool = False, out: str = "stacked", group_col: str = "group_no") -> DataFrame:
    """``[T, H] -> [T/k, k*H]`` in long form. T % k != 0 raises (the
    reference's check) unless ``drop_tail``; only the last group of a clip can
    be short, so the check needs no extra pass."""
    g = (df.groupBy(clip_col, F.floor(F.col(frame_col) / k).cast("long").alias(group_col))
           .agg(F.count(F.lit(1)).alias("__cp_n"),
                F.array_sort(F.collect_list(F.struct(F.col(frame_col), F.col(vec_col)))).alias("__cp_f")))
    stacked = F.flatten(F.transform("__cp_f", lambda s: s[vec_col]))
    if drop_tail:
        return g.where(F.col("__cp_n") == k).select(clip_col, group_col, stacked.alias(out))
    checked = F.when(F.col("__cp_n") == k, stacked).otherwise(F.raise_error(
        F.lit("frame_stack: a clip's frame count is no multiple of k")))
    return g.select(clip_col, group_col, checked.alias(out))


def mask_downsample(df: DataFrame, clip_col: str, frame_col: str, mask_col: str, k: int,
                    group_col: str = "group_no", out: str = "mask") -> DataFrame:
    """A group of k frames is 1 if any frame is 1; the zero padding
    of a short last group cannot change a max."""
    return (df.groupBy(clip_col, F.floor(F.col(frame_col) / k).cast("long").alias(group_col))
              .agg(F.max(mask_col).alias(out)))


def mask_stride(df: DataFrame, frame_col: str, k: int) -> DataFrame:
    """G7 in long form: ``mask[::k]``."""
    return df.where(F.col(frame_col) % k == 0)


def projector_weights(in_dim: int, out_dim: int, hidden: int = 2048, seed: int = 0) -> dict:
    """Deterministic weights for G10 (Linear -> ReLU -> Linear); in practice
    they come from a trained checkpoint."""
    rng = np.random.default_rng(seed)
    return {"w1": (rng.standard_normal((in_dim, hidden)) / np.sqrt(in_dim)).astype(np.float32),
            "b1": np.zeros(hidden, np.float32),
            "w2": (rng.standard_normal((hidden, out_dim)) / np.sqrt(hidden)).astype(np.float32),
            "b2": np.zeros(out_dim, np.float32)}


def project_vectors(df: DataFrame, vec_col: str, weights: dict, out: str = "projected") -> DataFrame:
    """Batch scoring of the dense projector with broadcast weights, one
    numpy matmul per Arrow batch."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(weights)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _project(v: pd.Series) -> pd.Series:
        w = bc.value
        if len(v) == 0:
            return pd.Series([], dtype=object)
        there = v.notna().to_numpy()
        y = np.full(len(v), None, dtype=object)  # a null vector stays null
        if there.any():
            x = np.stack([np.asarray(a, np.float32) for a in v[there]])
            h = np.maximum(x @ w["w1"] + w["b1"], 0.0)
            for at, row in zip(np.flatnonzero(there), (h @ w["w2"] + w["b2"]).astype(np.float32)):
                y[at] = row
        return pd.Series(y)

    return df.withColumn(out, _project(F.col(vec_col)))


def _hash_int(parts: list[Column], lo: int, n: int) -> Column:
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, lo, n), 16, 10).cast("long")


def spec_augment(df: DataFrame, clip_col: str, frame_col: str, vec_col: str, seed: int,
                 n_time_masks: int = 10, time_mask_param: int = 50, n_freq_masks: int = 2,
                 freq_mask_param: int = 15, p: float = 0.5, out: str = "features",
                 fill: float = 0.0, training: bool = True) -> DataFrame:
    """G9 on a long-form feature matrix (one row per frame, a vector of
    frequency bins): ``n_time_masks`` time masks of width < min(param, p*T)
    zero whole frames, ``n_freq_masks`` frequency masks of width < param zero
    the same bins in every frame of the clip. Each clip's spans are drawn from
    (set to ``fill``, e.g. a data mean; not at all unless ``training``) from
    ``md5(seed:kind:clip:mask)``, so every engine and every re-run draws the
    same masks. Clip lengths come from a per-clip count (one row per clip),
    not from a window over a possibly huge clip."""
    if not training:
        return df.withColumn(out, F.transform(vec_col, lambda x: x.cast("double")))
    lengths = df.groupBy(clip_col).agg(F.count(F.lit(1)).alias("__cp_T"))
    d = df.join(lengths, clip_col)
    clip, T, bins = F.col(clip_col), F.col("__cp_T"), F.size(vec_col)
    max_t = F.least(F.lit(time_mask_param).cast("long"), F.floor(T * F.lit(p)).cast("long"))

    def span(kind: str, m: Column, size: Column, max_w: Column):
        key = [F.lit(seed), F.lit(kind), clip, m]
        width = F.when(max_w > 0, _hash_int(key, 1, 8) % max_w).otherwise(F.lit(0).cast("long"))
        start = _hash_int(key, 9, 8) % (size - width + 1)
        return F.struct(start.alias("start"), width.alias("width"))

    t_spans = F.transform(F.sequence(F.lit(0), F.lit(n_time_masks - 1)), lambda m: span("t", m, T, max_t))
    f_spans = F.transform(F.sequence(F.lit(0), F.lit(n_freq_masks - 1)),
                          lambda m: span("f", m, bins.cast("long"), F.lit(freq_mask_param).cast("long")))
    d = d.withColumn("__cp_ts", t_spans).withColumn("__cp_fs", f_spans)
    in_time = F.exists("__cp_ts", lambda s: (F.col(frame_col) >= s["start"]) & (F.col(frame_col) < s["start"] + s["width"]))
    masked = F.when(in_time, F.array_repeat(F.lit(float(fill)), bins)).otherwise(
        F.transform(vec_col, lambda x, i: F.when(
            F.exists("__cp_fs", lambda s: (i >= s["start"]) & (i < s["start"] + s["width"])), F.lit(float(fill)))
            .otherwise(x.cast("double"))))
    return d.withColumn(out, masked).drop("__cp_T", "__cp_ts", "__cp_fs")
