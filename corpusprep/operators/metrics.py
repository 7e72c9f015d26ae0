"""Evaluation metrics and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.edit import char_distance, with_word_distance, words
from corpusprep.session import spread


def pair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
               text_col: str = "text") -> DataFrame:
    """C4: pair each turn (reference) with the next turn (hypothesis) by an
    equi-join on (conversation, turn + 1); the key spreads a huge conversation. Spark sizes the
    join at run time; ``score_pairs`` deals small results out again, as its distances are CPU-bound."""
    ref = turns.select(conv_col, turn_col, F.col(text_col).alias("reference"))
    hyp = turns.select(conv_col, (F.col(turn_col) - 1).alias(turn_col), F.col(text_col).alias("hypothesis"))
    return ref.join(hyp, [conv_col, turn_col], "inner")


def score_pairs(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """F17/F18 per pair; the empty reference gets null scores (not counted)."""
    r, h = F.col(ref), F.col(hyp)
    n_chars = F.length(r)
    n_words = F.size(words(r))
    pairs = spread(pairs)
    return (with_word_distance(pairs.withColumn("char_edits", char_distance(r, h))
                                    .withColumn("ref_chars", n_chars), r, h)
                 .withColumn("ref_words", n_words)
                 .withColumn("cer", F.when(n_chars > 0, F.col("char_edits") / n_chars))
                 .withColumn("wer", F.when(n_words > 0, F.col("word_edits") / n_words)))


def cer_macro(scored: DataFrame) -> DataFrame:
    """Mean of per-pair CER."""
    return scored.agg(F.avg("cer").alias("cer_macro"), F.count("cer").alias("n_pairs"))


def cer_micro(scored: DataFrame) -> DataFrame:
    """Total character edits / total reference characters."""
    s = scored.where(F.col("ref_chars") > 0)
    return s.agg((F.sum("char_edits") / F.sum("ref_chars")).alias("cer_micro"),
                 F.count(F.lit(1)).alias("n_pairs"))


def wer_micro(scored: DataFrame) -> DataFrame:
    """Total word edits / total reference words."""
    s = scored.where(F.col("ref_words") > 0)
    return s.agg((F.sum("word_edits") / F.sum("ref_words")).alias("wer_micro"),
                 F.count(F.lit(1)).alias("n_pairs"))


def metric_rollup(points: DataFrame, name_col: str, batch_col: str, value_col: str) -> DataFrame:
    """Per metric, the unweighted mean of batch means (what a logger's
    epoch mean reports) and the weighted mean over all points."""
    b = points.groupBy(name_col, batch_col).agg(F.avg(value_col).alias("__cp_m"),
                                               F.count(F.lit(1)).alias("__cp_n"),
                                               F.sum(value_col).alias("__cp_s"))
    return b.groupBy(name_col).agg(F.avg("__cp_m").alias("mean_of_batch_means"),
                                   (F.sum("__cp_s") / F.sum("__cp_n")).alias("weighted_mean"),
                                   F.count(F.lit(1)).alias("n_batches"))


def topk(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Best k rows per group; Spark plans a partial WindowGroupLimit before
    the shuffle, so a hot group ships at most k rows per task."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
