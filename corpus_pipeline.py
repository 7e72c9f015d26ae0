"""Corpus pipeline: ``documents`` through five operators, stage by stage.

1. toxicity: documents scored 0.7 or more go;
2. quality rules: failing lines are removed, rejected documents go;
3. line dedup: later copies of repeated line runs are cut out of the texts;
4. near duplicates: one document of each SimHash group stays, that of the least id;
5. packing: the documents left become pieces in sequences of at most 2048 tokens.

A stage gets (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``docs``, with ``text`` and ``n_chars`` as they have
become. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again. A null text stays null as long as its row stays; rows that repeat go
through as often as they stand there, up to the near-duplicate stage, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import lev_toxicity, line_quality, line_winnow, queries, simhash_tiles
from corpusprep.llm.common import bounded_batches, materialize, ship_package, table


def _whole(docs: DataFrame) -> DataFrame:
    """(r, text): the row as one struct, so that no column of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("text"))


def _with_text(d: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``r``, with the text of column ``text``."""
    t = F.when(F.col("r.text").isNotNull(), F.col(text))
    new = {"text": t, "n_chars": F.coalesce(F.length(t), F.lit(0)).cast("long")}
    return d.select(*[new.get(c, F.col("r")[c]).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    bounded_batches(spark)
    model = lev_toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    d = _whole(docs).withColumn("score", lev_toxicity.score_column(model))
    return d.where(F.col("score") < queries.TOXIC).select("r.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_quality.judge(_whole(docs)).where("kept"), docs, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = _whole(docs).withColumn("doc_id", F.col("r.doc_id"))
    return _with_text(line_winnow.delete_repeats(d), docs, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash_tiles.keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return queries.packed_pieces(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("line dedup", line_dedup), ("near duplicates", near_dedup), ("packing", packing)]
#: The toxicity model and the fingerprints have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
