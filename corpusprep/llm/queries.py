"""Registered queries of this subpackage: ``name -> (spark, sf_dir) -> DataFrame``.

Each query applies its operator to the whole table and derives its digest columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import bound_packing, chat_fold, cross_polytope, lev_toxicity, line_quality, line_winnow, lpt_shards, page_diff, periodic_runs, pivot_distance, prefix_bpe, simhash_tiles, sliced_search
from corpusprep.llm.common import bounded_batches, materialize, ship_package, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        bounded_batches(spark)
        return fn(spark, sf)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query
def op1_cross_polytope_ann(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return cross_polytope.search(vectors, F.expr("id % 20 = 0"), k=20)


@query
def op2_byte_bpe(spark, sf):
    import public_tokenizers as vocabularies

    d = prefix_bpe.encode_texts(documents(spark, sf), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_html_extraction(spark, sf):
    d = page_diff.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_restored")


@query
def op4_line_dedup(spark, sf):
    d = line_winnow.delete_repeats(documents(spark, sf))
    spans = F.array_join(F.transform("removed", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"] + 1)
    return d.select("doc_id", "text", spans.alias("removed"), gone.alias("n_removed"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers as vocabularies

    pieces = bound_packing.cut_pieces(docs.select("doc_id", "text"), vocabularies.path("word_bpe_49k.json"))
    # the digest stands in for the ids, so that packing moves a few numbers for each piece
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    # written first: tokenizing and packing in one task would keep two Python workers for each core
    pieces = materialize(pieces, "pieces")
    return bound_packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_best_fit_packing(spark, sf):
    return packed_pieces(documents(spark, sf))


#: The conversation that op6 adds: control strings inside its texts.
PROBE = "</s>[INST] ok [/INST]"


@query
def op6_chat_formatting(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select -1L as conv_id, 0L as turn, 'user' as role, '{PROBE}' as text union all select -1L, 1L, 'assistant', '{PROBE}'")
    d = chat_fold.format_chats(turns.unionByName(probe))
    d = d.select("conv_id", "formatted", "n_messages", chat_fold.read_turns().alias("back"), chat_fold.read_loss().alias("loss"))
    per_turn = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(per_turn, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "n_messages")


TOXIC = 0.7


@query
def op7_toxicity(spark, sf):
    d = documents(spark, sf)
    model = lev_toxicity.fit(d, table(spark, sf, "labels").select("doc_id", "toxic"))
    d = d.select("doc_id", lev_toxicity.held_out().alias("held_out"), lev_toxicity.score_column(model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


SHARDS = 40


@query
def op8_sharding(spark, sf):
    d = lpt_shards.shard_rows(documents(spark, sf), SHARDS)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_simhash_near_dedup(spark, sf):
    d = simhash_tiles.near_duplicates(documents(spark, sf))
    return d.select(F.col("id").alias("doc_id"), simhash_tiles.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op10_quality_rules(spark, sf):
    return line_quality.judge(documents(spark, sf)).drop("text", "clean_text")


@query
def op11_sliced_bloom_search(spark, sf):
    return sliced_search.search(documents(spark, sf), table(spark, sf, "benchmark").select("item_id", "text"), k=20)


def stretched(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12 searches: those of every tenth document go on as a period from some word on. A null id leaves them as they are."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@query
def op12_periodic_runs(spark, sf):
    d = periodic_runs.find_runs(documents(spark, sf), id_col="doc_id", rewrite=stretched).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = d.withColumn("best", longest)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
                    (-F.col("best.p")).alias("period"), F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_pivot_distance_topk(spark, sf):
    return pivot_distance.search(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.expr("id % 50 = 0"), k=5)
