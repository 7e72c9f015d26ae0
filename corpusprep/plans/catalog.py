"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them) in full;
parameters are the operators' own (batch size, shard size, max length, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import maps as M
from corpusprep.functions import prompts as P
from corpusprep.functions import text as X
from corpusprep.operators import batches as BT
from corpusprep.operators import enrich as K
from corpusprep.operators import frames as G
from corpusprep.operators import metrics as R
from corpusprep.operators import position as D
from corpusprep.operators import records as J
from corpusprep.operators import tokens as TK
from corpusprep.session import bounded_batches, materialize, parts_by_size, scratch_dir, ship_package, spread
from corpusprep.sources import arrow_ipc, audio, shard_dirs
from corpusprep.sources import sinks as S
from corpusprep.sources.scan import glob_scan, profile, scan_corpus, table
from corpusprep.streaming import enrich_stream as L
from corpusprep.streaming import rate as RT
from corpusprep.streaming import rate_state as RS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# ---- parameters of the registered queries ---------------------------------
BATCH = 100            # enrichment batch size of the reference run
SMALL_BATCH = 64       # E2/E3/B6/B7 parity cases (S not a multiple of B)
SHARD_SIZE = 100
RESUMED = 130          # rows already processed before a resume
MAX_SAMPLES = 500
SHUFFLE_SEED, SHUFFLE_EPOCH = 7, 3
EVAL_ROWS = 100
PEEK_ROW = 20
PROMPT_MAX = 512       # prompt truncation, EOS counted inside
LABEL_MAX = 1024       # transcript truncation, EOS appended after
COLLATE_BATCH = 8      # trainer batch size
SOFT_LEN, SOFT_ID = 20, -1   # soft-prompt slot in an assembled sequence
CHUNK_CHARS = 200      # text segment length
CHUNK_SAMPLES = 20     # sample segment length
STACK_K = 4            # frame stacking / mask downsampling factor
CLIP_SR, TARGET_SR = 44100, 16000
FIXED_LEN = 80         # padding="max_length" of a clip
AUG_SEED, AUG_MASKS, AUG_WIDTH = 11, 2, 8
METRIC_BATCH = 64
TOP_K = 10
RUN_TS = "2024-01-31 00:00:00"   # run time passed in, not now()
FIRST_RUN_CAP = 130              # max_samples of the interrupted first run
RATE_WINDOW_US = 6 * 3600 * 1_000_000
RATE_MAX = 3
WAV_SR = 16000
# ---------------------------------------------------------------------------


def query(name: str):
    """Register a query; executors get the package before its first use."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            bounded_batches(spark)
            return fn(spark, sf)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def docs(spark, sf):
    return table(spark, sf, "documents")


def enriched(spark, sf) -> DataFrame:
    """K1 with the offline client over the whole documents table."""
    return K.enrich(docs(spark, sf), key="doc_id", text_col="text")


def positioned_docs(spark, sf) -> DataFrame:
    return D.ordered_index(docs(spark, sf).select("doc_id"), ["doc_id"])


# ---- A: scans --------------------------------------------------------------
@query("corpus_scan")
def corpus_scan(spark, sf):
    return scan_corpus(spark, f"{sf}/documents.parquet", subset="src3", subset_col="source") \
        .select("doc_id", "text", "lang", "source", "n_chars")


@query("glob_scan")
def q_glob_scan(spark, sf):
    return glob_scan(spark, f"{sf}/doc*.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@query("dataset_profile")
def dataset_profile(spark, sf):
    return profile(docs(spark, sf), exact_distinct=True)


# ---- B: projections and filters -------------------------------------------
@query("project_text")
def project_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("text").alias("input"))


@query("eval_slice")
def q_eval_slice(spark, sf):
    return D.eval_slice(docs(spark, sf).select("doc_id", "n_chars"), ["doc_id"], EVAL_ROWS)


@query("row_peek")
def q_row_peek(spark, sf):
    return D.row_peek(docs(spark, sf).select("doc_id", "text"), ["doc_id"], PEEK_ROW)


@query("resume_skip")
def q_resume_skip(spark, sf):
    return D.resume_skip(positioned_docs(spark, sf), RESUMED, SMALL_BATCH)


@query("sample_cap")
def q_sample_cap(spark, sf):
    d = D.resume_skip(positioned_docs(spark, sf), RESUMED, SMALL_BATCH)
    return D.sample_cap(d, RESUMED, SMALL_BATCH, MAX_SAMPLES)


@query("resume_antijoin")
def q_resume_antijoin(spark, sf):
    done = table(spark, sf, "labels")
    return D.resume_antijoin(docs(spark, sf).select("doc_id"), done, ["doc_id"])


@query("error_split")
def q_error_split(spark, sf):
    return K.error_status(enriched(spark, sf)).select("doc_id", "status", "message")


# ---- D/E: positions, batches, shards --------------------------------------
@query("global_index")
def q_global_index(spark, sf):
    return positioned_docs(spark, sf)


@query("batch_assign")
def q_batch_assign(spark, sf):
    return D.batch_assign(positioned_docs(spark, sf), BATCH)


@query("batch_drop_last")
def q_batch_drop_last(spark, sf):
    d = docs(spark, sf).select("doc_id")
    n = d.count()
    return D.batch_assign(D.batch_drop_last(D.ordered_index(d, ["doc_id"]), SMALL_BATCH, n),
                          SMALL_BATCH)


@query("shard_assign")
def q_shard_assign(spark, sf):
    return D.shard_assign(positioned_docs(spark, sf), SHARD_SIZE, SMALL_BATCH)


@query("epoch_shuffle")
def q_epoch_shuffle(spark, sf):
    return D.epoch_shuffle(docs(spark, sf).select("doc_id"), "doc_id", SHUFFLE_SEED, SHUFFLE_EPOCH)


# ---- F: text ------------------------------------------------------------------
@query("clean_corpus")
def q_clean_corpus(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", X.clean_corpus("text").alias("clean_text"))


@query("unicode_strip")
def q_unicode_strip(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", X.unicode_strip("text").alias("stripped"))


@query("strip_brackets")
def q_strip_brackets(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", X.strip_brackets("text").alias("transcript"))


@query("clean_transcript")
def q_clean_transcript(spark, sf):
    return spread(docs(spark, sf)).select("doc_id", X.clean_transcript("text").alias("transcript"))


@query("enrich")
def q_enrich(spark, sf):
    return enriched(spark, sf)


@query("span_split")
def q_span_split(spark, sf):
    voice, rest = X.span_split_columns(F.col("step1_text"))
    return enriched(spark, sf).select("doc_id", "step1_text", voice.alias("step1_voice_part"),
                                      rest.alias("step1_text_part"))


@query("sft_prompt")
def q_sft_prompt(spark, sf):
    voice, rest = X.span_split_columns(F.col("step1_text"))
    return enriched(spark, sf).select("doc_id", P.sft_prompt(rest, voice).alias("prompt"))



# ---- T / C: tokens ----------------------------------------------------------
def doc_vocab(spark, sf) -> DataFrame:
    return TK.build_vocab(docs(spark, sf), "text")


def doc_token_ids(spark, sf, vocab: DataFrame | None = None) -> DataFrame:
    return TK.token_ids(docs(spark, sf), vocab if vocab is not None else doc_vocab(spark, sf), "doc_id")


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def turn_token_ids(spark, sf) -> DataFrame:
    t = turns(spark, sf)
    vocab = TK.build_vocab(t, "text")
    # the role rides through the lookup as part of the key: no join back
    return TK.token_ids(t, vocab, ["conv_id", "turn", "role"])


def reply_pairs(spark, sf) -> DataFrame:
    """(user turn, next assistant turn) pairs with their token ids."""
    t = materialize(turn_token_ids(spark, sf), "turn-ids")   # read by both sides
    u = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("ids").alias("prompt_ids"))
    a = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("reply_ids"))
    return u.join(a, ["conv_id", "turn"])


@query("vocab")
def q_vocab(spark, sf):
    return doc_vocab(spark, sf)


@query("token_ids")
def q_token_ids(spark, sf):
    return doc_token_ids(spark, sf)


def code_point_tokens():
    """A tokenizer for ``token_ids_with``: the code points of each text."""
    return lambda texts: [[ord(c) for c in t] for t in texts]


@query("char_token_ids")
def q_char_token_ids(spark, sf):
    return TK.token_ids_with(docs(spark, sf), "doc_id", "text", code_point_tokens)


@query("truncate_inside")
def q_truncate_inside(spark, sf):
    return doc_token_ids(spark, sf).select(
        "doc_id", A.truncate("ids", PROMPT_MAX, TK.EOS_ID, eos_inside_limit=True).alias("ids"))


@query("truncate_outside")
def q_truncate_outside(spark, sf):
    return doc_token_ids(spark, sf).select(
        "doc_id", A.truncate("ids", LABEL_MAX, TK.EOS_ID, eos_inside_limit=False).alias("ids"))


def doc_batches(spark, sf) -> DataFrame:
    """Token ids with trainer batches; positions come from the key column
    alone, so the tokeniser runs once."""
    ids = doc_token_ids(spark, sf)
    return D.batch_assign(ids.join(positioned_docs(spark, sf), "doc_id"), COLLATE_BATCH).drop("pos")


def doc_padded(spark, sf) -> DataFrame:
    b = doc_batches(spark, sf).withColumn("ids", A.truncate("ids", LABEL_MAX))
    return TK.pad_batch(b, "ids", "batch_id")


@query("pad_batch")
def q_pad_batch(spark, sf):
    return doc_padded(spark, sf).select("doc_id", "batch_id", "labels", "labels_mask")


@query("pad_left")
def q_pad_left(spark, sf):
    b = doc_batches(spark, sf).withColumn("ids", A.truncate("ids", PROMPT_MAX))
    return TK.pad_left_batch(b, "ids", "batch_id").select("doc_id", "batch_id", "input_ids", "input_mask")


@query("label_budget")
def q_label_budget(spark, sf):
    return doc_padded(spark, sf).groupBy("batch_id").agg(
        (F.max(A.mask_sum("labels_mask")) + 10).cast("long").alias("max_new_tokens"))


@query("detokenise")
def q_detokenise(spark, sf):
    vocab = doc_vocab(spark, sf)
    return TK.detokenise(doc_token_ids(spark, sf, vocab), vocab, "doc_id")


@query("embedding_lookup")
def q_embedding_lookup(spark, sf):
    items = table(spark, sf, "benchmark")
    ids = TK.token_ids(items, doc_vocab(spark, sf), "item_id")
    return TK.embedding_lookup(ids, table(spark, sf, "embeddings"), "item_id")


@query("chat_labels")
def q_chat_labels(spark, sf):
    return TK.chat_labels(turn_token_ids(spark, sf))


@query("target_tokens")
def q_target_tokens(spark, sf):
    convs = turns(spark, sf).select("conv_id").distinct()
    pos = D.ordered_index(convs, ["conv_id"])
    c = D.batch_assign(TK.chat_labels(turn_token_ids(spark, sf)).join(pos, "conv_id"), COLLATE_BATCH)
    return c.groupBy("batch_id").agg(F.sum(A.supervised_count("labels")).cast("long").alias("n_target"))


@query("assemble_sequence")
def q_assemble_sequence(spark, sf):
    p = reply_pairs(spark, sf)
    prompt = A.truncate("prompt_ids", PROMPT_MAX)
    reply = A.truncate("reply_ids", PROMPT_MAX, TK.EOS_ID, eos_inside_limit=True)
    soft = A.constant_ids([SOFT_ID] * SOFT_LEN)
    seq = A.assemble([prompt, soft, reply])
    mask = A.assemble([A.ones_mask(F.size(prompt)), A.ones_mask(SOFT_LEN), A.ones_mask(F.size(reply))])
    return p.select("conv_id", "turn", seq.alias("input_ids"), mask.alias("input_mask"))


@query("label_mask")
def q_label_mask(spark, sf):
    p = reply_pairs(spark, sf).withColumn("prompt_ids", A.truncate("prompt_ids", PROMPT_MAX)) \
        .withColumn("reply_ids", A.truncate("reply_ids", LABEL_MAX))
    keys = D.ordered_index(turns(spark, sf).where(F.col("role") == "user").select("conv_id", "turn")
                           .join(turns(spark, sf).where(F.col("role") == "assistant")
                                 .select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]),
                           ["conv_id", "turn"])
    b = D.batch_assign(p.join(keys, ["conv_id", "turn"]), COLLATE_BATCH)
    padded = TK.pad_batch(b, "reply_ids", "batch_id", out_ids="reply", out_mask="reply_mask")
    lab = A.label_ids(F.size("prompt_ids") + SOFT_LEN, "reply", "reply_mask")
    return padded.select("conv_id", "turn", "batch_id", lab.alias("labels"))


ASSISTANT_IDS = (7, 5, 3)   # the assistant marker's ids
CLIP_LEAST = 16             # samples of the shortest clip


def _examples(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(prompt and reply ids with trainer batches; clips of different lengths) of the pairs whose conversation has a vector."""
    clips = emb(spark, sf).select(F.col("vec_id").alias("conv_id"), "embedding")
    p = reply_pairs(spark, sf).withColumn("prompt_ids", A.truncate("prompt_ids", PROMPT_MAX)).withColumn("reply_ids", A.truncate("reply_ids", LABEL_MAX))
    p = p.join(clips.select("conv_id"), "conv_id", "left_semi")
    t = turns(spark, sf).join(clips.select("conv_id"), "conv_id", "left_semi")
    keys = (t.where(F.col("role") == "user").select("conv_id", "turn")
            .join(t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]))
    text = D.batch_assign(p.join(D.ordered_index(keys, ["conv_id", "turn"]), ["conv_id", "turn"]), COLLATE_BATCH)
    length = (F.lit(CLIP_LEAST) + (F.col("conv_id") * 7 + F.col("turn")) % 49).cast("int")
    audio = keys.join(clips, "conv_id").select("conv_id", "turn", F.slice("embedding", F.lit(1), length).alias("features"))
    return text, audio


@query("train_batch")
def q_train_batch(spark, sf):
    text, audio = _examples(spark, sf)
    d = BT.train_batch(text, audio, ["conv_id", "turn"], assistant_ids=ASSISTANT_IDS, soft_len=SOFT_LEN, stack=STACK_K)
    return d.withColumn("offsets", BT.offset_list())


@query("train_batch_shifted")
def q_train_batch_shifted(spark, sf):
    text, audio = _examples(spark, sf)
    d = BT.train_batch(text, audio, ["conv_id", "turn"], assistant_ids=ASSISTANT_IDS, soft_len=SOFT_LEN, stack=STACK_K, shifted=True)
    return d.select("conv_id", "turn", "batch_id", "attention_mask", "labels", BT.offset_list().alias("offsets"))


# ---- special tokens as rows of the vocabulary ---------------------------------
def special_docs(spark, sf) -> DataFrame:
    """The documents with the end token between their lines, glued to the words around it, and the unknown-word string at the end."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(TK.EOS_TOKEN)), F.lit(TK.UNK_TOKEN))
    return docs(spark, sf).select("doc_id", text.alias("text"))


@query("special_vocab")
def q_special_vocab(spark, sf):
    return TK.build_vocab(special_docs(spark, sf), "text", special_rows=True)


def special_ids(spark, sf) -> tuple[DataFrame, DataFrame]:
    vocab = TK.build_vocab(special_docs(spark, sf), "text", special_rows=True)
    return TK.token_ids(TK.special_texts(special_docs(spark, sf)), vocab, "doc_id"), vocab


@query("special_token_ids")
def q_special_token_ids(spark, sf):
    return special_ids(spark, sf)[0]


@query("special_render")
def q_special_render(spark, sf):
    ids, vocab = special_ids(spark, sf)
    return TK.detokenise(ids, vocab, "doc_id", skip_ids=())


# ---- G: frames and samples ----------------------------------------------------
def emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


@query("segment")
def q_segment(spark, sf):
    return G.segment_text(docs(spark, sf), "doc_id", "text", CHUNK_CHARS)


@query("segment_array")
def q_segment_array(spark, sf):
    return G.segment_array(emb(spark, sf), "vec_id", "embedding", CHUNK_SAMPLES)


@query("segment_rejoin")
def q_segment_rejoin(spark, sf):
    """Documents are hash-partitioned by key once; segmenting keeps that
    partitioning, so the rejoin's grouping needs no second shuffle."""
    d = docs(spark, sf).repartition(_parallelism(spark), "doc_id")
    seg = G.segment_text(d, "doc_id", "text", CHUNK_CHARS)
    return G.with_empty(G.rejoin(seg, "doc_id", sep=" "), docs(spark, sf), "doc_id", "text")


@query("chunk_generate")
def q_chunk_generate(spark, sf):
    """K2: chunk -> model call per chunk -> chunks rejoined in order."""
    seg = G.segment_text(docs(spark, sf), "doc_id", "text", CHUNK_CHARS)
    out = K.enrich_raw(spread(seg), "doc_id", "chunk", K.EchoClient, out="generated")
    joined = G.rejoin(out, "doc_id", seg_col="seg_no", chunk_col="generated", sep=" ")
    return G.with_empty(joined, docs(spark, sf), "doc_id", "text")


@query("frame_stack")
def q_frame_stack(spark, sf):
    f = G.frame_positions(emb(spark, sf), "label", ["vec_id"])
    return G.frame_stack(f, "label", "frame", "embedding", STACK_K, drop_tail=True)


def user_frames(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select(
        "user_id", "event_id", "ts",
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("mask"))
    return G.frame_positions(ev, "user_id", ["ts", "event_id"],
                             proxy=F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


@query("mask_downsample")
def q_mask_downsample(spark, sf):
    return G.mask_downsample(user_frames(spark, sf), "user_id", "frame", "mask", STACK_K)


@query("mask_stride")
def q_mask_stride(spark, sf):
    return G.mask_stride(user_frames(spark, sf), "frame", STACK_K).select("user_id", "event_id", "frame", "mask")


@query("downmix")
def q_downmix(spark, sf):
    return emb(spark, sf).select("vec_id", A.downmix(A.interleaved_to_frames("embedding")).alias("mono"))


@query("resample_linear")
def q_resample_linear(spark, sf):
    return emb(spark, sf).select("vec_id", A.resample_linear("embedding", CLIP_SR, TARGET_SR).alias("samples"))


@query("pad_fixed")
def q_pad_fixed(spark, sf):
    v, m = A.pad_fixed(F.col("embedding").cast("array<double>"), FIXED_LEN)
    return emb(spark, sf).select("vec_id", v.alias("features"), m.alias("feature_mask"))


@query("mask_augment")
def q_mask_augment(spark, sf):
    spans = A.augment_spans("vec_id", AUG_SEED, AUG_MASKS, AUG_WIDTH, F.size("embedding"))
    return emb(spark, sf).select("vec_id", A.apply_mask_spans("embedding", spans).alias("features"))


SPEC_SEED = 5


@query("spec_augment")
def q_spec_augment(spark, sf):
    """G9 on frames: embeddings as clips (label) of frames (vec_id order) with
    64 frequency bins; 10 time masks < 50 (and < T/2), 2 frequency masks < 15."""
    f = G.frame_positions(emb(spark, sf), "label", ["vec_id"])
    return G.spec_augment(f, "label", "frame", "embedding", SPEC_SEED).select("label", "frame", "features")


@query("project_vectors")
def q_project_vectors(spark, sf):
    w = G.projector_weights(64, 16)
    return G.project_vectors(emb(spark, sf).select("vec_id", "embedding"), "embedding", w).drop("embedding")


# ---- metrics --------------------------------------------------------------------
def scored_pairs(spark, sf) -> DataFrame:
    return R.score_pairs(R.pair_turns(turns(spark, sf)))


@query("pair_eval")
def q_pair_eval(spark, sf):
    return R.pair_turns(turns(spark, sf))


@query("cer_macro")
def q_cer_macro(spark, sf):
    return R.cer_macro(scored_pairs(spark, sf)).withColumn("cer_macro", F.round("cer_macro", 9))


@query("cer_by_batch")
def q_cer_by_batch(spark, sf):
    """The mean over evaluation batches of each batch's mean CER, batches being
    consecutive pairs."""
    d = D.ordered_index(scored_pairs(spark, sf).select("conv_id", "turn", "cer"), ["conv_id", "turn"])
    d = D.batch_assign(d, COLLATE_BATCH).where("cer is not null").withColumn("name", F.lit("cer"))
    r = R.metric_rollup(d, "name", "batch_id", "cer")
    return r.select("name", *[F.round(c, 9).alias(c) for c in ("mean_of_batch_means", "weighted_mean")], "n_batches")


@query("cer_micro")
def q_cer_micro(spark, sf):
    return R.cer_micro(scored_pairs(spark, sf)).withColumn("cer_micro", F.round("cer_micro", 9))


@query("wer_micro")
def q_wer_micro(spark, sf):
    return R.wer_micro(scored_pairs(spark, sf))


@query("wer_by_batch")
def q_wer_by_batch(spark, sf):
    """As ``cer_by_batch``, of words."""
    d = D.ordered_index(scored_pairs(spark, sf).select("conv_id", "turn", "wer"), ["conv_id", "turn"])
    d = D.batch_assign(d, COLLATE_BATCH).where("wer is not null").withColumn("name", F.lit("wer"))
    r = R.metric_rollup(d, "name", "batch_id", "wer")
    return r.select("name", *[F.round(c, 9).alias(c) for c in ("mean_of_batch_means", "weighted_mean")], "n_batches")


@query("metric_rollup")
def q_metric_rollup(spark, sf):
    pts = table(spark, sf, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value",
        F.floor(F.col("event_id") / METRIC_BATCH).cast("long").alias("batch"))
    r = R.metric_rollup(pts, "name", "batch", "value")
    return r.select("name", F.round("mean_of_batch_means", 9).alias("mean_of_batch_means"),
                    F.round("weighted_mean", 9).alias("weighted_mean"), "n_batches")


@query("topk_metric")
def q_topk_metric(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id", "value")
    return R.topk(ev, ["event_type"], ["value", "event_id"], TOP_K).withColumn("rank", F.col("rank").cast("long"))


# ---- H: maps and JSON ------------------------------------------------------------
def state_maps(spark, sf) -> DataFrame:
    v = F.col("value")
    m = F.create_map(F.lit("projector.proj.0.weight"), v, F.lit("projector.proj.2.bias"), v * 2,
                     F.lit("projector.projector.scale"), v + 1,
                     F.lit("soft_prompt_embeddings.embeddings"), v / 2,
                     F.lit("speech_encoder.layers.0"), -v, F.lit("llm_model.lm_head"), v * 3)
    return table(spark, sf, "events").select("event_id", m.alias("state"))


def _map_out(df, col):
    return df.select("event_id", M.sorted_keys(col).alias("keys"), M.values_by_sorted_key(col).alias("vals"))


@query("map_drop_prefix")
def q_map_drop_prefix(spark, sf):
    return _map_out(state_maps(spark, sf).withColumn("m", M.drop_prefixes("state")), "m")


@query("map_strip_prefix")
def q_map_strip_prefix(spark, sf):
    return _map_out(state_maps(spark, sf).withColumn("m", M.strip_prefix("state")), "m")


@query("map_known_keys")
def q_map_known_keys(spark, sf):
    model = F.create_map(*[x for k in ("extra", "proj.0.weight", "proj.2.bias", "scale")
                           for x in (F.lit(k), F.lit(0.0))])
    d = state_maps(spark, sf).withColumn("m", M.update_known(model, M.strip_prefix("state")))
    return _map_out(d, "m")


@query("json_props")
def q_json_props(spark, sf):
    ev = table(spark, sf, "events")
    k = F.from_json("props", "map<string,string>")["k"]
    rec = F.to_json(F.struct("event_id", k.cast("int").alias("k")))
    return ev.select("event_id", k.alias("k"), rec.alias("record"))


@query("schema_enforce")
def q_schema_enforce(spark, sf):
    ev = table(spark, sf, "events")
    d = J.enforce(ev.select("event_id", "props"), "props", "k INT")
    return d.select("event_id", "record.k", (F.col("problem") == "").alias("valid"), "problem")


# ---- F: prompts and small string functions --------------------------------------
@query("prompt_header")
def q_prompt_header(spark, sf):
    return turns(spark, sf).where(F.col("role") == "user").select(
        "conv_id", "turn", P.prompt_header("text").alias("prompt"))


@query("prompt_im")
def q_prompt_im(spark, sf):
    return turns(spark, sf).where(F.col("role") == "user").select(
        "conv_id", "turn", P.prompt_im("text").alias("prompt"))


@query("prompt_think")
def q_prompt_think(spark, sf):
    return turns(spark, sf).where(F.col("role") == "user").select(
        "conv_id", "turn", P.prompt_think("text").alias("prompt"))


TURNS_PER_PIECE = 64


@query("render_chat")
def q_render_chat(spark, sf):
    """im-tag blocks of a conversation in turn order, as ordered pieces of
    at most TURNS_PER_PIECE turns (one piece for any usual conversation)."""
    blocks = turns(spark, sf).select(
        "conv_id", F.floor(F.col("turn") / TURNS_PER_PIECE).cast("long").alias("piece_no"), "turn",
        P.im_block("role", "text").alias("block"))
    return G.rejoin(blocks, ["conv_id", "piece_no"], seg_col="turn", chunk_col="block", sep="", out="chat")


@query("render_target")
def q_render_target(spark, sf):
    return turns(spark, sf).where(F.col("role") == "assistant").select(
        "conv_id", "turn", X.append_eos("text", P.EOS_TEXT).alias("target"))


@query("shard_id_parse")
def q_shard_id_parse(spark, sf):
    name = F.when(F.col("lang") == "de", F.concat(F.lit("tmp_"), F.col("doc_id").cast("string"))) \
        .otherwise(X.zero_pad_name("shard_", F.floor(F.col("doc_id") / SMALL_BATCH), 8))
    return docs(spark, sf).select("doc_id", name.alias("name")).withColumn("shard_id", X.parse_shard_id("name"))


@query("format_ts")
def q_format_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", X.format_ts("ts").alias("ts_text"))


@query("shard_union")
def q_shard_union(spark, sf):
    a = table(spark, sf, "benchmark").select(F.lit(0).alias("source_no"), F.col("item_id").alias("id"), "text")
    b = docs(spark, sf).select(F.lit(1).alias("source_no"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(b)



# ---- A: sinks, shards, resume ---------------------------------------------------
def _parallelism(spark) -> int:
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def _enrich_by_shard(d: DataFrame, spark) -> DataFrame:
    """Shard ids are known from positions before the model runs: cluster the
    raw rows by shard (hash, explicit count), so each task enriches and writes
    whole shards - one file per shard, and no shuffle of the enriched rows."""
    return K.enrich(d.repartition(_parallelism(spark), "shard_id"), keep=["pos", "shard_id"])


def _enriched_sharded(spark, sf) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text").join(positioned_docs(spark, sf), "doc_id")
    return _enrich_by_shard(D.shard_assign(d, SHARD_SIZE, SMALL_BATCH), spark)


@query("shard_manifest")
def q_shard_manifest(spark, sf):
    base = scratch_dir(spark, "shards")
    return S.write_shards(_enriched_sharded(spark, sf), base, RUN_TS)


@query("resume_point")
def q_resume_point(spark, sf):
    base = scratch_dir(spark, "shards")
    S.write_shards(_enriched_sharded(spark, sf), base, RUN_TS)
    return S.resume_point(spark, base)


@query("shard_scan")
def q_shard_scan(spark, sf):
    """An interrupted run (capped), then a resumed run; the scan sees both."""
    base = scratch_dir(spark, "shards")
    pos = docs(spark, sf).select("doc_id", "text").join(positioned_docs(spark, sf), "doc_id")
    first = D.sample_cap(pos, 0, SMALL_BATCH, FIRST_RUN_CAP)
    first = _enrich_by_shard(D.shard_assign(first, SHARD_SIZE, SMALL_BATCH), spark)
    S.write_shards(first, base, RUN_TS)
    rp = S.resume_point(spark, base).first()
    processed, last = int(rp["processed"]), int(rp["last_shard_id"])
    rest = D.resume_skip(pos, processed, SMALL_BATCH)
    start = D.skip_count(processed, SMALL_BATCH)
    rest = _enrich_by_shard(D.shard_assign(rest, SHARD_SIZE, SMALL_BATCH,
                                           start_pos=start, first_shard=last + 1), spark)
    S.write_shards(rest, base, RUN_TS)
    return S.scan_shards(spark, base).select("doc_id", "shard_id", "step1_text")


@query("shard_dirs_scan")
def q_shard_dirs_scan(spark, sf):
    """Folders of shards: an interrupted run, the resumed one, a shard that was written anew; read but for shard 0."""
    base = scratch_dir(spark, "shard-dirs")
    d = D.shard_assign(docs(spark, sf).select("doc_id", "text").join(positioned_docs(spark, sf), "doc_id"), SHARD_SIZE, SMALL_BATCH)
    d = materialize(_enrich_by_shard(d, spark).select("doc_id", "original_text", "step1_text", "shard_id"), "enriched")
    for part in (d.where("shard_id < 2"), None, d.where("shard_id = 1")):
        if part is None:
            last = shard_dirs.resume_point_of_dirs(spark, base).first()["last_shard_id"]
            part = d.where(F.col("shard_id") > last)
        shard_dirs.write_shard_dirs(part.repartition(_parallelism(spark), "shard_id"), base, RUN_TS)
    return shard_dirs.read_shard_dirs(spark, base, d.schema).where("shard_id >= 1").select("doc_id", "shard_id", "step1_text")


@query("numbered_shards")
def q_numbered_shards(spark, sf):
    out = scratch_dir(spark, "numbered")
    d = D.shard_assign(positioned_docs(spark, sf), SHARD_SIZE, SMALL_BATCH, shard_col="shard_no")
    n = d.agg(F.max("shard_no")).first()[0]
    S.write_numbered(docs(spark, sf).select("doc_id", "text").join(d.select("doc_id", "shard_no"), "doc_id"), out, "shard_no", (n or 0) + 1)
    return spark.read.parquet(f"{out}/train-*.parquet").select("doc_id", "text", F.col("_metadata.file_name").alias("file_name"))


@query("dataset_descriptor")
def q_dataset_descriptor(spark, sf):
    d = D.shard_assign(positioned_docs(spark, sf), SHARD_SIZE, SMALL_BATCH)
    lab = table(spark, sf, "labels").select("doc_id", F.lit("train").alias("split"))
    d = d.join(lab, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))
    return S.descriptor(d, "split", "shard_id")


@query("descriptor_edit")
def q_descriptor_edit(spark, sf):
    """A9 on a descriptor file that others wrote: stale shard figures, a split that is gone, and keys that we know nothing of."""
    d = D.shard_assign(positioned_docs(spark, sf), SHARD_SIZE, SMALL_BATCH).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    entry = F.struct(F.col("source").alias("name"), F.sum("doc_id").alias("num_bytes"), F.count("*").alias("num_examples"),
                     F.array(F.lit(1), F.lit(2)).alias("shard_lengths"), F.lit(99).alias("num_shards"), F.struct(F.array(F.max("lang"), F.lit("x")).alias("tags")).alias("zz"))
    was = docs(spark, sf).groupBy("source").agg(entry.alias("e")).agg(F.map_from_entries(F.collect_list(F.struct("source", "e"))).alias("m"))
    was = was.select(F.expr("""concat('{"version":{"major":1},"splits":', to_json(m), ',"a key":[1,null,{"b":"\\u00e4"}]}')""").alias("value"))
    path = scratch_dir(spark, "descriptor")
    was.write.mode("overwrite").text(path)
    found = spark.read.text(path, wholetext=True).first()[0]
    return S.edit_descriptor(d.where("source != 'src1'"), "source", "shard_id", found)


@query("publish_version")
def q_publish_version(spark, sf):
    root = scratch_dir(spark, "publish")
    return S.publish_version(table(spark, sf, "labels"), root, "train", "add labels")


LEAST_FILES = 4   # Arrow files to write; more, if the table is larger


@query("arrow_scan")
def q_arrow_scan(spark, sf):
    arrow_ipc.register(spark)
    out = scratch_dir(spark, "ipc")
    d = docs(spark, sf).select("doc_id", "lang", "source", "n_chars", "text")
    d.repartitionByRange(parts_by_size(d, LEAST_FILES), "doc_id").write.format(arrow_ipc.FORMAT).mode("append").save(out)
    return spark.read.format(arrow_ipc.FORMAT).load(out)


@query("arrow_stream_scan")
def q_arrow_stream_scan(spark, sf):
    """A2 over A4: two files to a micro-batch, into Parquet."""
    arrow_ipc.register(spark)
    src, log, out, ck = (scratch_dir(spark, n) for n in ("ipc", "ipc-log", "stream", "ck"))
    d = docs(spark, sf).select("doc_id", "lang", "source", "n_chars", "text")
    d.repartitionByRange(parts_by_size(d, LEAST_FILES), "doc_id").write.format(arrow_ipc.FORMAT).mode("append").save(src)
    rows = spark.readStream.format(arrow_ipc.FORMAT).option("log", log).option("maxFilesPerTrigger", 2).load(src)
    L.drain(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start())
    return spark.read.schema(d.schema).parquet(out)


@query("arrow_file_order")
def q_arrow_file_order(spark, sf):
    """Rows of name-ordered files in the order in which they were written."""
    arrow_ipc.register(spark)
    out = scratch_dir(spark, "ipc")
    t = docs(spark, sf).select("doc_id", "text")
    t.repartitionByRange(parts_by_size(t, LEAST_FILES), "doc_id").sortWithinPartitions("doc_id") \
        .write.format(arrow_ipc.FORMAT).mode("append").save(out)
    d = spark.read.format(arrow_ipc.FORMAT).option("positions", "true").load(out)
    return D.ordered_index(d, ["file_no", "row_no"]).select("doc_id", "text", "pos")


@query("audio_scan")
def q_audio_scan(spark, sf):
    out = scratch_dir(spark, "wav")
    clips = emb(spark, sf).select(F.format_string("clip_%06d", "vec_id").alias("name"), "embedding")
    audio.write_wavs(clips, out, "name", "embedding", WAV_SR)
    a = audio.read_audio(spark, f"{out}/*.wav")
    return a.select(F.regexp_extract("path", r"clip_(\d+)\.wav$", 1).cast("long").alias("vec_id"),
                    F.col("audio.sampling_rate").alias("sampling_rate"),
                    F.col("audio.channels").alias("channels"), F.col("audio.array").alias("samples"))


@query("audio_prepare")
def q_audio_prepare(spark, sf):
    """A6 + G1 + G2: stereo 44.1 kHz WAVs (made from ``embeddings``) are read,
    downmixed when they have two channels and resampled to 16 kHz."""
    out = scratch_dir(spark, "wav")
    clips = emb(spark, sf).select(F.format_string("clip_%06d", "vec_id").alias("name"), "embedding")
    audio.write_wavs(clips, out, "name", "embedding", CLIP_SR, channels=2)
    a = audio.read_audio(spark, f"{out}/*.wav")
    x = F.col("audio.array")
    mono = F.when(F.col("audio.channels") == 2, A.downmix(A.interleaved_to_frames(x))) \
        .otherwise(F.transform(x, lambda v: v.cast("double")))
    return a.select(F.regexp_extract("path", r"clip_(\d+)\.wav$", 1).cast("long").alias("vec_id"),
                    A.resample_linear(mono, F.col("audio.sampling_rate"), TARGET_SR).alias("samples"))


# ---- L: streams ---------------------------------------------------------------------
@query("stream_scan")
def q_stream_scan(spark, sf):
    d = docs(spark, sf)
    out, ck = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ck")
    src = L.source_stream(spark, f"{sf}/documents*.parquet", d.schema, base_path=sf)
    L.run_to_end(L.stream_to_parquet(src.select("doc_id", "text", "lang", "source", "n_chars"), out, ck))
    return spark.read.parquet(out)


@query("stream_enrich")
def q_stream_enrich(spark, sf):
    """The table's own files are the stream; a file is at most one shard."""
    d = docs(spark, sf)
    base, ck = scratch_dir(spark, "shards"), scratch_dir(spark, "ck")
    q = L.stream_enrich(spark, L.source_stream(spark, f"{sf}/documents*.parquet", d.schema, 1, base_path=sf), base, ck, RUN_TS)
    L.run_to_end(q)
    return S.scan_shards(spark, base, schema=None).select("doc_id", "original_text", "step1_text")


@query("stream_rate")
def q_stream_rate(spark, sf):
    """All files are one epoch, so no event is late; a last event, later than
    all others, then moves the watermark past the end of every window. Its own
    windows stay open and are never written."""
    ev = table(spark, sf, "events")
    flush, out, ck = scratch_dir(spark, "flush"), scratch_dir(spark, "rate"), scratch_dir(spark, "ck")
    src = L.source_stream(spark, f"{sf}/events*.parquet", ev.schema, None, base_path=sf)
    agg = lambda s: RT.windowed_rates(s, "ts", "event_type", "value", "1 hour", "30 minutes", "1 hour")
    end = ev.agg(F.max("ts").alias("ts")).where("ts is not null").select((F.col("ts") + F.expr("interval 1 day")).alias("ts"))
    end = end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in ev.schema])
    end.write.mode("overwrite").parquet(flush)
    both = agg(src.unionByName(L.source_stream(spark, flush, ev.schema, None)))
    L.run_to_end(L.stream_to_parquet(both, out, ck))
    return spark.read.parquet(out).withColumn("total", F.round("total", 6))


@query("rate_audit")
def q_rate_audit(spark, sf):
    ev = table(spark, sf, "events")
    return RT.rate_audit(ev, "user_id", "ts", "event_id", RATE_WINDOW_US, RATE_MAX)


STREAM_SLICES = 3


@query("stream_rate_audit")
def q_stream_rate_audit(spark, sf):
    """The events arrive in slices of time, several micro-batches; the watermark allows for a slice's length, so the order within one
    doesn't matter. A last event, later than all windows, closes every bucket; its own stays open."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts").where("ts is not null")
    src, out, ck = (scratch_dir(spark, n) for n in ("requests", "audit", "ck"))
    low, high = ev.agg(F.min(RT.micros("ts")), F.max(RT.micros("ts"))).first()
    if low is None:
        return RT.rate_audit(ev, "user_id", "ts", "event_id", RATE_WINDOW_US, RATE_MAX)
    width = (high - low) // STREAM_SLICES + 1
    for i in range(STREAM_SLICES):
        ev.where(F.floor((RT.micros("ts") - low) / width) == i).write.mode("append").parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    later = (width + 2 * RATE_WINDOW_US) // 1_000_000 * 2
    ev.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"),
                                           (F.col("ts") + F.expr(f"interval {later} seconds")).alias("ts")).write.mode("append").parquet(src)
    requests = L.source_stream(spark, src, ev.schema, max(1, files // STREAM_SLICES))
    with RS.state_store(spark):
        audit = RS.stream_rate_audit(requests, "user_id", "ts", "event_id", RATE_WINDOW_US, RATE_MAX, f"{width // 1_000_000 + 1} seconds")
        L.run_to_end(L.stream_to_parquet(audit, out, ck))
    return spark.read.schema(audit.schema).parquet(out)


# ---- K: hooks ---------------------------------------------------------------------
def batch_stats(t):
    """A collate hook: one summary row per batch (pyarrow in, pyarrow out)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    lens = pc.list_value_length(t.column("ids"))
    return pa.table({"batch_id": pa.array([t.column("batch_id")[0].as_py()], pa.int64()),
                     "n_rows": pa.array([t.num_rows], pa.int64()),
                     "max_len": pa.array([pc.max(lens).as_py() or 0], pa.int64()),
                     "total_tokens": pa.array([pc.sum(lens).as_py() or 0], pa.int64())})


@query("collate_hook")
def q_collate_hook(spark, sf):
    b = doc_batches(spark, sf).select("batch_id", "ids")
    return K.collate(b, "batch_id", batch_stats,
                     "batch_id long, n_rows long, max_len long, total_tokens long")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
