"""Vocabulary, token ids, padding, labels, detokenising, embedding lookup
(T1-T11, C1, C2).

The tokeniser is whitespace splitting (JVM-side) with a corpus-built
vocabulary. Id lookup has two plans, chosen by a checked vocabulary size:

* vocabulary rows <= ``broadcast_rows`` and bytes <= ``BROADCAST_BYTES``: the vocabulary is broadcast once and
  every Arrow batch is looked up with one vectorised hash probe - a map-only
  plan, no shuffle of the (huge) token stream;
* above it: the most frequent tokens of at most ``HEAD_TOKEN_BYTES`` bytes, within both bounds, are still broadcast
  (rows above a quantile, so nothing is sorted on the driver); by Zipf they resolve most occurrences map-side, and only
  the misses are exploded, shuffle-joined with the full vocabulary and
  patched back into the rows that hold them.

``build_vocab`` counts with map-side partial aggregation, so a hot token costs
one row per task before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import arrays as A
from corpusprep.functions.text import set_apart, split_words
from corpusprep.operators.position import range_index
from corpusprep.session import materialize as materialize_table
from corpusprep.session import spread

# ---- fixed values: special tokens of our vocabulary ------------------------
EOS_TOKEN = "<|endoftext|>"
UNK_TOKEN = "<unk>"
SPECIALS = (EOS_TOKEN, UNK_TOKEN)
EOS_ID, UNK_ID = 0, 1
PAD_ID = EOS_ID  # the trainers set pad_token = eos_token
# ---------------------------------------------------------------------------

# each core's Python worker holds the broadcast rows
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 40 << 20
HEAD_TOKEN_BYTES = 64   # a token can be a whole sentence where words aren't set apart


def _fits(vocab: DataFrame, rows: int) -> bool:
    n, size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    return n <= rows and size + 64 * n <= BROADCAST_BYTES


def _head(vocab: DataFrame, rows: int) -> DataFrame:
    """The most frequent short tokens: rows and bytes are bounded. They are cut off by a quantile, not by a sort with a limit, which
    sends its limit of rows to the driver from every task."""
    order = -F.col("count") if "count" in vocab.columns else F.col("token_id")
    most = min(rows, BROADCAST_BYTES // (64 + HEAD_TOKEN_BYTES))
    short = vocab.where(F.octet_length("token") <= HEAD_TOKEN_BYTES)
    n = short.count()
    if n <= most:
        return short
    cut = short.agg(F.percentile_approx(order, most / n, 20_000)).first()[0]
    return short.where(order < F.lit(cut))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def build_vocab(df: DataFrame, text_col: str = "text", specials=SPECIALS,
                pattern: str = r"[ \n]+", materialize: bool = True, special_rows: bool = False) -> DataFrame:
    """(token, count, token_id); ids by count desc then token, after the
    special tokens. With ``special_rows`` the special tokens are cut out of the texts wherever they stand, counted, and
    rows of the vocabulary like all others, with ids from 0 (count 0 if none stands in a text): so ``special_texts`` and ``token_ids`` give a special
    string its own id, and ``detokenise(..., skip_ids=())`` renders it. The counts and the vocabulary are written as tables in the
    shared checkpoint folder, so the corpus is tokenised once, not once per
    pass over the counts."""
    if special_rows:
        df = special_texts(df, text_col, specials)
    counts = (spread(df.select(text_col)).select(F.explode(F.split(F.col(text_col), pattern)).alias("token"))
                .where(F.col("token") != "")
                .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    if materialize:
        counts = materialize_table(counts, "vocab-counts")
    # cut by ranges of (count, token) themselves, so that equal beginnings spread, too
    own = counts
    if special_rows:
        counts = counts.where(~F.col("token").isin(*specials))
    ranked = range_index(counts, [F.col("count").desc(), F.col("token")], [], "rank")
    vocab = ranked.select("token", "count", (F.col("rank") + len(specials)).alias("token_id"))
    if special_rows:
        rows = F.explode(F.array(*[F.struct(F.lit(s).alias("token"), F.lit(i).cast(vocab.schema["token_id"].dataType).alias("token_id")) for i, s in enumerate(specials)]))
        rows = df.sparkSession.range(1).select(rows.alias("s")).select("s.*")
        found = own.where(F.col("token").isin(*specials))  # at most one row for each
        rows = rows.join(found, "token", "left").select("token", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "token_id")
        vocab = rows.unionByName(vocab)
    return materialize_table(vocab, "vocab") if materialize else vocab


def special_texts(df: DataFrame, text_col: str = "text", specials=SPECIALS) -> DataFrame:
    """``df`` with the special strings in ``text_col`` set apart, to be tokenised with a vocabulary that has them as rows."""
    return df.withColumn(text_col, set_apart(text_col, specials))


def token_ids_with(df: DataFrame, key, text_col: str, tokenizer_factory, out: str = "ids") -> DataFrame:
    """T2 with any tokenizer: ``tokenizer_factory()`` runs once in each worker
    task and gives a function ``list[str] -> list[list[int]]``; a null text has no ids."""
    keys = _keys(key)
    d = df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__cp_text"))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField(out, T.ArrayType(T.IntegerType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_factory()
        for b in batches:
            ids = pa.array(encode(b.column(len(keys)).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(b.columns[:len(keys)]) + [ids], names=keys + [out])

    return d.mapInArrow(run, schema)


def _offsets(lists: pa.ListArray) -> pa.Array:
    """List offsets rebased to 0, matching ``lists.flatten()``."""
    off = lists.offsets
    return pa.compute.subtract(off, off[0]) if len(off) and off[0].as_py() else off


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


_INDEX_CACHE: dict = {}


def _lookup_index(bc, tag: str) -> pd.Index:
    """The first broadcast array (tokens or ids) as a hashed pandas Index, built once per worker."""
    idx = _INDEX_CACHE.get(tag)
    if idx is None:
        idx = pd.Index(bc.value[0])
        _INDEX_CACHE.clear()
        _INDEX_CACHE[tag] = idx
    return idx


def _lookup_ids(df: DataFrame, vocab: DataFrame, keys: list[str], text_col: str, out: str,
                pattern: str, unk_id: int, keep_tokens: bool = False) -> DataFrame:
    """Map-only plan: JVM-side split, one vectorised hash probe per batch.
    ``vocab`` must be small (checked by the caller); misses get ``unk_id``."""
    spark = df.sparkSession
    pv = vocab.select("token", "token_id").toPandas()
    bc = spark.sparkContext.broadcast((pv["token"].to_numpy(dtype=object),
                                       pv["token_id"].to_numpy(dtype=np.int32)))
    tag = uuid.uuid4().hex
    toks = spread(df).select(*keys, split_words(F.col(text_col), pattern).alias("__cp_toks"))
    extra = [T.StructField("__cp_toks", T.ArrayType(T.StringType()), True)] if keep_tokens else []
    schema = T.StructType([toks.schema[k] for k in keys] + extra +
                          [T.StructField(out, T.ArrayType(T.IntegerType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = _lookup_index(bc, tag)
        ids_table = bc.value[1]
        for b in batches:
            lists = b.column(len(keys))
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            pos = idx.get_indexer(flat) if len(flat) else np.zeros(0, np.int64)
            vals = np.where(pos >= 0, ids_table[np.clip(pos, 0, None)] if len(ids_table) else unk_id,
                            unk_id).astype(np.int32)
            arr = pa.ListArray.from_arrays(_offsets(lists), pa.array(vals, pa.int32()), mask=lists.is_null())
            extra_cols = [b.column(len(keys))] if keep_tokens else []
            yield pa.RecordBatch.from_arrays(list(b.columns[:len(keys)]) + extra_cols + [arr],
                                             names=keys + (["__cp_toks"] if keep_tokens else []) + [out])

    return toks.mapInArrow(run, schema)


def token_ids(df: DataFrame, vocab: DataFrame, key, text_col: str = "text",
              out: str = "ids", pattern: str = r"[ \n]+", unk_id: int = UNK_ID,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Token ids in text order; unknown tokens map to ``unk_id``; a
    null or empty text gives an empty array."""
    if _fits(vocab, broadcast_rows):
        r = _lookup_ids(df, vocab, _keys(key), text_col, out, pattern, unk_id)
    else:
        r = _hybrid_ids(df, vocab, _keys(key), text_col, out, pattern, unk_id, broadcast_rows)
    return r.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>")))


_MISS, _ROW = -1, "__cp_row"


def _hybrid_ids(df: DataFrame, vocab: DataFrame, keys: list[str], text_col: str, out: str,
                pattern: str, unk_id: int, head_rows: int) -> DataFrame:
    """Vocabulary too large to broadcast. Token frequencies are Zipfian, so
    the ``head_rows`` most frequent tokens (a bounded top-k) are broadcast and
    resolve most occurrences map-side; only the misses are exploded and
    shuffle-joined against the full vocabulary, and only rows with misses are
    patched. Compared with exploding the whole token stream this shuffles the
    rare occurrences plus the id arrays of rows that hold one."""
    rows, caller = df.withColumn(_ROW, F.monotonically_increasing_id()), keys
    keys = [*keys, _ROW]
    # written once: one pass of the tokeniser, and row ids that hold for all uses below. Rows are put
    # together again by them, not by the caller's keys, which may be null or repeat
    looked = materialize_table(_lookup_ids(rows, _head(vocab, head_rows), keys, text_col, out, pattern, _MISS, keep_tokens=True), "looked-up")
    has_miss = F.exists(out, lambda x: x == _MISS)
    clean = looked.where(~has_miss | F.col(out).isNull()).select(*keys, out)
    dirty = looked.where(has_miss)
    misses = (dirty.select(*keys, F.posexplode(F.arrays_zip(F.col(out).alias("i"), F.col("__cp_toks").alias("t")))
                           .alias("pos", "z"))
                   .where(F.col("z.i") == _MISS)
                   .select(_ROW, "pos", F.col("z.t").alias("token")))
    found = misses.join(vocab.select("token", F.col("token_id").cast("int").alias("tid")), "token", "left")
    patches = found.groupBy(_ROW).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("tid", F.lit(unk_id))))).alias("__cp_fix"))
    clean = clean.select(*caller, out)
    fixed = dirty.join(patches, _ROW, "left").select(
        *caller, F.transform(out, lambda x, i: F.when(x == _MISS, F.element_at("__cp_fix", i))
                           .otherwise(x)).alias(out))
    return clean.unionByName(fixed)


def detokenise(df: DataFrame, vocab: DataFrame, key, ids_col: str = "ids",
               out: str = "text", skip_ids=(EOS_ID, UNK_ID),
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ids -> text, special ids dropped, tokens joined by one space."""
    if _fits(vocab, broadcast_rows):
        return _lookup_tokens(df, vocab, _keys(key), ids_col, out, skip_ids)
    return _hybrid_tokens(df, vocab, _keys(key), ids_col, out, skip_ids, broadcast_rows)


def _lookup_tokens(df: DataFrame, vocab: DataFrame, keys: list[str], ids_col: str, out: str,
                   skip_ids, join: bool = True) -> DataFrame:
    """Map-only plan: ids index a broadcast token array; joining is JVM-side."""
    spark = df.sparkSession
    pv = vocab.select("token", "token_id").toPandas()
    # a hashed id index (not a dense array), so sparse or huge ids cost nothing
    bc = spark.sparkContext.broadcast((pv["token_id"].to_numpy(dtype=np.int64),
                                       pv["token"].to_numpy(dtype=object)))
    tag = uuid.uuid4().hex
    skip = F.array(*[F.lit(i) for i in skip_ids]).cast("array<int>")
    kept = spread(df).select(*keys, F.filter(ids_col, lambda x: ~F.array_contains(skip, x)).alias("__cp_ids"))
    extra = [kept.schema["__cp_ids"]] if not join else []
    schema = T.StructType([kept.schema[k] for k in keys] + extra +
                          [T.StructField("__cp_tok", T.ArrayType(T.StringType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = bc.value[1], _lookup_index(bc, tag)
        for b in batches:
            lists = b.column(len(keys))
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pos = index.get_indexer(flat) if len(flat) else np.zeros(0, np.int64)
            toks = np.full(len(flat), None, dtype=object)
            toks[pos >= 0] = words[pos[pos >= 0]]
            arr = pa.ListArray.from_arrays(_offsets(lists), pa.array(toks, pa.string()), mask=lists.is_null())
            passed = [b.column(len(keys))] if not join else []
            yield pa.RecordBatch.from_arrays(list(b.columns[:len(keys)]) + passed + [arr],
                                             names=keys + (["__cp_ids"] if not join else []) + ["__cp_tok"])

    r = kept.mapInArrow(run, schema)
    if not join:
        return r
    return r.select(*keys, F.array_join(F.filter("__cp_tok", lambda t: t.isNotNull()), " ").alias(out))


def _hybrid_tokens(df: DataFrame, vocab: DataFrame, keys: list[str], ids_col: str, out: str,
                   skip_ids, head_rows: int) -> DataFrame:
    """Same split as ``_hybrid_ids``: the most frequent ids resolve from a
    broadcast array; only ids outside it are joined (shuffle) and patched."""
    caller, keys = keys, [*keys, _ROW]
    skip = F.array(*[F.lit(i) for i in skip_ids]).cast("array<int>")
    kept = df.withColumn(_ROW, F.monotonically_increasing_id()).select(*keys, F.filter(ids_col, lambda x: ~F.array_contains(skip, x)).alias("__cp_ids"))
    looked = _lookup_tokens(kept.withColumnRenamed("__cp_ids", "ids"), _head(vocab, head_rows), keys, "ids", out, (), join=False)
    looked = materialize_table(looked, "looked-up")
    has_miss = F.exists("__cp_tok", lambda t: t.isNull())
    clean = looked.where(~has_miss | F.col("__cp_tok").isNull()).select(*keys, "__cp_tok")
    dirty = looked.where(has_miss)
    misses = (dirty.select(*keys, F.posexplode(F.arrays_zip(F.col("__cp_ids").alias("i"), F.col("__cp_tok").alias("t")))
                           .alias("pos", "z"))
                   .where(F.col("z.t").isNull())
                   .select(_ROW, "pos", F.col("z.i").alias("token_id")))
    found = misses.join(vocab.select(F.col("token_id").cast("int").alias("token_id"), "token"), "token_id", "left")
    patches = found.groupBy(_ROW).agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("__cp_fix"))
    fixed = dirty.join(patches, _ROW, "left").select(
        *keys, F.transform("__cp_tok", lambda t, i: F.coalesce(t, F.element_at("__cp_fix", i))).alias("__cp_tok"))
    both = clean.unionByName(fixed)
    return both.select(*caller, F.array_join(F.filter("__cp_tok", lambda t: t.isNotNull()), " ").alias(out))


def embedding_lookup(df: DataFrame, table: DataFrame, key: str, ids_col: str = "ids",
                     id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """C1 in long form: one row per (key, position) with the looked-up vector
    (null when the id is not in the table). Long form keeps order in ``pos``
    without gathering a whole sequence of vectors into one row.

    A plain equi-join: a row count says little about the bytes of a vector
    table, so the broadcast decision is left to AQE, which measures the
    table's actual size at runtime; frequent ids (skew) are split by AQE's
    skew-join handling otherwise."""
    ex = df.select(key, F.posexplode(ids_col).alias("pos", "token_id"))
    t = table.select(F.col(id_col).cast("long").alias("token_id"), F.col(vec_col).alias("vector"))
    return ex.join(t, ex.token_id.cast("long") == t.token_id, "left").select(
        ex[key], ex.pos, ex.token_id, t.vector)


def _with_longest(df: DataFrame, ids_col: str, batch_col: str) -> DataFrame:
    """``__cp_mx``, the longest sequence of the row's batch, from a narrow
    aggregate; the arrays themselves aren't sorted."""
    longest = df.groupBy(F.col(batch_col).alias("__cp_batch")).agg(F.max(F.size(ids_col)).alias("__cp_mx"))
    return df.join(longest, F.col(batch_col).eqNullSafe(F.col("__cp_batch"))).drop("__cp_batch")


def pad_batch(df: DataFrame, ids_col: str = "ids", batch_col: str = "batch_id",
              eos_id: int = EOS_ID, pad_id: int = PAD_ID, out_ids: str = "labels",
              out_mask: str = "labels_mask") -> DataFrame:
    """T4 + D5: append EOS, right-pad to the longest sequence of the batch + 1."""
    d = materialize_table(df, "batches")   # read twice: once for the sizes, once for the rows
    d = _with_longest(d, ids_col, batch_col)
    padded, mask = A.pad_right_eos(F.col(ids_col), F.col("__cp_mx"), eos_id, pad_id)
    return d.withColumn(out_ids, padded).withColumn(out_mask, mask).drop("__cp_mx")


def pad_left_batch(df: DataFrame, ids_col: str = "ids", batch_col: str = "batch_id",
                   pad_id: int = PAD_ID, out_ids: str = "input_ids",
                   out_mask: str = "input_mask") -> DataFrame:
    """T5: left padding to the longest sequence of the batch."""
    d = _with_longest(materialize_table(df, "batches"), ids_col, batch_col)
    padded, mask = A.pad_left(F.col(ids_col), F.col("__cp_mx"), pad_id)
    return d.withColumn(out_ids, padded).withColumn(out_mask, mask).drop("__cp_mx")


def chat_labels(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", ids_col: str = "ids",
                supervised_role: str = "assistant", turns_per_piece: int = 64) -> DataFrame:
    """Conversation input ids and labels; only ``supervised_role`` turns
    carry their ids as labels, the rest is IGNORE.

    Output is ordered pieces of at most ``turns_per_piece`` turns
    (``piece_no`` = turn div P): concatenating the pieces of a conversation
    in order gives the whole sequence exactly, and no task ever gathers more
    than P turns, however long one conversation is."""
    lab = F.when(F.col(role_col) == supervised_role, F.col(ids_col)).otherwise(
        F.array_repeat(F.lit(A.IGNORE_INDEX), F.size(ids_col)))
    per_turn = turns.select(conv_col, F.floor(F.col(turn_col) / turns_per_piece).cast("long").alias("piece_no"),
                            turn_col, F.col(ids_col).alias("i"), lab.alias("l"))
    g = per_turn.groupBy(conv_col, "piece_no").agg(
        F.array_sort(F.collect_list(F.struct(turn_col, "i", "l"))).alias("__cp_t"))
    return g.select(conv_col, "piece_no",
                    F.flatten(F.transform("__cp_t", lambda s: s["i"])).alias("input_ids"),
                    F.flatten(F.transform("__cp_t", lambda s: s["l"])).alias("labels"))
