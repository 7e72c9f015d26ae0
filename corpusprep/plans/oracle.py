"""DuckDB SQL for each registered query (same column names and types)."""

from __future__ import annotations

from corpusprep.functions.text import REPLY_INSTRUCTION, TRANSCRIPT_DELETE, TRANSCRIPT_STRIP
from corpusprep.plans import catalog as C

SQL: dict[str, str] = {}

# Spelled out here, apart from the code under test: all but letters, numbers, the underscore and four
# marks goes; white space is what Python's str.isspace() says.
CORPUS_DROP = r"[^\p{L}\p{N}_。、？！]"
UNICODE_SPACE = "[" + "".join(chr(c) for c in range(0x10000) if chr(c).isspace()) + "]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_q(chr(92) + 'A' + UNICODE_SPACE + '+|' + UNICODE_SPACE + '+' + chr(92) + 'z')}, '', 'g')"


def clean_sql(x: str) -> str:
    return f"regexp_replace({x}, {_q(CORPUS_DROP)}, '', 'g')"


POS_DOCS = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"

ENRICHED = f"""(SELECT doc_id, text AS original_text,
  CASE WHEN text IS NULL THEN NULL
       WHEN doc_id % 97 = 0 THEN 'ERROR: offline'
       ELSE {clean_sql(strip_sql("substr(text, 1, length(text) // 2) || '[startofspeech]' || substr(text, length(text) // 2 + 1) || '[endofspeech]'"))}
  END AS step1_text
FROM documents)"""

SPAN = "regexp_extract(step1_text, '(?s)startofspeech(.*?)endofspeech', 1)"
VOICE = strip_sql(SPAN)
REST = strip_sql(f"{_q(REPLY_INSTRUCTION)} || replace(step1_text, 'startofspeech' || {SPAN} || 'endofspeech', '')")

SQL["corpus_scan"] = "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE source = 'src3'"
SQL["glob_scan"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SQL["dataset_profile"] = """
SELECT ordinal, column_name, data_type, n_rows, n_nulls, n_distinct FROM (VALUES
 (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'),
 (3, 'source', 'string'), (4, 'n_chars', 'bigint')) AS c(ordinal, column_name, data_type)
JOIN (
 SELECT 0 AS o, count(*) AS n_rows, count(*) - count(doc_id) AS n_nulls, count(DISTINCT doc_id) AS n_distinct FROM documents UNION ALL
 SELECT 1, count(*), count(*) - count(text), count(DISTINCT text) FROM documents UNION ALL
 SELECT 2, count(*), count(*) - count(lang), count(DISTINCT lang) FROM documents UNION ALL
 SELECT 3, count(*), count(*) - count(source), count(DISTINCT source) FROM documents UNION ALL
 SELECT 4, count(*), count(*) - count(n_chars), count(DISTINCT n_chars) FROM documents
) s ON s.o = c.ordinal"""
SQL["project_text"] = "SELECT doc_id, text AS input FROM documents"
SQL["eval_slice"] = f"SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {C.EVAL_ROWS}"
SQL["row_peek"] = f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 4 OFFSET {C.PEEK_ROW}"
_SKIP = -(-C.RESUMED // C.SMALL_BATCH) * C.SMALL_BATCH
SQL["resume_skip"] = f"SELECT doc_id, pos FROM {POS_DOCS} p WHERE pos >= {_SKIP}"
SQL["sample_cap"] = (f"SELECT doc_id, pos FROM {POS_DOCS} p WHERE pos >= {_SKIP} AND "
                     f"{C.RESUMED} + ((pos - {_SKIP}) // {C.SMALL_BATCH}) * {C.SMALL_BATCH} < {C.MAX_SAMPLES}")
SQL["resume_antijoin"] = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
SQL["error_split"] = f"""SELECT doc_id,
  CASE WHEN starts_with(step1_text, 'ERROR: ') THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN starts_with(step1_text, 'ERROR: ') THEN substr(step1_text, 8) END AS message
FROM {ENRICHED} e"""
SQL["global_index"] = f"SELECT doc_id, pos FROM {POS_DOCS} p"
SQL["batch_assign"] = f"SELECT doc_id, pos, pos // {C.BATCH} AS batch_id FROM {POS_DOCS} p"
SQL["batch_drop_last"] = (f"SELECT doc_id, pos, pos // {C.SMALL_BATCH} AS batch_id FROM {POS_DOCS} p "
                          f"WHERE pos < ((SELECT count(*) FROM documents) // {C.SMALL_BATCH}) * {C.SMALL_BATCH}")
_PER_SHARD = -(-C.SHARD_SIZE // C.SMALL_BATCH) * C.SMALL_BATCH
SQL["shard_assign"] = f"SELECT doc_id, pos, CAST(pos // {_PER_SHARD} AS INTEGER) AS shard_id FROM {POS_DOCS} p"
SQL["epoch_shuffle"] = (f"SELECT doc_id, row_number() OVER (ORDER BY md5('{C.SHUFFLE_SEED}:{C.SHUFFLE_EPOCH}:' || "
                        f"CAST(doc_id AS VARCHAR)), doc_id) - 1 AS shuffle_pos FROM documents")
SQL["clean_corpus"] = f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents"
SQL["unicode_strip"] = f"SELECT doc_id, {strip_sql('text')} AS stripped FROM documents"
_tb = f"trim(text, {_q(TRANSCRIPT_STRIP)})"
for _s in TRANSCRIPT_DELETE:
    _tb = f"replace({_tb}, {_q(_s)}, '')"
SQL["strip_brackets"] = f"SELECT doc_id, {_tb} AS transcript FROM documents"
# no text of the given tables is changed by NFKC, so the plain form is the whole result (NFKC itself: tests/test_text.py)
SQL["clean_transcript"] = SQL["strip_brackets"]
SQL["enrich"] = f"SELECT doc_id, original_text, step1_text FROM {ENRICHED} e"
SQL["span_split"] = (f"SELECT doc_id, step1_text, {VOICE} AS step1_voice_part, {REST} AS step1_text_part "
                     f"FROM {ENRICHED} e")
SQL["sft_prompt"] = (f"SELECT doc_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || {REST} || "
                     f"'<|eot_id|><|start_header_id|>user<|end_header_id|>' || {VOICE} || "
                     f"'<|eot_id|><|start_header_id|>assistant<|end_header_id|>' AS prompt FROM {ENRICHED} e")



# ---- tokens -------------------------------------------------------------------------
def vocab_sql(tbl: str) -> str:
    return f"""(SELECT token, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS token_id
FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS token FROM {tbl}) t WHERE token <> '' GROUP BY token)"""


def ids_sql(tbl: str, keys: str, vocab: str) -> str:
    """Token ids per row of ``tbl`` keyed by ``keys`` (comma list)."""
    return f"""(SELECT {keys}, coalesce(x.ids, []::INTEGER[]) AS ids FROM {tbl} LEFT JOIN (
  SELECT {keys}, list(CAST(coalesce(v.token_id, 1) AS INTEGER) ORDER BY p) AS ids FROM (
    SELECT {keys}, unnest(toks) AS token, unnest(range(len(toks))) AS p FROM (
      SELECT {keys}, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS toks FROM {tbl}) a) t
  LEFT JOIN {vocab} v USING (token) GROUP BY {keys}) x USING ({keys}))"""


DOC_VOCAB = vocab_sql("documents")
DOC_IDS = ids_sql("documents", "doc_id", DOC_VOCAB)
TURN_IDS = f"""(SELECT c.conv_id, c.turn, c.role, i.ids FROM conversations c
  JOIN {ids_sql("conversations", "conv_id, turn", vocab_sql("conversations"))} i USING (conv_id, turn))"""
DOC_BATCH = f"""(SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // {C.COLLATE_BATCH} AS batch_id FROM {DOC_IDS} i)"""
DOC_PADDED = f"""(SELECT doc_id, batch_id,
   list_resize(list_slice(ids, 1, {C.LABEL_MAX}) || [0], mx + 1, 0) AS labels,
   list_resize(list_transform(list_slice(ids, 1, {C.LABEL_MAX}) || [0], lambda x: 1), mx + 1, 0) AS labels_mask
 FROM (SELECT *, max(len(list_slice(ids, 1, {C.LABEL_MAX}))) OVER (PARTITION BY batch_id) AS mx FROM {DOC_BATCH} b) m)"""
CHAT = f"""(SELECT conv_id, turn // 64 AS piece_no, flatten(list(ids ORDER BY turn)) AS input_ids,
  flatten(list(CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn)) AS labels
 FROM {TURN_IDS} t GROUP BY conv_id, turn // 64)"""
PAIRS = f"""(SELECT u.conv_id, u.turn, u.ids AS prompt_ids, a.ids AS reply_ids FROM {TURN_IDS} u
  JOIN {TURN_IDS} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

SQL["vocab"] = f"SELECT token, count, token_id FROM {DOC_VOCAB} v"
SQL["token_ids"] = f"SELECT doc_id, ids FROM {DOC_IDS} i"
SQL["char_token_ids"] = "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::INTEGER[] ELSE list_transform(string_split(text, ''), lambda x: unicode(x)::INTEGER) END AS ids FROM documents"
SQL["truncate_inside"] = f"SELECT doc_id, list_slice(ids || [0], 1, {C.PROMPT_MAX}) AS ids FROM {DOC_IDS} i"
SQL["truncate_outside"] = f"SELECT doc_id, list_slice(ids, 1, {C.LABEL_MAX}) || [0] AS ids FROM {DOC_IDS} i"
SQL["pad_batch"] = f"SELECT doc_id, batch_id, labels, labels_mask FROM {DOC_PADDED} p"
SQL["pad_left"] = f"""SELECT doc_id, batch_id,
  list_resize([]::INTEGER[], mx - len(t), 0) || t AS input_ids,
  list_resize([]::INTEGER[], mx - len(t), 0) || list_transform(t, lambda x: 1) AS input_mask
FROM (SELECT doc_id, batch_id, t, max(len(t)) OVER (PARTITION BY batch_id) AS mx
      FROM (SELECT doc_id, batch_id, list_slice(ids, 1, {C.PROMPT_MAX}) AS t FROM {DOC_BATCH} b) b2) m"""
SQL["label_budget"] = f"""SELECT batch_id, CAST(max(list_sum(labels_mask)) + 10 AS BIGINT) AS max_new_tokens FROM {DOC_PADDED} p GROUP BY batch_id"""
SQL["detokenise"] = """SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> ''), ' ') AS text FROM documents"""
SQL["embedding_lookup"] = f"""SELECT t.item_id, CAST(t.p AS INTEGER) AS pos, CAST(coalesce(v.token_id, 1) AS INTEGER) AS token_id,
  e.embedding AS vector
FROM (SELECT item_id, unnest(toks) AS token, unnest(range(len(toks))) AS p FROM (
  SELECT item_id, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS toks FROM benchmark) a) t
LEFT JOIN {DOC_VOCAB} v USING (token)
LEFT JOIN embeddings e ON e.vec_id = coalesce(v.token_id, 1)"""
SQL["chat_labels"] = f"SELECT conv_id, piece_no, input_ids, labels FROM {CHAT} c"
SQL["target_tokens"] = f"""SELECT batch_id, CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS n_target
FROM {CHAT} c JOIN (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // {C.COLLATE_BATCH} AS batch_id
                    FROM (SELECT DISTINCT conv_id FROM conversations) d) b USING (conv_id) GROUP BY batch_id"""
_P = f"list_slice(prompt_ids, 1, {C.PROMPT_MAX})"
_R = f"list_slice(reply_ids || [0], 1, {C.PROMPT_MAX})"
SQL["assemble_sequence"] = f"""SELECT conv_id, turn,
  {_P} || list_resize([]::INTEGER[], {C.SOFT_LEN}, {C.SOFT_ID}) || {_R} AS input_ids,
  list_resize([]::INTEGER[], len({_P}) + {C.SOFT_LEN} + len({_R}), 1) AS input_mask
FROM {PAIRS} p"""
SQL["label_mask"] = f"""SELECT conv_id, turn, batch_id,
  list_resize([]::INTEGER[], len(pr) + {C.SOFT_LEN}, -100) ||
  list_transform(list_resize(r || [0], mx + 1, 0), lambda x, i: CASE WHEN i <= len(r) + 1 THEN x ELSE -100 END) AS labels
FROM (SELECT *, max(len(r)) OVER (PARTITION BY batch_id) AS mx FROM (
  SELECT conv_id, turn, list_slice(prompt_ids, 1, {C.PROMPT_MAX}) AS pr, list_slice(reply_ids, 1, {C.LABEL_MAX}) AS r,
    (row_number() OVER (ORDER BY conv_id, turn) - 1) // {C.COLLATE_BATCH} AS batch_id FROM {PAIRS} p) a) b"""

# ---- special tokens: ids 0 and 1 are rows of the vocabulary ------------------------
SPECIAL_DOCS = """(SELECT doc_id, regexp_replace(replace(text, chr(10), '<|endoftext|>') || '<unk>', '(<\\|endoftext\\|>|<unk>)', ' \\1 ', 'g') AS text FROM documents)"""
SPECIAL_VOCAB = f"""(SELECT token, count, CASE token WHEN '<|endoftext|>' THEN 0 WHEN '<unk>' THEN 1 ELSE 1 + row_number() OVER (ORDER BY token IN ('<|endoftext|>', '<unk>'), count DESC, token) END AS token_id
FROM (SELECT token, count(*) AS count FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS token FROM {SPECIAL_DOCS} d) t WHERE token <> '' GROUP BY token))"""
SQL["special_vocab"] = f"SELECT token, count, token_id FROM {SPECIAL_VOCAB} v"
SQL["special_token_ids"] = f"SELECT doc_id, ids FROM {ids_sql(SPECIAL_DOCS + ' x1', 'doc_id', SPECIAL_VOCAB)} i"
SQL["special_render"] = f"""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> ''), ' ') AS text FROM {SPECIAL_DOCS} d"""

# ---- training batches: every slot's length is a figure of the batch -----------------
_I = "[]::INTEGER[]"


def batch_sql(shifted: bool) -> str:
    cut = 1 if shifted else 0
    masks = f"""list_resize(list_transform(p, lambda x: 1), mp, 0) || list_resize({_I}, {C.SOFT_LEN} + mf // {C.STACK_K} + {len(C.ASSISTANT_IDS)}, 1)
   || list_slice(list_resize(list_resize({_I}, len(r) + 1, 1), mr + 1, 0), 1, mr + 1 - {cut})"""
    start = f"(mp + {C.SOFT_LEN} + mf // {C.STACK_K} + {len(C.ASSISTANT_IDS)})"
    target = f"list_slice(list_resize(r || [0], mr + 1, -100), 1 + {cut}, mr + 1)"
    rest = "" if shifted else f"""
  list_resize(f, mf, 0::FLOAT) AS audio_features, list_resize(list_transform(f, lambda x: 1), mf, 0) AS audio_masks,
  list_resize(p, mp, 0) AS input_ids, list_resize(list_transform(p, lambda x: 1), mp, 0) AS input_masks,
  {list(C.ASSISTANT_IDS)}::INTEGER[] AS assistant_token_ids, {[1] * len(C.ASSISTANT_IDS)}::INTEGER[] AS assistant_token_mask,
  list_resize(r || [0], mr + 1, 0) AS output_ids, list_resize(list_resize({_I}, len(r) + 1, 1), mr + 1, 0) AS output_masks,"""
    return f"""SELECT conv_id, turn, batch_id,{rest}
  {masks} AS attention_mask, list_resize({_I}, {start}, -100) || {target} AS labels,
  [0, mp, mp + {C.SOFT_LEN}, mp + {C.SOFT_LEN} + mf // {C.STACK_K}, {start}, {start} + mr + 1 - {cut}]::INTEGER[] AS offsets
FROM (SELECT *, max(len(p)) OVER b AS mp, max(len(r)) OVER b AS mr, max(len(f)) OVER b AS mf FROM (
  SELECT conv_id, turn, list_slice(prompt_ids, 1, {C.PROMPT_MAX}) AS p, list_slice(reply_ids, 1, {C.LABEL_MAX}) AS r,
    list_slice(embedding, 1, {C.CLIP_LEAST} + (conv_id * 7 + turn) % 49) AS f,
    (row_number() OVER (ORDER BY conv_id, turn) - 1) // {C.COLLATE_BATCH} AS batch_id FROM {PAIRS} p JOIN embeddings e ON e.vec_id = conv_id) a
  WINDOW b AS (PARTITION BY batch_id)) m"""


SQL["train_batch"] = batch_sql(shifted=False)
SQL["train_batch_shifted"] = batch_sql(shifted=True)

# ---- frames and samples ------------------------------------------------------------
SQL["segment"] = f"""SELECT doc_id, CAST(i AS INTEGER) AS seg_no, substr(text, CAST(i * {C.CHUNK_CHARS} + 1 AS BIGINT), {C.CHUNK_CHARS}) AS chunk
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {C.CHUNK_CHARS}.0) AS BIGINT))) AS i FROM documents) s"""
SQL["segment_array"] = f"""SELECT vec_id, CAST(i AS INTEGER) AS seg_no, list_slice(embedding, i * {C.CHUNK_SAMPLES} + 1, i * {C.CHUNK_SAMPLES} + {C.CHUNK_SAMPLES}) AS chunk
FROM (SELECT vec_id, embedding, unnest(range(CAST(ceil(len(embedding) / {C.CHUNK_SAMPLES}.0) AS BIGINT))) AS i FROM embeddings) s"""
SQL["segment_rejoin"] = f"""SELECT doc_id, string_agg(chunk, ' ' ORDER BY i) AS text FROM (
  SELECT doc_id, i, substr(text, CAST(i * {C.CHUNK_CHARS} + 1 AS BIGINT), {C.CHUNK_CHARS}) AS chunk
  FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {C.CHUNK_CHARS}.0) AS BIGINT))) AS i FROM documents) s) c
GROUP BY doc_id UNION ALL SELECT doc_id, '' AS text FROM documents WHERE coalesce(text, '') = ''"""
SQL["frame_stack"] = f"""SELECT label, frame // {C.STACK_K} AS group_no, flatten(list(embedding ORDER BY frame)) AS stacked
FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) f
GROUP BY label, frame // {C.STACK_K} HAVING count(*) = {C.STACK_K}"""
SQL["chunk_generate"] = SQL["segment_rejoin"]
USER_FRAMES = """(SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"""
SQL["mask_downsample"] = f"SELECT user_id, frame // {C.STACK_K} AS group_no, max(mask) AS mask FROM {USER_FRAMES} f GROUP BY user_id, frame // {C.STACK_K}"
SQL["mask_stride"] = f"SELECT user_id, event_id, frame, mask FROM {USER_FRAMES} f WHERE frame % {C.STACK_K} = 0"
SQL["downmix"] = """SELECT vec_id, list_transform(range(len(embedding) // 2),
  lambda i: (CAST(embedding[2 * i + 1] AS DOUBLE) + CAST(embedding[2 * i + 2] AS DOUBLE)) / 2) AS mono FROM embeddings"""
_STEP = f"(CAST({C.CLIP_SR} AS DOUBLE) / CAST({C.TARGET_SR} AS DOUBLE))"
_T = f"(CAST(j AS DOUBLE) * {_STEP})"
_I0 = f"CAST(floor({_T}) AS BIGINT)"
_FR = f"({_T} - CAST({_I0} AS DOUBLE))"
def resample_sql(col: str, source: str) -> str:
    """G2 linear resampling of list ``col`` from CLIP_SR to TARGET_SR."""
    return f"""SELECT vec_id, list_transform(
  range(greatest(CAST(ceil(len({col}) * CAST({C.TARGET_SR} AS DOUBLE) / CAST({C.CLIP_SR} AS DOUBLE)) AS BIGINT), 1)),
  lambda j: CAST({col}[{_I0} + 1] AS DOUBLE) * (CAST(1 AS DOUBLE) - {_FR})
          + CAST({col}[least({_I0} + 1, len({col}) - 1) + 1] AS DOUBLE) * {_FR}) AS samples FROM {source}"""


SQL["resample_linear"] = resample_sql("embedding", "embeddings")
SQL["pad_fixed"] = f"""SELECT vec_id, list_resize(CAST(list_slice(embedding, 1, {C.FIXED_LEN}) AS DOUBLE[]), {C.FIXED_LEN}, 0.0::DOUBLE) AS features,
  list_resize(list_transform(list_slice(embedding, 1, {C.FIXED_LEN}), lambda x: 1), {C.FIXED_LEN}, 0) AS feature_mask FROM embeddings"""


def _span(m: int, part: str) -> str:
    h = f"md5('{C.AUG_SEED}:' || CAST(vec_id AS VARCHAR) || ':{m}')"
    if part == "start":
        return f"(('0x' || substr({h}, 1, 8))::BIGINT % greatest(len(embedding), 1))"
    return f"(('0x' || substr({h}, 9, 8))::BIGINT % {C.AUG_WIDTH + 1})"


_IN = " OR ".join(f"(i - 1 >= {_span(m, 'start')} AND i - 1 < {_span(m, 'start')} + {_span(m, 'width')})"
                  for m in range(C.AUG_MASKS))
SQL["mask_augment"] = f"""SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN {_IN} THEN 0.0::DOUBLE ELSE CAST(x AS DOUBLE) END) AS features FROM embeddings"""

def _h(kind: str, m: int, lo: int) -> str:
    return f"(('0x' || substr(md5('{C.SPEC_SEED}:{kind}:' || CAST(label AS VARCHAR) || ':{m}'), {lo}, 8))::BIGINT)"


_MAXT = "least(50, CAST(floor(T * 0.5) AS BIGINT))"
_TW = {m: f"(CASE WHEN {_MAXT} > 0 THEN {_h('t', m, 1)} % {_MAXT} ELSE 0 END)" for m in range(10)}
_TS = {m: f"({_h('t', m, 9)} % (T - {_TW[m]} + 1))" for m in range(10)}
_FW = {m: f"({_h('f', m, 1)} % 15)" for m in range(2)}
_FS = {m: f"({_h('f', m, 9)} % (len(embedding) - {_FW[m]} + 1))" for m in range(2)}
_IN_T = " OR ".join(f"(frame >= {_TS[m]} AND frame < {_TS[m]} + {_TW[m]})" for m in range(10))
_IN_F = " OR ".join(f"(i - 1 >= {_FS[m]} AND i - 1 < {_FS[m]} + {_FW[m]})" for m in range(2))
SQL["spec_augment"] = f"""SELECT label, frame,
  CASE WHEN {_IN_T} THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
       ELSE list_transform(embedding, lambda x, i: CASE WHEN {_IN_F} THEN 0.0::DOUBLE ELSE CAST(x AS DOUBLE) END) END AS features
FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
             count(*) OVER (PARTITION BY label) AS T FROM embeddings) f"""

# ---- metrics -----------------------------------------------------------------------
SQL["pair_eval"] = """SELECT r.conv_id, r.turn, r.text AS reference, h.text AS hypothesis
FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1"""
# DuckDB's distance counts bytes; each letter outside ASCII that the conversations hold becomes
# one control character first, which keeps the distance and makes it one of characters.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CONTROLS = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])
_ASCII = f"translate({{}}, '{_LETTERS}', {_CONTROLS})"
_SCORED = f"""(SELECT r.conv_id, r.turn, length(r.text) AS n, levenshtein({_ASCII.format('r.text')}, {_ASCII.format('h.text')}) AS d,
  row_number() OVER (ORDER BY r.conv_id, r.turn) - 1 AS pos
FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1)"""
SQL["cer_macro"] = f"SELECT round(avg(d / n), 9) AS cer_macro, count(*) AS n_pairs FROM {_SCORED} s WHERE n > 0"
SQL["cer_micro"] = f"SELECT round(sum(d) / sum(n), 9) AS cer_micro, count(*) AS n_pairs FROM {_SCORED} s WHERE n > 0"
SQL["cer_by_batch"] = f"""SELECT 'cer' AS name, round(avg(m), 9) AS mean_of_batch_means, round(sum(s) / sum(k), 9) AS weighted_mean, count(*) AS n_batches
FROM (SELECT pos // {C.COLLATE_BATCH} AS b, avg(d / n) AS m, sum(d / n) AS s, count(*) AS k FROM {_SCORED} s WHERE n > 0 GROUP BY 1) a"""
# One row of the distance table at a time: what a cell takes from its left neighbour is a running minimum.
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_WORD_SCORED = f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY r.conv_id, r.turn) - 1 AS pos, {_WORDS.format('r.text')} AS a, {_WORDS.format('h.text')} AS b
  FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1),
c AS (SELECT 0 AS i, pos, unnest(range(len(b) + 1)) AS j, unnest(range(len(b) + 1)) AS d FROM p UNION ALL
  SELECT i + 1, pos, j, j + min(t - j) OVER (PARTITION BY pos ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT i, c.pos AS pos, j, least(d + 1, lag(d) OVER (PARTITION BY c.pos ORDER BY j) + (a[i + 1] <> b[j])::int) AS t FROM c JOIN p ON c.pos = p.pos WHERE i < len(a)) x),
s AS (SELECT p.pos AS pos, len(a) AS n, d FROM p JOIN c ON c.pos = p.pos AND i = len(a) AND j = len(b))"""
SQL["wer_micro"] = f"{_WORD_SCORED} SELECT sum(d) / sum(n) AS wer_micro, count(*) AS n_pairs FROM s WHERE n > 0"
SQL["wer_by_batch"] = f"""{_WORD_SCORED} SELECT 'wer' AS name, round(avg(m), 9) AS mean_of_batch_means, round(sum(s) / sum(k), 9) AS weighted_mean, count(*) AS n_batches
FROM (SELECT pos // {C.COLLATE_BATCH} AS b, avg(d / n) AS m, sum(d / n) AS s, count(*) AS k FROM s WHERE n > 0 GROUP BY 1) a"""
SQL["metric_rollup"] = f"""SELECT name, round(avg(m), 9) AS mean_of_batch_means, round(sum(s) / sum(n), 9) AS weighted_mean,
  count(*) AS n_batches FROM (
  SELECT event_type AS name, event_id // {C.METRIC_BATCH} AS batch, avg(value) AS m, count(*) AS n, sum(value) AS s
  FROM events GROUP BY 1, 2) b GROUP BY name"""
SQL["topk_metric"] = f"""SELECT event_type, event_id, value, rank FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events) r
WHERE rank <= {C.TOP_K}"""

# ---- maps and JSON ---------------------------------------------------------------------
SQL["map_drop_prefix"] = """SELECT event_id,
  ['projector.proj.0.weight', 'projector.proj.2.bias', 'projector.projector.scale', 'soft_prompt_embeddings.embeddings'] AS keys,
  [value, value * 2, value + 1, value / 2] AS vals FROM events"""
SQL["map_strip_prefix"] = """SELECT event_id, ['proj.0.weight', 'proj.2.bias', 'scale'] AS keys, [value, value * 2, value + 1] AS vals FROM events"""
SQL["map_known_keys"] = """SELECT event_id, ['extra', 'proj.0.weight', 'proj.2.bias', 'scale'] AS keys,
  [0.0::DOUBLE, value, value * 2, value + 1] AS vals FROM events"""
SQL["json_props"] = """SELECT event_id, props->>'$.k' AS k,
  CAST(to_json({'event_id': event_id, 'k': TRY_CAST(props->>'$.k' AS INTEGER)}) AS VARCHAR) AS record FROM events"""
SQL["schema_enforce"] = """SELECT event_id, TRY_CAST(props->>'$.k' AS INTEGER) AS k,
  TRY_CAST(props->>'$.k' AS INTEGER) IS NOT NULL AS valid,
  CASE WHEN TRY_CAST(props->>'$.k' AS INTEGER) IS NOT NULL THEN '' WHEN props IS NULL OR NOT json_valid(props) THEN 'malformed' ELSE 'missing: k' END AS problem FROM events"""

# ---- prompts and small string functions ---------------------------------------------
NL = "chr(10)"
SQL["prompt_header"] = f"""SELECT conv_id, turn, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || {strip_sql('text')}
  || {NL} || {NL} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {NL} || {NL} AS prompt
FROM conversations WHERE role = 'user'"""
SQL["prompt_im"] = f"""SELECT conv_id, turn, '<|im_start|>system' || {NL} || {strip_sql('text')} || {NL} || '<|im_end|>' || {NL}
  || '<|im_start|>user' || {NL} || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS prompt
FROM conversations WHERE role = 'user'"""
SQL["prompt_think"] = f"""SELECT conv_id, turn, '<|im_start|>system' || {NL} || text || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL}
  || '音声認識ください' || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} AS prompt
FROM conversations WHERE role = 'user'"""
SQL["render_chat"] = f"""SELECT conv_id, turn // 64 AS piece_no,
  string_agg('<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}, '' ORDER BY turn) AS chat
FROM conversations GROUP BY conv_id, turn // 64"""
SQL["render_target"] = "SELECT conv_id, turn, text || '<|endoftext|>' AS target FROM conversations WHERE role = 'assistant'"
SQL["shard_id_parse"] = f"""SELECT doc_id, name, CASE WHEN starts_with(name, 'shard_') THEN TRY_CAST(split_part(name, '_', 2) AS INTEGER) END AS shard_id
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'tmp_' || CAST(doc_id AS VARCHAR) ELSE printf('shard_%08d', doc_id // {C.SMALL_BATCH}) END AS name
      FROM documents) n"""
SQL["format_ts"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events"
SQL["shard_union"] = """SELECT 0 AS source_no, item_id AS id, text FROM benchmark UNION ALL
SELECT 1 AS source_no, doc_id AS id, text FROM documents"""



# ---- sinks, shards, resume ---------------------------------------------------------
_PS = f"CAST(pos // {_PER_SHARD} AS INTEGER)"
SQL["shard_manifest"] = f"""SELECT {_PS} AS shard_id, count(*) AS sample_count, '{C.RUN_TS}' AS timestamp
FROM {POS_DOCS} p GROUP BY 1"""
SQL["resume_point"] = f"SELECT count(*) AS processed, CAST(max({_PS}) AS INTEGER) AS last_shard_id FROM {POS_DOCS} p"
_FIRST = -(-C.FIRST_RUN_CAP // C.SMALL_BATCH) * C.SMALL_BATCH
SQL["shard_scan"] = f"""SELECT p.doc_id,
  CAST(CASE WHEN pos < {_FIRST} THEN pos // {_PER_SHARD}
            ELSE ((({_FIRST} - 1) // {_PER_SHARD}) + 1) + (pos - {_FIRST}) // {_PER_SHARD} END AS INTEGER) AS shard_id,
  e.step1_text FROM {POS_DOCS} p JOIN {ENRICHED} e USING (doc_id)"""
SQL["shard_dirs_scan"] = f"SELECT p.doc_id, {_PS} AS shard_id, e.step1_text FROM {POS_DOCS} p JOIN {ENRICHED} e USING (doc_id) WHERE pos // {_PER_SHARD} >= 1"
SQL["numbered_shards"] = f"""SELECT doc_id, text, printf('train-%05d-of-%05d.parquet', pos // {_PER_SHARD},
  (SELECT max(pos) FROM {POS_DOCS} q) // {_PER_SHARD} + 1) AS file_name FROM {POS_DOCS} p JOIN documents d USING (doc_id)"""
SQL["dataset_descriptor"] = f"""SELECT '{{"splits":{{' || string_agg('"' || split || '":{{"num_shards":' || n || '}}', ',' ORDER BY split) || '}}}}' AS dataset_info
FROM (SELECT split, count(DISTINCT shard) AS n FROM (
  SELECT CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split, pos // {_PER_SHARD} AS shard
  FROM {POS_DOCS} p LEFT JOIN labels l USING (doc_id)) a GROUP BY split) b"""
SQL["descriptor_edit"] = f"""SELECT '{{"a key":[1,null,{{"b":"ä"}}],"splits":{{' || string_agg('"' || source || '":{{"name":"' || source || '","num_examples":' || k || ',"num_shards":' || n
  || ',"zz":{{"tags":["' || lang || '","x"]}}}}', ',' ORDER BY source) || '}},"version":{{"major":1}}}}' AS dataset_info
FROM (SELECT source, count(*) AS k, max(lang) AS lang, CASE WHEN source = 'src1' THEN 0 ELSE count(DISTINCT pos // {_PER_SHARD}) END AS n
  FROM {POS_DOCS} p JOIN documents USING (doc_id) GROUP BY source) b"""
SQL["publish_version"] = "SELECT 1 AS version, 'train' AS split, count(*) AS num_rows, 'add labels' AS message FROM labels"
SQL["arrow_scan"] = "SELECT doc_id, lang, source, n_chars, text FROM documents"
SQL["arrow_stream_scan"] = SQL["arrow_scan"]
SQL["arrow_file_order"] = f"SELECT doc_id, text, pos FROM {POS_DOCS} p JOIN documents USING (doc_id)"
SQL["audio_scan"] = f"""SELECT vec_id, {C.WAV_SR} AS sampling_rate, 1 AS channels,
  list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, floor(CAST(x AS DOUBLE) * 32767 + 0.5))) / 32768.0 AS FLOAT)) AS samples
FROM embeddings"""

_Q = "CAST(CAST(greatest(-32768, least(32767, floor(CAST(x AS DOUBLE) * 32767 + 0.5))) / 32768.0 AS FLOAT) AS DOUBLE)"
_MONO = f"""(SELECT vec_id, list_transform(range(len(q) // 2), lambda i: (q[2 * i + 1] + q[2 * i + 2]) / 2) AS mono
  FROM (SELECT vec_id, list_transform(embedding, lambda x: {_Q}) AS q FROM embeddings) a)"""
SQL["audio_prepare"] = resample_sql("mono", f"{_MONO} m")

# ---- streams -------------------------------------------------------------------------
SQL["stream_scan"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SQL["stream_enrich"] = f"SELECT doc_id, original_text, step1_text FROM {ENRICHED} e"
SQL["stream_rate"] = """SELECT window_start, window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT event_type, value, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end FROM (
    SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (k * 30) MINUTE AS ws
    FROM events, range(2) r(k)) a) b
GROUP BY window_start, window_end, event_type"""
_W = C.RATE_WINDOW_US
SQL["rate_audit"] = f"""SELECT e.event_id, e.user_id, count(p.event_id) AS prior_requests,
  count(p.event_id) >= {C.RATE_MAX} AS at_limit,
  CASE WHEN count(p.event_id) >= {C.RATE_MAX} THEN min(epoch_us(p.ts)) + {_W} - epoch_us(e.ts) ELSE 0 END AS wait_us
FROM events e LEFT JOIN events p ON p.user_id = e.user_id
  AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id))
  AND epoch_us(e.ts) - epoch_us(p.ts) < {_W}
GROUP BY e.event_id, e.user_id, e.ts"""
SQL["stream_rate_audit"] = SQL["rate_audit"]
SQL["collate_hook"] = f"""SELECT batch_id, count(*) AS n_rows, max(len(ids)) AS max_len, sum(len(ids))::BIGINT AS total_tokens
FROM {DOC_BATCH} b GROUP BY batch_id"""


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in C.REGISTRY}
