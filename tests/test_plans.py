"""Plan checks over every registered query.

* no row-at-a-time Python UDF anywhere;
* Arrow-batched Python only where the operator needs it (model call, NFKC,
  broadcast token lookups, WER word encoding, edit distances of long pairs, projector, WAV decoding, the
  Python data source, the collate hook);
* a ``SinglePartition`` exchange only in front of a bounded table: the
  ordered index's per-bucket counts or a keyless (global) aggregate.
"""

from conftest import SF001

from corpusprep.plans.catalog import REGISTRY

PYTHON_NODES = ("ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInArrow", "BatchScan")
PYTHON_BY_DESIGN = {
    "error_split", "clean_transcript", "enrich", "span_split", "sft_prompt", "token_ids", "truncate_inside",
    "truncate_outside", "pad_batch", "pad_left", "label_budget", "detokenise", "embedding_lookup",
    "chat_labels", "target_tokens", "assemble_sequence", "label_mask", "project_vectors", "wer_micro", "cer_macro", "cer_micro", "shard_dirs_scan",
    "arrow_scan", "arrow_file_order", "audio_scan", "audio_prepare", "collate_hook", "chunk_generate", "char_token_ids",
}


def plans(spark):
    for name, fn in REGISTRY.items():
        yield name, fn(spark, SF001)._jdf.queryExecution().executedPlan().toString().splitlines()


def test_plan_shapes(spark):
    problems = []
    for name, lines in plans(spark):
        if any("BatchEvalPython" in line for line in lines):
            problems.append((name, "row-at-a-time Python UDF"))
        if name not in PYTHON_BY_DESIGN and any(p in line for line in lines for p in PYTHON_NODES):
            problems.append((name, "Python in the plan"))
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = lines[i + 1]
                bounded = "keys=[__cp_bucket" in below or "keys=[]" in below or "ObjectHashAggregate(keys=[]" in below
                if not bounded:
                    problems.append((name, below.strip()[:80]))
    assert problems == []
