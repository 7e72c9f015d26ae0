"""Map functions H1-H3 and C5 (state-dict key handling, JSON records)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: key prefixes the checkpoints use -----------------------
FROZEN_PREFIXES = ("speech_encoder", "llm_model")
PROJECTOR_PREFIX = "projector."
SOFT_PROMPT_PREFIX = "soft_prompt_embeddings."
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def drop_prefixes(m, prefixes=FROZEN_PREFIXES) -> Column:
    """H1: drop every key that starts with any of ``prefixes``."""
    def keep(k, v):
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | k.startswith(p)
        return ~cond
    return F.map_filter(_c(m), keep)


def strip_prefix(m, prefix: str = PROJECTOR_PREFIX) -> Column:
    """H2: keep keys starting with ``prefix`` and delete every occurrence of it
    from the key (``str.replace`` semantics, not only the head). When two keys
    become the same, the later entry stays."""
    kept = F.map_filter(_c(m), lambda k, v: k.startswith(prefix))
    new = F.transform(F.map_keys(kept), lambda k: F.replace(k, F.lit(prefix), F.lit("")))
    pairs = F.arrays_zip(new.alias("key"), F.map_values(kept).alias("value"))
    # two keys become the same only rarely: then one fold from the last entry on, which keeps the first of each key that it meets
    none = F.slice(pairs, 1, 0)
    folded = F.reverse(F.aggregate(F.reverse(pairs), none, lambda seen, e: F.when(F.exists(seen, lambda s: s["key"] == e["key"]), seen)
                                   .otherwise(F.concat(seen, F.array(e)))))
    return F.when(F.size(F.array_distinct(new)) == F.size(new), F.map_from_arrays(new, F.map_values(kept))).otherwise(F.map_from_entries(folded))


def update_known(model, pretrained) -> Column:
    """``model.update({k: v for k, v in pretrained if k in model})``."""
    model_c, pre_c = _c(model), _c(pretrained)
    pre_known = F.map_filter(pre_c, lambda k, v: F.array_contains(F.map_keys(model_c), k))
    untouched = F.map_filter(model_c, lambda k, v: ~F.array_contains(F.map_keys(pre_known), k))
    return F.map_concat(untouched, pre_known)


def sorted_keys(m) -> Column:
    return F.array_sort(F.map_keys(_c(m)))


def values_by_sorted_key(m) -> Column:
    c = _c(m)
    return F.transform(F.array_sort(F.map_keys(c)), lambda k: F.element_at(c, k))
