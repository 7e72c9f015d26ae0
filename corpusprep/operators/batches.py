"""Training batches of two modalities (M12, M13, T7, T8): padded slots, masks and labels aligned by offsets.

An example is a prompt, a soft slot, speech, an assistant marker and a reply, each padded to the longest of its batch. The
lengths of the slots are figures of the batch: two narrow aggregates (token counts; frame counts) joined by batch,
whose prefix sums say where each slot begins. The arrays themselves are read once and never sorted or gathered: each example stays
a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.operators.tokens import EOS_ID, PAD_ID
from corpusprep.session import materialize

SLOTS = ("prompt", "soft", "speech", "assistant", "reply")


def batch_layout(examples: DataFrame, batch_col: str, prompt: str, reply: str, frames: Column, soft_len: int, assistant_len: int, stack: int,
                 shifted: bool = False) -> DataFrame:
    """One row for each batch: ``longest`` (prompt, frames, output: what to pad to) and ``offsets`` (the first place of each slot, and
    ``total``). ``stack`` frames make one place of speech, a rest makes none; with ``shifted`` the reply slot is one place shorter."""
    m = examples.groupBy(batch_col).agg(F.max(F.size(prompt)).alias("prompt"), F.max(frames).alias("frames"),
                                        (F.max(F.size(reply)) + 1).alias("output"))
    lengths = [F.col("prompt"), F.lit(soft_len), F.floor(F.col("frames") / stack).cast("int"), F.lit(assistant_len),
               F.col("output") - (1 if shifted else 0)]
    starts, at = [], F.lit(0)
    for length in lengths:
        starts.append(at)
        at = at + length
    return m.select(batch_col, F.struct("prompt", "frames", "output").alias("longest"),
                    F.struct(*[c.cast("int").alias(n) for n, c in zip((*SLOTS, "total"), [*starts, at])]).alias("offsets"))


def offset_list(offsets: str = "offsets") -> Column:
    """The offsets in the order of ``SLOTS``, then the total."""
    return F.array(*[F.col(f"{offsets}.{n}") for n in (*SLOTS, "total")])


def train_batch(text: DataFrame, audio: DataFrame, key, batch_col: str = "batch_id", prompt: str = "prompt_ids", reply: str = "reply_ids",
                features: str = "features", assistant_ids=(), soft_len: int = 0, stack: int = 1, shifted: bool = False,
                eos_id: int = EOS_ID, pad_id: int = PAD_ID) -> DataFrame:
    """A row for each example of ``text`` (``key``, batch, prompt and reply ids) that has a clip in ``audio`` (``key``, frames):

    - audio_features, audio_masks: frames padded with 0 to the batch's longest clip;
    - input_ids, input_masks: the prompt, padded on the right; assistant_token_ids, assistant_token_mask: the same for all;
    - output_ids, output_masks: reply, end token, padding;
    - attention_mask: the masks of all slots one after another; soft and speech places count as real, as in training;
    - labels: as long as the mask, ``IGNORE`` but at the reply's places;
    - offsets: where the slots begin.

    Labels: by default the output ids where their mask is 1 (M13's form). ``shifted`` (M12's form): the reply's inputs are its ids without the
    last, so mask and labels are one shorter, and a place's label is the next id. Padding stays ``IGNORE`` in both.
    Examples without a clip are left out, as are clips without a text; an empty or null id list is an example without prompt or reply (its
    output is the end token); a null clip has no frames."""
    key = [key] if isinstance(key, str) else list(key)
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c)
    clip = F.coalesce(F.col(features), F.slice(F.array(F.lit(0.0)), 1, 0).cast(audio.schema[features].dataType)).alias("__cp_f")
    rows = text.select(*key, batch_col, ids(prompt), ids(reply)).join(audio.select(*key, clip), key)
    rows = materialize(rows, "examples")  # read twice: the sizes, then the rows
    frames = F.size("__cp_f")
    layout = batch_layout(rows, batch_col, prompt, reply, frames, soft_len, len(assistant_ids), stack, shifted)
    d = rows.join(layout, batch_col)
    zero = F.lit(0.0).cast(rows.schema["__cp_f"].dataType.elementType)
    gap = F.col("longest.frames") - frames
    right = F.col("longest.prompt") - F.size(prompt)
    output, output_mask = A.pad_right_eos(F.col(reply), F.col("longest.output") - 1, eos_id, pad_id)
    d = d.withColumns({"audio_features": F.concat("__cp_f", F.array_repeat(zero, gap)), "audio_masks": F.concat(A.ones_mask(frames), F.array_repeat(F.lit(0), gap)),
                       "input_ids": F.concat(prompt, F.array_repeat(F.lit(pad_id), right)), "input_masks": F.concat(A.ones_mask(F.size(prompt)), F.array_repeat(F.lit(0), right)),
                       "assistant_token_ids": A.constant_ids(list(assistant_ids)), "assistant_token_mask": A.ones_mask(len(assistant_ids)),
                       "output_ids": output, "output_masks": output_mask})
    speech = F.col("offsets.assistant") - F.col("offsets.speech")
    fed = F.slice("output_masks", 1, F.col("longest.output") - 1) if shifted else F.col("output_masks")
    mask = A.assemble([F.col("input_masks"), A.ones_mask(soft_len), F.array_repeat(F.lit(1), speech), F.col("assistant_token_mask"), fed])
    if shifted:
        target, real = F.slice("output_ids", 2, F.col("longest.output") - 1), F.slice("output_masks", 2, F.col("longest.output") - 1)
    else:
        target, real = F.col("output_ids"), F.col("output_masks")
    return d.select(*key, batch_col, "audio_features", "audio_masks", "input_ids", "input_masks", "assistant_token_ids", "assistant_token_mask",
                    "output_ids", "output_masks", mask.alias("attention_mask"), A.label_ids(F.col("offsets.reply"), target, real).alias("labels"), "offsets")
