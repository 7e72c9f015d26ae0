"""Prompt rendering F12-F16 as string concatenation (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.text import unicode_strip

# ---- fixed values (chat markup the models were trained with) --------------
HEADER_USER_OPEN = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>"
HEADER_ASSISTANT = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
HEADER_SYSTEM_OPEN = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>"
HEADER_USER_TURN = "<|eot_id|><|start_header_id|>user<|end_header_id|>"
HEADER_ASSISTANT_TURN = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
IM_SYSTEM_OPEN = "<|im_start|>system\n"
IM_USER_AFTER_SYSTEM = "\n<|im_end|>\n<|im_start|>user\n"
IM_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n"
THINK_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
RECOGNISE_INSTRUCTION = "音声認識ください"
EOS_TEXT = "<|endoftext|>"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prompt_header(prompt) -> Column:
    """user header, stripped prompt, blank line; then the assistant header."""
    return F.concat(F.lit(HEADER_USER_OPEN), unicode_strip(_c(prompt)), F.lit("\n\n"),
                    F.lit(HEADER_ASSISTANT))


def prompt_im(system_prompt) -> Column:
    """im-tag system block, open user turn; then the assistant opener."""
    return F.concat(F.lit(IM_SYSTEM_OPEN), unicode_strip(_c(system_prompt)),
                    F.lit(IM_USER_AFTER_SYSTEM), F.lit(IM_ASSISTANT))


def prompt_think(content, instruction: str = RECOGNISE_INSTRUCTION) -> Column:
    """im-tag system opener, content, user instruction, empty think block."""
    return F.concat(F.lit(IM_SYSTEM_OPEN), _c(content),
                    F.lit("<|im_end|>\n<|im_start|>user\n" + instruction), F.lit(THINK_ASSISTANT))


def sft_prompt(system, user) -> Column:
    """F16: step-2 header form, system = text part, user = voice part (no newlines)."""
    return F.concat(F.lit(HEADER_SYSTEM_OPEN), _c(system), F.lit(HEADER_USER_TURN), _c(user),
                    F.lit(HEADER_ASSISTANT_TURN))


def im_block(role, text) -> Column:
    """One im-tag turn: ``<|im_start|>{role}\\n{text}<|im_end|>\\n``."""
    return F.concat(F.lit("<|im_start|>"), _c(role), F.lit("\n"), _c(text), F.lit("<|im_end|>\n"))
