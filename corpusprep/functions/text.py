"""String functions F1-F11 as Catalyst expressions.

Fixed values that must equal the reference's behaviour are collected in the
block below; everything else is built from them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must stay equal to the reference's) ---------------------
# F1: characters kept besides letters, digits and underscore.
KEEP_PUNCT = "。、？！"
# characters stripped from both ends of a transcript.
TRANSCRIPT_STRIP = "「」『』（）〔〕［］｛｝｟｠〈〉《》【】〖〗〘〙〚〛"
# substrings deleted after the strip, in this order.
TRANSCRIPT_DELETE = ["」。", "』。", "♥", "�"]
# span markers (the brackets are gone after F1 cleaning).
SPAN_START = "startofspeech"
SPAN_END = "endofspeech"
# instruction prefixed to the text part.
REPLY_INSTRUCTION = "会話調で、できるだけ短く1、2文で回答してください。"
# error sentinel.
ERROR_PREFIX = "ERROR: "
# timestamp text format.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------

# Python's str.isspace() set written as a class that both the JVM and RE2 read.
UNICODE_SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# F1 as one negated class: Python's \w is letters + numbers + '_'; whitespace
# is removed by the second step anyway and kana/kanji are letters.
CORPUS_DROP = r"[^\p{L}\p{N}_" + KEEP_PUNCT + r"]"
SPAN_PATTERN = "(?s)" + SPAN_START + "(.*?)" + SPAN_END


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_corpus(text) -> Column:
    """keep word characters and 。、？！, drop everything else incl. spaces."""
    return F.regexp_replace(_c(text), CORPUS_DROP, "")


def unicode_strip(text) -> Column:
    """``str.strip()`` with Python's Unicode whitespace set."""
    return F.regexp_replace(
        _c(text), r"\A" + UNICODE_SPACE + "+|" + UNICODE_SPACE + r"+\z", "")


def strip_chars(text, chars: str) -> Column:
    """``str.strip(chars)``: remove any of ``chars`` from both ends."""
    cls = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars) + "]"
    return F.regexp_replace(_c(text), r"\A" + cls + "+|" + cls + r"+\z", "")


def strip_brackets(text) -> Column:
    """F2 without NFKC: bracket strip then the four deletions."""
    out = strip_chars(text, TRANSCRIPT_STRIP)
    for s in TRANSCRIPT_DELETE:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text) -> Column:
    """NFKC normalisation; Python only for rows that are not plain ASCII."""
    c = _c(text)
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfkc(c))


def clean_transcript(text) -> Column:
    """NFKC, strip bracket characters at both ends, delete four marks."""
    return strip_brackets(nfkc(text))


def span_extract(text) -> Column:
    """first lazily matched marked span; '' when there is none."""
    return F.regexp_extract(_c(text), SPAN_PATTERN, 1)


def span_remove(text, span) -> Column:
    """remove every copy of the exact marked span (markers included)."""
    return F.replace(_c(text), F.concat(F.lit(SPAN_START), _c(span), F.lit(SPAN_END)), F.lit(""))


def span_split_columns(text) -> tuple[Column, Column]:
    """(voice_part, text_part), both Unicode-stripped."""
    voice = span_extract(text)
    rest = span_remove(text, voice)
    return unicode_strip(voice), unicode_strip(F.concat(F.lit(REPLY_INSTRUCTION), rest))


def zero_pad_name(prefix: str, n, width: int, suffix: str = "") -> Column:
    """``f"{prefix}{n:0{width}d}{suffix}"``."""
    return F.format_string(f"{prefix}%0{width}d{suffix}", _c(n))


def numbered_file(i, n, split: str = "train") -> Column:
    """``train-00003-of-00012.parquet``."""
    return F.format_string(f"{split}-%05d-of-%05d.parquet", _c(i), _c(n))


def parse_shard_id(name, prefix: str = "shard_") -> Column:
    """F8: ``int(name.split('_')[1])`` for names starting with ``shard_``."""
    c = _c(name)
    return F.when(c.startswith(prefix), F.split_part(c, F.lit("_"), F.lit(2)).try_cast("int"))


def format_ts(ts) -> Column:
    """``%Y-%m-%d %H:%M:%S``."""
    return F.date_format(_c(ts), TS_FORMAT)


def append_eos(text, eos: str) -> Column:
    """F10."""
    return F.concat(_c(text), F.lit(eos))


def error_text(msg) -> Column:
    """F11."""
    return F.concat(F.lit(ERROR_PREFIX), _c(msg))


def is_error(text) -> Column:
    """The sentinel test (clean text never holds ': ')."""
    return _c(text).startswith(ERROR_PREFIX)


def set_apart(text, specials) -> Column:
    """``text`` with a space before and after each occurrence of the strings ``specials``, so that they are words of their own;
    where several begin, the longest counts."""
    any_of = "|".join(r"\Q" + s + r"\E" for s in sorted(specials, key=len, reverse=True))
    return F.regexp_replace(_c(text), f"({any_of})", " $1 ")


def split_words(text, pattern: str = r"[ \n]+") -> Column:
    """Tokens between separators (``pattern`` is a repeated separator class);
    leading/trailing separators are cut first, so no empty tokens appear and
    no per-element lambda runs."""
    core = F.regexp_replace(_c(text), r"\A(?:" + pattern + r")|(?:" + pattern + r")\z", "")
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, pattern))
