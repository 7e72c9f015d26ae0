"""Edit distances F17 (characters) and F18 (words), JVM-side but for long pairs.

Pairs of over ``CELLS`` cells of the distance table (two transcripts of some 4,000 characters) go to a bit-parallel form in Arrow
batches instead: it holds a column's differences as bits of long integers and works on a whole block of ``BLOCK`` cells at once.

F18 re-uses Spark's code-point Levenshtein: every distinct word of a pair is
mapped to one stand-in code point, so a word edit becomes a character edit.
The encoding is a hash factorisation per pair (linear in the words), done
in one Arrow batch call; the quadratic distance itself stays in the JVM.
Stand-ins start at U+4E00 and continue above U+FFFF past the surrogates, so a
pair may hold over a million distinct words; there is no cap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 24
BLOCK = 1 << 14   # bounds the bit masks of a block: one of BLOCK bits for each different character in it
_BMP_FIRST = 0x4E00
_BMP_COUNT = 0xD800 - 0x4E00  # stand-ins before the surrogate block


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance over code points. The longer text's blocks are the rows, the other's characters the columns; a block
    takes the horizontal differences above it and leaves those below it."""
    if len(a) < len(b):
        a, b = b, a
    rows = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    columns = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4").tolist()
    across = [1] * len(columns)
    for at in range(0, len(rows), BLOCK):
        block = rows[at:at + BLOCK]
        size = len(block)
        full, last = (1 << size) - 1, size - 1
        order = np.argsort(block, kind="stable")
        codes, starts = np.unique(block[order], return_index=True)
        masks = {}
        for code, places in zip(codes.tolist(), np.split(order, starts[1:])):
            bits = np.zeros(size, np.uint8)
            bits[places] = 1
            masks[code] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        up, down = full, 0   # rows where the distance grows by one downwards, and where it falls
        for j, c in enumerate(columns):
            equal, above = masks.get(c, 0), across[j]
            level = equal | down
            if above < 0:
                equal |= 1
            diagonal = (((equal & up) + up) ^ up) | equal
            right, left = down | (full & ~(diagonal | up)), up & diagonal
            across[j] = (right >> last & 1) - (left >> last & 1)
            right, left = (right << 1 & full) | (above > 0), (left << 1 & full) | (above < 0)
            up, down = left | (full & ~(level | right)), right & level
    return len(rows) + sum(across)


@F.pandas_udf(T.IntegerType())
def _long_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else bit_distance(a, b) for a, b in zip(ref, hyp)], dtype="Int32")


def char_distance(ref, hyp) -> Column:
    """Levenshtein distance over code points; null if one side is."""
    r, h = _c(ref), _c(hyp)
    long = F.length(r).cast("long") * F.length(h) > CELLS
    # short pairs go to Python as nulls
    return F.when(long, _long_distance(F.when(long, r), F.when(long, h))).otherwise(F.levenshtein(r, h))


def words(text, pattern: str = r"\s+") -> Column:
    """Whitespace words; an empty or blank text has no words."""
    from corpusprep.functions.text import split_words
    return split_words(text, pattern)


_PAIR_TYPE = T.StructType([T.StructField("r", T.StringType()), T.StructField("h", T.StringType())])


def _stand_in_str(codes: np.ndarray) -> str:
    cp = np.where(codes < _BMP_COUNT, codes + _BMP_FIRST, codes - _BMP_COUNT + 0x10000)
    return cp.astype("<u4").tobytes().decode("utf-32-le")


@F.pandas_udf(_PAIR_TYPE)
def _encode_pair(rw: pd.Series, hw: pd.Series) -> pd.DataFrame:
    """Per pair: one hash factorisation of both word lists (O(n)), then each
    word as the stand-in character of its code."""
    out_r, out_h = [], []
    for a, b in zip(rw, hw):
        if a is None or b is None:
            out_r.append(None)
            out_h.append(None)
            continue
        codes, _ = pd.factorize(np.concatenate([np.asarray(a, dtype=object), np.asarray(b, dtype=object)]))
        out_r.append(_stand_in_str(codes[:len(a)]))
        out_h.append(_stand_in_str(codes[len(a):]))
    return pd.DataFrame({"r": out_r, "h": out_h})


def with_word_distance(df: DataFrame, ref, hyp, out: str = "word_edits",
                       pattern: str = r"\s+") -> DataFrame:
    """word-level Levenshtein distance. Words are split in the JVM, each
    pair is encoded to stand-in characters in one Arrow batch call (linear
    in the words), and their distance is that of characters."""
    enc = _encode_pair(words(ref, pattern), words(hyp, pattern))
    d = df.withColumn("__cp_enc", enc)
    return d.withColumn(out, char_distance("__cp_enc.r", "__cp_enc.h")).drop("__cp_enc")
