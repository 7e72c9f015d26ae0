"""Quality rules, line first: every line is judged alone, failing lines are
removed, and a document that loses too much of its text is rejected.

DataFrame expressions only; each row is judged by itself, so there is no shuffle.

Defined results: a null text counts as an empty text (no words, rejected by
``n_words < 50``); an empty table gives an empty table; repeated rows each get
their own equal row; other columns pass through, and a column of the input that
has the name of a result column is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WS = r"[\\x20\\x09-\\x0D]+"          # inside a SQL string literal
#: Phrases of licence, consent and site-chrome lines.
BOILERPLATE = (r"(?i)all rights reserved|licen[sc]ed under|released under the|general public license"
               r"|terms of (use|service)|privacy policy|cookie|javascript|click here|subscribe"
               r"|sign in|log in|copyright (©|\\(c\\))|lorem ipsum")


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_pct: the base rules. symbol_pct: most symbols in
    100 characters of a line. separators: this many column separators make a
    line navigation. boiler_chars: only lines of at most this length can be
    boilerplate. bare_words: a line of at least so many words needs some
    punctuation. max_lost_pct: most characters in 100 that a kept document may
    lose to its failing lines."""

    min_words: int = 50
    max_repeat_pct: int = 50
    symbol_pct: int = 8
    separators: int = 3
    boiler_chars: int = 200
    bare_words: int = 5
    max_lost_pct: int = 40


def line_fails(x: str, r: Rules) -> str:
    """SQL for the verdict on line ``x``; blank lines never fail."""
    return (
        f"(length({x}) - length(translate({x}, '#*$%&|<>', ''))) * 100 > {r.symbol_pct} * length({x})"
        f" or length({x}) - length(translate({x}, '|»›•', '')) >= {r.separators}"
        f" or (length({x}) <= {r.boiler_chars} and {x} rlike '{BOILERPLATE}')"
        f" or (length({x}) - length(translate({x}, ' ', '')) >= {r.bare_words - 1}"
        f"     and not {x} rlike '\\\\p{{Po}}')")


def judge(df: DataFrame, text_col: str = "text", rules: Rules = Rules(), clean_col: str = "clean_text") -> DataFrame:
    """``df`` with the counts of the base rules, ``base_failed``, ``kept``, the
    line counts ``n_lines`` and ``n_failed_lines`` and the text without its
    failing lines in ``clean_col``."""
    r = rules
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "n_lines", "n_failed_lines", clean_col]
    row = [c for c in df.columns if c.lower() not in own]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("r", "t", F.expr(f"array_remove(split(t, '{WS}'), '')").alias("w"), F.expr("split(t, '\\n')").alias("l"))
    d = d.select("r", "t", "w", "l", F.expr("size(w)").alias("n"), F.expr("cast(ceil(log2(size(w) + 2)) as int)").alias("b"),
                 F.expr(r"filter(l, x -> length(translate(x, ' \t\n\u000b\u000c\r', '')) > 0)").alias("full"))
    # One long for each three-word window: the hash above, its position in the low b bits.
    # Sorting brings equal windows together; neighbours are compared word by word.
    d = d.withColumn("s", F.expr("""sort_array(case when n < 3 then cast(array() as array<bigint>)
        else transform(sequence(0, n - 3), i -> shiftleft(shiftrightunsigned(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b), b)
                                                | cast(i as bigint)) end)"""))
    d = d.withColumn("mask", F.expr("shiftleft(1L, b) - 1"))
    same = """(shiftrightunsigned(get(s, {k}), b) = shiftrightunsigned(x, b)
        and get(w, cast(get(s, {k}) & mask as int)) = get(w, cast(x & mask as int))
        and get(w, cast(get(s, {k}) & mask as int) + 1) = get(w, cast(x & mask as int) + 1)
        and get(w, cast(get(s, {k}) & mask as int) + 2) = get(w, cast(x & mask as int) + 2))"""
    d = d.withColumn("p", F.expr(f"""sort_array(transform(filter(s, (x, k) ->
        (k > 0 and {same.format(k='k - 1')}) or (k < size(s) - 1 and {same.format(k='k + 1')})), x -> x & mask))"""))
    d = d.withColumn("kept_lines", F.expr(f"filter(l, x -> not ({line_fails('x', r)}))"))
    out = d.select(
        "r", F.expr("cast(n as bigint)").alias("n_words"),
        F.expr(r"cast(length(translate(t, ' \t\n\u000b\u000c\r', '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(full) - size(array_distinct(full)) as bigint)").alias("n_dup_lines"),
        F.expr("""aggregate(p, named_struct('n', 0L, 'last', -3L),
            (a, x) -> named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)""").alias("n_repeat_words"),
        F.expr("cast(size(l) as bigint)").alias("n_lines"), F.expr("cast(size(l) - size(kept_lines) as bigint)").alias("n_failed_lines"),
        F.expr("array_join(kept_lines, '\\n')").alias("c"), F.expr("length(t)").alias("n0"))
    failed = (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_pct * F.col("n_words"))
    # the line breaks that went with the failing lines count as lost, too
    lost = (F.col("n0") - F.length("c")) * 100 > r.max_lost_pct * F.col("n0")
    # A filter on ``kept`` must not be pushed below the steps above: it would take their arrays into
    # lambdas and compute them again for each element. Conditions on an id of the run stay above it.
    here = F.monotonically_increasing_id() >= 0
    return out.select("r.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~lost & here).alias("kept"),
                      "n_lines", "n_failed_lines", F.col("c").alias(clean_col))
