"""Repeated line runs, found by winnowing over line hashes.

Only DataFrame expressions. Lines that hold a word are hashed (trimmed). A gram is the
run of lines that begin within ``gram_words`` words from its first line; its hash is a
candidate fingerprint. In every stretch of gram starts within ``window_words`` words the least
hash is selected, so two equal passages of ``gram_words + window_words`` words or more select
the same fingerprint somewhere, if they are made of whole lines; a passage inside
lines with other text around it is not found. Fingerprints that occur again are joined
with their first occurrence (least id, then position), and each match is extended line by line
to both sides as far as the next fingerprint of a longer match can be; so the deleted
stretches join up over the whole repeated run. Where holders leave the first one's lines, those that go on with
the same lines are matched with the earliest of them. All later repeats are deleted,
the first occurrence stays. A run shorter than ``gram_words`` words is never deleted.

No task holds more than one document or the distinct fingerprints of its share: fingerprints are
reduced to their first occurrence before the join, and that join's one-row side
lets Spark split a fingerprint that a third of all rows share.

Defined results: the text of a null row stays null; empty texts stay empty; rows that are equal
in id and text count as one document and get the same result; ids may be null (they come
first) or repeat; a document whose lines all repeat keeps an empty text; empty in, empty out. All other
columns pass through, result columns of the same name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import materialize

GRAM_WORDS = WINDOW_WORDS = 25
SPACE = " \t\r\x0b\x0c"


def line_table(df: DataFrame, id_col: str, text_col: str, long_line: int = GRAM_WORDS) -> DataFrame:
    """(id, th, pos, md5, words, h, at): the lines with a word; ``th`` tells texts of
    one id apart, ``words`` is at most ``long_line`` (so a long line is a gram by itself
    and has neighbours within reach), ``at`` sums the words before the line."""
    d = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    d = d.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line != ''")
    words = F.least(F.size(F.split("line", r"[\x20\x09-\x0D]+")), F.lit(long_line)).alias("words")
    d = d.select("id", "th", "pos", F.unhex(F.md5("line")).alias("md5"), words)
    d = d.repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    d = d.withColumn("md5", F.lower(F.hex("md5")))
    # 60 bits of it tell lines next to a match apart
    d = d.withColumn("h", F.conv(F.substring("md5", 1, 15), 16, 10).cast("bigint"))
    before = F.sum("words").over(Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("at", F.coalesce(before, F.lit(0)))


def fingerprints(lines: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """(id, th, pos, fp, last, before, after): the selected grams; ``before`` and
    ``after`` are the (h, pos) of the lines around, nearest first."""
    doc = Window.partitionBy("id", "th").orderBy("at")
    gram = doc.rangeBetween(0, gram_words - 1)
    g = (lines.withColumn("gh", F.collect_list("md5").over(gram)).withColumn("gw", F.sum("words").over(gram)).withColumn("last", F.max("pos").over(gram))
         .withColumn("before", F.collect_list(F.struct("h", "pos")).over(doc.rangeBetween(-window_words, -1)))
         # a longer match has a next fingerprint within this reach, or ends in it
         .withColumn("after", F.collect_list(F.struct("h", "pos")).over(doc.rangeBetween(gram_words, 3 * gram_words + window_words))))
    # all 128 bits: grams are held to be equal if these are
    fp = F.unhex(F.md5(F.array_join("gh", " ")))
    g = g.withColumn("fp", F.when(F.col("gw") >= gram_words, fp))
    # a gram is selected if it is the least (ties: the last) of a window that holds it, that
    # is, if the window that begins at some earlier start within reach has it as its least
    least = F.min(F.when(F.col("fp").isNotNull(), F.struct("fp", (-F.col("pos")).alias("neg")))).over(doc.rangeBetween(0, window_words - 1))
    g = g.withColumn("pick", -least["neg"])
    picked = F.array_contains(F.collect_list("pick").over(doc.rangeBetween(1 - window_words, 0)), F.col("pos"))
    return (g.withColumn("picked", picked).where("picked and fp is not null")
            .select("id", "th", "pos", "fp", "last", F.reverse("before").alias("before"), "after"))


def later_reaches(m: DataFrame) -> DataFrame:
    """(id, th, s, e): how far holders of a fingerprint that leave its first holder's lines go on together. Those
    that have the next line in common, and no others, give the hash of each further stretch of lines; a holder's stretch reaches as far
    as an earlier holder has the same one."""
    key = F.struct(F.col("id").isNotNull().alias("some"), "id", "th", "pos")
    x = m.select("id", "th", "pos", "last", "fp", F.inline("sides")).where("size(rest) > 0").withColumn("next", F.expr("rest[0].h"))
    # holders that share a line beyond the first holder's have left it at the same place
    shared = x.groupBy("fp", "side", "next").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    x = x.join(shared, ["fp", "side", "next"]).select("*", F.posexplode("rest").alias("i", "line"))
    x = x.select("id", "th", "pos", "last", "fp", "side", F.col("line.pos").alias("at"),
                 F.unhex(F.md5(F.array_join(F.expr("transform(slice(rest, 1, i + 1), y -> cast(y.h as string))"), " "))).alias("stretch"))
    least = x.groupBy("fp", "side", "stretch").agg(F.min(key).alias("k"), F.count("*").alias("n")).where("n > 1").drop("n")
    x = x.join(least, ["fp", "side", "stretch"]).where(key > F.col("k"))
    return x.select("id", "th", F.least("at", "pos").alias("s"), F.greatest("at", "last").alias("e"))


def repeated_spans(lines: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(id, th, spans): the inclusive line ranges to delete, disjoint, in order."""
    fps = fingerprints(lines, gram_words, window_words)
    fps = materialize(fps, "fingerprints")
    key = F.struct(F.col("id").isNotNull().alias("some"), "id", "th", "pos")
    first = (fps.groupBy("fp").agg(F.min(key).alias("k"), F.count("*").alias("n"),
                                   F.min_by(F.struct(F.col("before.h").alias("before"), F.col("after.h").alias("after")), key).alias("c"))
             .where("n > 1").select("fp", "k", "c", "n"))
    first = materialize(first, "first-fingerprints")
    m = fps.join(first, "fp").where(key > F.col("k"))

    def equal(side: str):
        # equal lines from the gram outwards, up to the first difference
        n = F.least(F.size(side), F.size(F.col("c")[side]))
        same = F.expr(f"coalesce(array_position(transform(sequence(0, greatest(least(size({side}), size(c.{side})), 1) - 1),"
                      f" i -> get({side}, i).h <=> get(c.{side}, i)), false), 0)")
        return F.when(n == 0, F.lit(0)).when(same > 0, same - 1).otherwise(n).cast("int")

    for side in ("before", "after"):
        m = m.withColumn(f"n_{side}", equal(side))
        # what the first holder has not: later holders may share it, if there are two
        m = m.withColumn(f"rest_{side}", F.expr(f"if(n > 2, slice({side}, n_{side} + 1, greatest(size({side}) - n_{side}, 0)), slice({side}, 1, 0))"))
    reach = lambda side, none: F.when(F.col(f"n_{side}") == 0, none).otherwise(F.get(side, F.col(f"n_{side}") - 1)["pos"])
    m = m.select("id", "th", "pos", "last", "fp", reach("before", F.col("pos")).alias("s"), reach("after", F.col("last")).alias("e"),
                 F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"rest_{k}").alias("rest")) for k in ("before", "after")]).alias("sides"))
    m = materialize(m, "matches")
    r = m.select("id", "th", "s", "e").unionByName(later_reaches(m)).distinct()
    # touching ranges become one
    doc = Window.partitionBy("id", "th").orderBy("s", "e")
    r = r.withColumn("far", F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("new", F.sum(F.when(F.col("far").isNull() | (F.col("s") > F.col("far") + 1), 1).otherwise(0)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy("id", "th", "new").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return r.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def delete_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS,
                   window_words: int = WINDOW_WORDS, spans_col: str = "removed") -> DataFrame:
    """``df`` with the repeated runs cut out of its text, and ``spans_col``: the
    (s, e) line ranges of the former text that went."""
    spans = repeated_spans(line_table(df, id_col, text_col, gram_words), gram_words, window_words)
    cols = [c for c in df.columns if c.lower() != spans_col.lower()]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    s = spans.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spans")
    d = d.join(s, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    d = d.withColumn("lines", F.when(F.col("spans").isNotNull(), F.split(F.col("r")[text_col], "\n")))
    # what stands before each range, and after the last
    rest = F.expr("""concat(
        flatten(transform(spans, (x, i) -> slice(lines, if(i = 0, 0, get(spans, i - 1).e + 1) + 1, x.s - if(i = 0, 0, get(spans, i - 1).e + 1)))),
        slice(lines, element_at(spans, -1).e + 2, size(lines)))""")
    text = F.when(F.col("spans").isNull(), F.col("r")[text_col]).otherwise(F.array_join(rest, "\n"))
    out = [text.alias(c) if c.lower() == text_col.lower() else F.col("r")[c].alias(c) for c in cols]
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return d.select(*out, F.coalesce("spans", none).alias(spans_col))
