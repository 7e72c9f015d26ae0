"""F1-F11 against hand-written tables and properties of Unicode categories."""

import random
import unicodedata

from pyspark.sql import functions as F

from corpusprep.functions import prompts as P
from corpusprep.functions import text as X

EDGE = [None, "", "カタカナとひらがな、漢字。？！", "ラーメン", "全角　スペース", "café",
        "x²①", "snake_case", "emoji 😀 ok", "[startofspeech]x[endofspeech]", "tab\there",
        " \t 　\u001cmiddle\u001c　 \t ", "a.b,c;d:e-f", "ÉÈÊ ß ñ"]


def one_col(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def collect(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


#: text -> cleaned text, written by hand
CLEANED = {None: None, "": "", "カタカナとひらがな、漢字。？！": "カタカナとひらがな、漢字。？！", "全角　スペース": "全角スペース",
           "x²①": "x²①", "snake_case": "snake_case", "emoji 😀 ok": "emojiok", "[startofspeech]x[endofspeech]": "startofspeechxendofspeech",
           "tab\there": "tabhere", "a.b,c;d:e-f": "abcdef", "ÉÈÊ ß ñ": "ÉÈÊßñ", "「引用」です。": "引用です。", "１２３ＡＢＣ": "１２３ＡＢＣ"}


def test_clean_corpus_table(spark):
    got = collect(one_col(spark, list(CLEANED)).select("i", X.clean_corpus("t").alias("c")), "c")
    assert got == list(CLEANED.values())


def test_clean_corpus_by_category(spark):
    """Exactly the letters, numbers, the underscore and four marks stay, in order."""
    chars = [chr(c) for c in list(range(0x20, 0x250)) + list(range(0x3040, 0x3100)) + list(range(0x4E00, 0x4E80)) + list(range(0xFF00, 0xFF60))
             if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    rnd = random.Random(3)
    rows = ["".join(rnd.choice(chars) for _ in range(40)) for _ in range(300)]
    got = collect(one_col(spark, rows).select("i", X.clean_corpus("t").alias("c")), "c")
    for row, out in zip(rows, got):
        assert out == "".join(c for c in row if c in "_。、？！" or unicodedata.category(c)[0] in "LN")


def test_unicode_strip_matches_python(spark):
    ws = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"
    rnd = random.Random(5)
    rows = EDGE + ["".join(rnd.choice(ws + "ab c") for _ in range(12)) for _ in range(300)]
    got = collect(one_col(spark, rows).select("i", X.unicode_strip("t").alias("c")), "c")
    assert got == [None if t is None else t.strip() for t in rows]


#: text -> the marked part, and what stays of the text
SPANS = {"no marker here": ("", "no marker here"), "only startofspeech here": ("", "only startofspeech here"),
         "only endofspeech here": ("", "only endofspeech here"), "astartofspeechendofspeechb": ("", "ab"),
         "xstartofspeechSAMEendofspeechystartofspeechSAMEendofspeechz": ("SAME", "xyz"),
         "xstartofspeechONEendofspeechystartofspeechTWOendofspeechz": ("ONE", "xystartofspeechTWOendofspeechz"),
         "a startofspeech line1\nline2 endofspeech b": ("line1\nline2", "a  b"),
         "startofspeech outer startofspeech inner endofspeech tail": ("outer startofspeech inner", " tail"),
         " padded startofspeech  v  endofspeech  ": ("v", " padded")}


def test_span_split_table(spark):
    voice, rest = X.span_split_columns(F.col("t"))
    got = one_col(spark, list(SPANS)).select("i", voice.alias("v"), rest.alias("r")).orderBy("i").collect()
    assert [(r["v"], r["r"]) for r in got] == [(v, X.REPLY_INSTRUCTION + r) for v, r in SPANS.values()]


#: transcript -> cleaned transcript
TRANSCRIPTS = {"「あ」": "あ", "「あ」。": "あ", "（あ）": "(あ)", "｢あ｣": "あ", "♥love♥": "love", "bad\ufffdchar": "badchar", "ｶﾀｶﾅ": "カタカナ",
               "plain ascii": "plain ascii", "『引用』。です": "引用です", "【見出し】本文": "見出し】本文"}


def test_clean_transcript_table(spark):
    got = collect(one_col(spark, list(TRANSCRIPTS)).select("i", X.clean_transcript("t").alias("c")), "c")
    assert got == list(TRANSCRIPTS.values())


def test_shard_names_and_parse(spark):
    df = spark.createDataFrame([(0, 7), (1, 123456789)], "i int, n long")
    got = df.select("i", X.zero_pad_name("shard_", "n", 8).alias("s"),
                    X.numbered_file(F.col("n"), F.lit(12)).alias("f")).orderBy("i").collect()
    assert got[0]["s"] == "shard_00000007" and got[1]["s"] == "shard_123456789"
    assert got[0]["f"] == "train-00007-of-00012.parquet"
    names = one_col(spark, ["shard_00000042", "tmp_shard_1", "shard_x", None])
    assert collect(names.select("i", X.parse_shard_id("t").alias("p")), "p") == [42, None, None, None]


def test_prompt_forms(spark):
    df = one_col(spark, ["  hello  "])
    r = df.select(P.prompt_header("t").alias("h"), P.prompt_im("t").alias("m"),
                  P.prompt_think("t").alias("k"), P.sft_prompt(F.lit("S"), F.lit("U")).alias("s")).first()
    assert r["h"] == ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>hello\n\n"
                      "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")
    assert r["m"] == ("<|im_start|>system\nhello\n<|im_end|>\n<|im_start|>user\n"
                      "<|im_end|>\n<|im_start|>assistant\n")
    assert r["k"].startswith("<|im_start|>system\n  hello  <|im_end|>\n<|im_start|>user\n")
    assert r["k"].endswith("<|im_start|>assistant\n<think>\n\n</think>\n\n")
    assert r["s"] == ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>S"
                      "<|eot_id|><|start_header_id|>user<|end_header_id|>U"
                      "<|eot_id|><|start_header_id|>assistant<|end_header_id|>")


def test_error_sentinel(spark):
    df = one_col(spark, ["ERROR: offline", "text with ERROR inside", "ERRORS: not one", None])
    assert collect(df.select("i", X.is_error("t").alias("e")), "e") == [True, False, False, None]
