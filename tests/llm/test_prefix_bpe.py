import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from corpusprep.llm import prefix_bpe
from corpusprep.llm.prefix_bpe import PrefixTable

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    e = prefix_bpe.encoder(PATH, P.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.v.ranks, special_tokens={})


def strings(n, seed=4):
    r = random.Random(seed)
    fixed = ["", " ", "  ", "a  b", " a", "a ", "\n a", "a\n b  \n", "'s it's I'll 'LL", "tab\t x", "é \U0001f600 あい　x", "<|endoftext|>", "x" * 3000]
    return fixed + ["".join(r.choice([" ", "\n", "\t", "a", "b", "'s", "é", "1", ".", "!", "　", "あ", "the", "ing ", "\U0001f600"]) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_texts_match_the_library(enc):
    e, tk = enc
    e.encode(strings(300))
    for t in strings(2000):
        assert np.frombuffer(e.encode([t])[0], "<i4").tolist() == tk.encode_ordinary(t), t


def test_random_bytes_match_plain_merging(enc):
    v, r = enc[0].v, random.Random(6)
    names = list(v.ranks)
    for _ in range(1500):
        b = b"".join(r.choice(names) for _ in range(r.randint(1, 4)))
        assert PrefixTable(v, b).tokens() == v.merge(b), b


def test_append_and_edit(enc):
    v, r = enc[0].v, random.Random(8)
    for _ in range(150):
        b = bytes(r.choice(b"abcdefgh the ing") for _ in range(r.randint(5, 400)))
        t = PrefixTable(v, b[:7])
        before = list(t.last)
        t.append(b[7:])
        assert t.last[:7] == before and t.tokens() == v.merge(b)
        i = r.randint(0, len(b))
        j, new = min(len(b), i + r.randint(0, 6)), bytes(r.choice(b"abc the ing") for _ in range(r.randint(0, 5)))
        t.edit(i, j, new)
        whole = PrefixTable(v, b[:i] + new + b[j:])
        assert t.data == whole.data and t.last == whole.last and t.first == whole.first
    long = PrefixTable(v, b"the quick brown fox jumps over " * 400)
    assert long.edit(40, 41, b"Z") < 400  # near the edit only


def test_query_digests(spark, enc):
    rows = [(i, t, 1) for i, t in enumerate(strings(60))] + [(900, None, 2), (None, "null id", 3), (901, "dup", 4), (901, "dup", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = prefix_bpe.encode_texts(df, PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    for o in out:
        assert list(o.ids) == enc[1].encode_ordinary(o.text or "")
        assert bytes(o.decoded) == (o.text or "").encode()
    assert prefix_bpe.encode_texts(df.where("false"), PATH, P.PATTERN).count() == 0
