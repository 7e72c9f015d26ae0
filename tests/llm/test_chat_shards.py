import heapq
import random
import zlib

from pyspark.sql import functions as F

from corpusprep.llm import chat_fold, lpt_shards

MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "</s>", "[INST]", "\\", "\\[INST]", "<", "|", "\n", "é", "", "ok", "<<SYS>>", "[/INST]"]


def test_chat_round_trip(spark):
    r = random.Random(1)
    rows = []
    for c in list(range(40)) + [None]:
        for t in range(r.randint(1, 12)):
            rows.append((c, t if r.random() < .95 else None, r.choice(["user", "assistant", "system", None, "a<|im_msg|>b\n"]),
                         r.choice([None, "".join(r.choice(MARKS) for _ in range(r.randint(0, 9)))]), 7))
    rows += [(50, 1, "user", "same", 7)] * 3 + [(51, t, "assistant", "x" * 50_000, 7) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_fold.format_chats(df).select("*", chat_fold.read_turns().alias("back"), chat_fold.read_loss().alias("loss")).collect()
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    assert len(out) == len(want)
    for o in out:
        turns = [(a.decode(), b.decode()) for _, _, a, b in sorted(want[o.conv_id])]
        assert [(x.role, x.text) for x in o.back] == turns
        assert o.loss == "".join(t for a, t in turns if a == "assistant")
        assert o.n_messages == sum(i == 0 or turns[i - 1][0] != a for i, (a, _) in enumerate(turns)) == o.formatted.count("<|im_start|>")
        for s, (_, t) in zip(o.loss_spans, [x for x in turns if x[0] == "assistant"]):
            assert len(o.formatted[s.start:s.start + s.length].replace("\\", "")) <= s.length and s.length >= len(t)
    assert chat_fold.format_chats(df.where("false")).count() == 0


def brute_lpt(groups, n):
    heap, load = [(0, s) for s in range(n)], [0] * n
    for b in sorted(groups, reverse=True):
        w, s = heapq.heappop(heap)
        heapq.heappush(heap, (w + b, s))
        load[s] = w + b
    return load


def test_shards(spark):
    r = random.Random(2)
    rows = [(r.choice([None, i]), r.choice([None, "", "hot" * 40, "t%d" % r.randint(0, 900) * r.randint(1, 30)]), "c") for i in range(4000)]
    rows += [(1, "é" * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    for n in (1, 7):
        out = lpt_shards.shard_rows(df, n, fine=10_000).collect()
        assert len(out) == len(rows)
        by, load, slots = {}, [0] * n, {}
        sizes = {}
        for t in (t or "" for _, t, _ in rows):
            sizes.setdefault(zlib.crc32(t.encode()), [0, len(t.encode()) + 16])[0] += 1
        for o in out:
            assert by.setdefault(o.text_crc32, o.shard) == o.shard and o.size == sizes[o.text_crc32][1]
            load[o.shard] += o.size
            slots.setdefault(o.shard, []).append(o.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(load) == sorted(brute_lpt([c * b for c, b in sizes.values()], n))
        coarse = lpt_shards.shard_rows(df, n, fine=3).collect()
        assert len(coarse) == len(rows)
        assert len({(o.text_crc32, o.shard) for o in coarse}) == len(sizes)
    assert lpt_shards.shard_rows(df.where("false"), 4).count() == 0
