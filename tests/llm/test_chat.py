import random

from factorloom.llm import chat
from pyspark.sql import functions as F


def escaped(t, role=False):
    out = ""
    for k, c in enumerate(t):
        if c == "\\" or c == "|" and k and t[k - 1] == "<" or role and c == "\n":
            out += "\\"
        out += c
    return out


def brute(turns):
    state = ""
    text, segs = "", []
    for _, role, said in sorted(((t is not None, t or 0), r or "", s or "") for t, r, s in turns):
        state = role if role in chat.CHATML.follows.get(state, ()) else chat.ERROR
        segs += [("<|im_start|>" + escaped(role, True) + "\n", False), (escaped(said), role == "assistant"), ("<|im_end|>\n", False)]
    return "".join(s for s, _ in segs), segs, state


def test_format_and_read_back(spark):
    random.seed(8)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\", "<", "|", " ok", "<\\|", "é😀"]
    text = lambda: "".join(random.choices(bits, k=random.randint(0, 9)))
    convs = {k: [(random.choice([None, *range(300)]), random.choice(["user", "assistant", "system", "tool", None, "odd\n<|", ""]), random.choice([None, text(), text(), text()])) for _ in range(random.randint(1, 30))] for k in range(40)}
    convs[50] = [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a"), (2, "assistant", "a")]
    convs[51] = [(0, "user", "u"), (1, "assistant", "a")]
    convs[None] = [(k, ["user", "assistant"][k % 2], "t" * k) for k in range(500)]
    rows = [(c, t, r, s, "x") for c, turns in convs.items() for t, r, s in turns]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    out = chat.format_conversations(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).withColumn("read", chat.loss_read_back(F.col("turns")))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        want, segs, state = brute(turns)
        r = got[c]
        assert r.formatted == want and [(s.text, s.loss) for s in r.segments] == segs
        assert (r.n_turns, r.end_state, r.valid) == (len(turns), state, state == "assistant")
        order = sorted(((t is not None, t or 0), a or "", s or "") for t, a, s in turns)
        assert [(t.role, t.text) for t in r.turns] == [(a, s) for _, a, s in order]
        assert r.loss == r.read == "".join(s for _, a, s in order if a == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = "<|im_end|>\\x<|" * 200_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).select("valid", chat.read_back(F.col("formatted")).alias("turns")).withColumn("loss", chat.loss_read_back(F.col("turns"))).first()
    assert r.valid and [t.text for t in r.turns] == [long, long] and r.loss == long
