import random

from pyspark.sql import functions as F

from corpusloom.llm import chat as C


def plain(turns):
    """The formatted text and loss spans by a loop."""
    esc = lambda s: (s or "").replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    out, spans, before = "", [], None
    for i, (role, text) in enumerate(turns):
        out += (C.SEP if i and role == before else (C.END if i else "") + C.TURN + esc(role) + C.TEXT)
        if role == "assistant":
            spans.append((len(out), len(esc(text))))
        out += esc(text)
        before = role
    return out + C.END, spans


def test_matches_a_loop(spark):
    r = random.Random(4)
    bits = ["</s>", "[INST]", "&lt;", "<|sep|>", "<|end|>", "<|turn|>user<|text|>", "a", "é😀", "\n", ""]
    rows, want = [], {}
    for c in range(40):
        n = r.choice([1, 2, 5, 30])
        turns = [(r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(4))) for _ in range(n)]
        want[c] = turns
        rows += [(c, t * r.choice([1, 1]), role, text, "x") for t, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    for block in (2, 7, 256):
        made = C.format_chats(df, block=block).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans")))
        for x in made.collect():
            turns = want[x["conv_id"]]
            text, spans = plain(turns)
            assert x["formatted"] == text
            assert [(s["start"], s["len"]) for s in x["loss_spans"]] == spans
            assert [(t["role"], t["text"]) for t in x["turns"]] == turns
            assert x["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "assistant", "b"), (1, 0, None, None), (1, 0, None, None), (None, 3, "user", "z"), (2, 1, "user", "b"), (2, 1, "user", "a"), (3, 0, "assistant", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.format_chats(df).withColumn("t", C.read_turns(F.col("formatted"))).withColumn("l", C.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("assistant", "b"), ("", ""), ("", "")]
    assert [tuple(t) for t in got[2]["t"]] == [("user", "a"), ("user", "b")]
    assert [tuple(t) for t in got[None]["t"]] == [("user", "z")] and got[None]["l"] == ""
    assert got[3]["l"] == "y" * 100_000
    assert C.format_chats(df.where("turn > 99")).collect() == []


def test_no_python_in_the_plan(spark, sf):
    from corpusloom.llm.queries import op9_chat

    plan = op9_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
