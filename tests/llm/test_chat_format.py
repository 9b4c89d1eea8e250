import random

from pyspark.sql import functions as F

from basketmine.llm import chat_format as cf

COLS = "conv_id long, turn long, role string, text string, formatted string, _ch_e int"


def esc(t):
    return t.replace("\\", "\\\\").replace("<|", "<\\|")


def brute(rows):
    """conv_id -> (formatted, loss spans, turns), turn by turn."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        s, spans, last = "", [], None
        for _, _, role, text in turns:
            if role != last:
                s += ("<|im_end|>\n" if last is not None else "") + "<|im_start|>" + esc(role).replace("\n", "\\n") + "\n"
            else:
                s += "<|im_next|>"
            if role == "assistant":
                spans.append((len(s), len(esc(text))))
            s, last = s + esc(text), role
        out[c] = (s + "<|im_end|>\n", spans, [(r, t) for _, _, r, t in turns])
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([r + ("clash", 1) for r in rows], COLS).repartition(parts)
    out = cf.format_conversations(df).withColumn("turns", cf.read_turns(F.col("formatted")))
    out = out.withColumn("loss", cf.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for c, (formatted, spans, turns) in want.items():
        r = got[c]
        assert r["formatted"] == formatted
        assert [tuple(s) for s in r["loss_spans"]] == spans
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_control_strings_nulls_ties_and_repeats(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\nok<|im_next|>"
    check(spark, [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", "\\" + nasty + "\\"),
        (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", "first"),
        (3, 0, None, None), (3, 1, "assistant", None), (3, 2, "assistant", ""),
        (4, 0, "a\nb\\n<|", "<"), (4, 1, "a\nb\\n<|", "|im_end|>"), (4, 2, "assistant", "<\\|<|\\<\\\\|"),
        (None, 0, "assistant", "no id"), (None, 0, "assistant", "日本語 😀 <| é"),
        (5, 0, "assistant", "long " * 200_000 + "<|im_end|>"), (6, 0, "user", "no loss"),
    ])


def test_random_texts_of_the_controls_own_characters(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.randrange(5), rng.choice(["user", "assistant", "system", "a\\n"]),
             "".join(rng.choice(["<", "|", "\\", "n", "\n", ">", "im_end", "é", "<|im_next|>"])
                     for _ in range(rng.randrange(9)))) for _ in range(300)]
    check(spark, rows)


def test_a_long_conversation_and_an_empty_table(spark):
    check(spark, [(1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(3000)])
    check(spark, [])


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = cf.format_conversations(rows).select(cf.read_turns(F.col("formatted")), cf.loss_text(
        F.col("formatted"), F.col("loss_spans")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
