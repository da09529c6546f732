import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm.chat import CHATML, Template, chat_digests, format_chats, formatted, loss_text, read_back

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "<<||", "a<", "|b", "\n", "\\", "<\\", "$1 \\1", "<|<|\\|", "émoji 🙂 <|", "\r\n", "%0A%25"]


def machine(roles, t=CHATML):
    state = t.start
    for i, r in enumerate(roles):
        state = t.moves.get(state, {}).get(r)
        if state is None:
            return False, i
    return state in t.final, None


def brute(rows):
    out = {}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        trained = "".join(x for *_, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), *machine([r for *_, r, _ in turns]))
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["bad_turn"]) for r in df.collect()}


def test_hard_texts_come_back(spark):
    rng = random.Random(2)
    rows = [(i, k, rng.choice(["user", "assistant", "system", "user\nassistant", "%0A", "<|im_end|>", "", "tool"]), rng.choice(HARD) + rng.choice(HARD)) for i in range(150) for k in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert digests(chat_digests(df)) == brute(rows)
    back = formatted(format_chats(df)).select("conv_id", read_back(F.col("formatted")).alias("t"), loss_text(F.col("segments")).alias("loss"), "formatted", "segments")
    for r in back.collect():
        own = sorted(x for x in rows if x[0] == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["t"]] == [x[2:] for x in own]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == r["formatted"].count("<|") // 2 == len(own)
        assert [s["loss"] for s in r["segments"]] == [x for o in own for x in (False, o[2] == "assistant", False)]


def test_plain_format(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Ho")], SCHEMA)
    assert formatted(format_chats(df)).first()["formatted"] == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHo<|im_end|>\n"


@pytest.mark.parametrize("roles, valid, bad", [
    ("user assistant", True, None), ("system user assistant user assistant", True, None), ("user", False, None), ("assistant", False, 0),
    ("user user assistant", False, 1), ("user system assistant", False, 1), ("system system", False, 1), ("user assistant user", False, None), ("user tool", False, 1), ("start>user", False, 0)])
def test_machine(spark, roles, valid, bad):
    row = format_chats(spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles.split())], SCHEMA)).first()
    assert (row["valid"], row["bad_turn"]) == (valid, bad) == machine(roles.split())


def test_other_templates(spark):
    t = Template(head="{%", tail="{%end}", guard="{%", trained=("bot", "tool"), start="s", final=("b",), moves={"s": {"bot": "b"}, "b": {"bot": "b", "tool": "b"}})
    rows = [(1, 0, "bot", "a{%end}{%"), (1, 1, "tool", "{\\%"), (2, 0, "tool", "")]
    got = {r["conv_id"]: r for r in formatted(format_chats(spark.createDataFrame(rows, SCHEMA), t)).select("*", read_back(F.col("formatted"), t).alias("t"), loss_text(F.col("segments"), t).alias("loss")).collect()}
    assert [tuple(x) for x in got[1]["t"]] == [("bot", "a{%end}{%"), ("tool", "{\\%")]
    assert (got[1]["loss"], got[1]["valid"], got[2]["valid"], got[2]["bad_turn"]) == ("a{%end}{%{\\%", True, False, 0)
    for wrong in ({"head": "im_start"}, {"guard": "<<"}, {"tail": "<|\\"}, {"moves": {"a>b": {}}}, {"head": "<|x\n"}, {"tail": "<|a<|"}):
        with pytest.raises(ValueError):
            Template(**wrong)


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "assistant", "c"), (4, 0, "user", "z<|" * 400_000), (4, 1, "assistant", "y" * 1_000_000)]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", "t") for i in range(5000)] + [(6, 0, "user", "same"), (6, 0, "user", "same")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("segments", F.lit(1)).withColumn("formatted", F.lit("clash")).withColumn("t", F.lit(0))
    assert digests(chat_digests(df)) == brute(rows)
    assert chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat_digests(spark.range(1).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
