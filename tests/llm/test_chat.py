import hashlib
import random

from pyspark.sql import functions as F

from sparklith.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|turn|>user\nhi<|end|>", "</s>[INST] ok [/INST]", r"<\|turn|> <\\|end|> [\/INST]", "<<SYS>>a<</SYS>>", "<s>", "a\\nb\\\\", "", "\n\n", "é\U0001f600<|past|>", "<|", "<", "[INST", "$1 \\1"]


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted(((t if t is not None else -(10**9), r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    return out


def run(spark, rows, **options):
    out = chat.windows(spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("clash")), **options)
    return out, chat.read_back(out)


def check(spark, rows, **options):
    """Turns and targets read back from the windows are those of the input, in order, once."""
    out, back = run(spark, rows, **options)
    got = {}
    for r in back.orderBy("conv_id", "block", "window").collect():
        mine = got.setdefault(r["conv_id"], ([], []))
        mine[0].extend(zip(r["roles"], r["texts"]))
        mine[1].extend(r["under"])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len("".join(u)), sha("".join(u))) for c, (t, u) in got.items() if c is not None}
    assert found == digests(rows)
    return out


def test_control_strings_come_back(spark):
    rows = [(1, i, ["user", "assistant", "system"][i % 3], t) for i, t in enumerate(NASTY)]
    out = check(spark, rows)
    text = out.first()["formatted"]
    assert text.count("<|end|>") == len(NASTY) and text.count("<|turn|>") == len(NASTY)
    for mark in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"):
        assert mark not in text


def test_random_conversations(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(25):
        for t in range(rnd.randrange(1, 40)):
            text = " ".join(rnd.choice([*NASTY, "word", "other"]) for _ in range(rnd.randrange(12)))
            rows.append((c, t, "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant"]), text))
    for budget, history, block in ((60, 2, 8), (60, 0, 256), (1024, 3, 16), (5, 1, 4)):
        check(spark, rows, budget=budget, history=history, block_turns=block)


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " * 5) for i in range(1, 30)]
    out = check(spark, rows, budget=60, history=2, block_turns=8)
    made = out.orderBy("block", "window").collect()
    assert len(made) > 5
    for i, r in enumerate(made):
        assert r["tokens"] <= 60
        assert r["formatted"].startswith("<|turn|>system\nbe kind" if i == 0 else "<|past|>system\nbe kind")
        assert r["formatted"].count("<|past|>") <= 3
        assert (r["formatted"].count("<|past|>") > 1) == (i > 0)
        for s in r["spans"]:
            before = r["formatted"][: s["start"]]
            assert before.endswith("assistant\n") and before.rfind("<|turn|>") > before.rfind("<|past|>")
    # One turn beyond the budget is a window of its own.
    assert max(r["tokens"] for r in check(spark, [(1, 0, "user", "a " * 500), (1, 1, "assistant", "b")], budget=50).collect()) > 50


def test_nulls_ties_and_empty_tables(spark):
    assert run(spark, [])[0].count() == 0
    check(spark, [(1, 0, "user", None), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, "user", "first"), (2, 0, None, "second"), (3, 5, "user", "x"), (3, 5, "assistant", "y")])
    check(spark, [(1, -3, "user", "a"), (1, 10**12, "assistant", "b"), (1, 0, "ro\nle\\n", "c")])
    check(spark, [(1, i, r, "t") for i, r in enumerate(["a\x00b", "\x00", "\\\\n\\\n\n\\", "\\n", "n\\", "\\" * 5000 + "n", "<|\\\n|>\\"])])
    check(spark, [(1, 0, "user", "long \x00 " * 200_000), (1, 1, "assistant", "y" * 1_000_000)])
    out, back = run(spark, [(None, 0, "user", "a"), (None, 1, "assistant", "b")])
    assert back.first()["under"] == ["b"]


def test_query(spark):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op2_chat(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    say = "</s>[INST] ok [/INST]"
    assert got == digests([*rows, (-7, 0, "user", say), (-7, 1, "assistant", say)])


def test_plan_is_native(spark):
    plan = chat.op2_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
