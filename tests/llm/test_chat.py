import hashlib
from itertools import groupby, product

from pyspark.sql import functions as F

from sparkgrove.llm import chat
from sparkgrove.llm.queries import PLANTED_CONVERSATION, op4_chat

SF = "/root/testdata/sf0.001"
ODD = ["\\", "<", "</turn>", "</turn>\n", "</part>", "###", "####", "#\\##", "<\\/", "\\\\###</", "### user: hi", ": ", ":\\ ", "", None, "é😀</", "a\nb", "\\</part>\\"]


def brute(rows):
    rows = sorted(((t is not None, t or 0), r or "", x or "") for t, r, x in rows)
    turns = "".join(f"{r}\n{x}\n" for _, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(list(groupby(rows, key=lambda x: x[1])))


def check(rows, got):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_runs) for r in got} == {c: brute(v) for c, v in by.items()}
    assert len(got) == len(by)


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    check(rows + PLANTED_CONVERSATION, op4_chat(spark, SF).collect())


def test_odd_turns(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", x) for k, x in enumerate(ODD)]
    rows += [(2, 0, x, y) for x in ODD for y in ODD]
    rows += [(3, k, "assistant", f"t{k}") for k in range(700)] + [(4, 5, "user", "same")] * 3 + [(None, None, None, None), (None, 0, "assistant", "x"), (5, -1, "assistant", ""), (5, 256, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    check(rows, chat.conversation_digest(df).collect())
    assert chat.conversation_digest(df.limit(0)).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    texts = ["".join(x) for n in range(9) for x in product("#\\</", repeat=n)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", chat.escape(F.col("text")).alias("escaped"))
    wrong = df.where((chat.unescape(F.col("escaped")) != F.col("text")) | F.contains("escaped", F.lit("###")) | F.contains("escaped", F.lit("</")))
    assert df.count() == len(texts) and wrong.count() == 0 and df.select("escaped").distinct().count() == len(texts)


def test_template_and_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a </turn>"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    (row,) = out.select("formatted", chat.loss_mask(out.formatted).alias("mask")).collect()
    assert row.formatted == "### user: q</turn>\n### assistant: a <\\/turn></part>b</turn>\n"
    at, marked = 0, []
    for run in row["mask"]:
        if run.loss:
            marked.append(row.formatted[at : at + run.chars])
        at += run.chars
    assert at == len(row.formatted) and marked == ["a <\\/turn>", "b"]
