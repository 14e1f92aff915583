import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from postmatch.llm import chat
from tests.llm import odd_tables as samples

ODD = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>", "a<\\|end|>b<\\\\|", "<", "|>", "<|", "\\", "<\\", "|",
       "see ![a cat](https://x.org/cat.png?x=1) and ![](talk.mp3)<|", "![p](paper.PDF#3)![q](q.webp)", "![no](a b) ![",
       "<![x](y)|end|>", "<|image|>", "", " \n", "Ünï \U0001f600", None, "<|<|<|", "$1 \\1 $"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, parts string, formatted string, loss int"


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(("user", "assistant", "system"))
            out.append((conv, turn, role, " ".join(rng.choice(ODD) or "" for _ in range(rng.randint(0, 3)))))
    out += [(50, k, "assistant", text) for k, text in enumerate(ODD)]
    out += [(51, 0, None, "x"), (51, None, "user", "first"), (51, 0, "<|text|>\n", "b"), (51, 0, "user", "tie"),
            (None, 1, "assistant", "no id"), (None, None, None, None), (52, 3, "assistant", None)]
    out += [(53, 1, "assistant", "twice")] * 2
    out.append((54, 0, "assistant", samples.prose(random.Random(1), 40_000) + " <|end|>"))
    return out


def table(spark, some):
    return spark.createDataFrame([(*r, "p", "f", 1) for r in some], SCHEMA).repartition(5)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(some):
    odd = ODD[0]
    convs = {}
    for conv, turn, role, text in [*some, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learnt), digest(learnt))
    return out


def test_reads_back_what_it_wrote(spark):
    got = {r[0]: tuple(r)[1:5] for r in chat.chat_digests(table(spark, rows())).collect()}
    assert got == plain(rows())


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows())
    found = chat.chat_digests(table(spark, rows()))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({chat.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = [t for t in ODD if t is not None] + ["".join(random.Random(k).choices("<|\\>end", k=12)) for k in range(300)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in found.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and "<|" not in r.e
        assert r.e == r.t or "|" in r.t


PARTS = "array<struct<kind: string, text: string, ref: string, units: bigint>>"


def test_typed_parts_become_placeholders(spark):
    turns = [
        (1, 0, "user", [("text", "Look: ", None, None), ("image", None, "s3://b/1.png", 4), None,
                        ("text", " and <|image|> ", None, None), ("audio", "![a](2.mp3)", "2.mp3", 60)]),
        (1, 1, "assistant", [("document", "D", "3.pdf", None), ("text", "fine", None, None)]),
        (1, 2, "assistant", None),
        (1, 3, "user", [("video", "as text", "4.mp4", 2), (None, "plain", None, None), ("text", None, None, None)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id bigint, turn bigint, role string, parts {PARTS}")
    got = chat.formatted_chats(df, expansion={"audio": 10}).first()
    assert got.formatted == (
        "<|turn|>user<|text|>Look: <|image|> and <\\|image|> <|audio|><|end|>"
        "<|turn|>assistant<|text|><|document|>fine<|end|><|turn|>assistant<|text|><|end|>"
        "<|turn|>user<|text|>as textplain<|end|>")
    assert [tuple(a) for a in got.attachments] == [
        ("image", "s3://b/1.png", None, 4 * 576), ("audio", "2.mp3", "![a](2.mp3)", 600), ("document", "3.pdf", "D", 1024)]
    assert [got.formatted[s.start:s.end] for s in got.loss] == ["<|document|>fine", ""]
    assert [(s["first"], s["count"]) for s in got.loss] == [(2, 1), (3, 0)]
    assert chat.read_back(chat.formatted_chats(df)).first().learnt == "Dfine"


def test_references_in_a_text(spark):
    text = "a ![x](i.png) b ![](s.ogg?t=1)![d](f.docx) c"
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(chat.typed_parts(F.col("t")).alias("p"))
    got, *bare = [[(p.kind, p.text, p.ref) for p in r.p] for r in found.collect()]
    assert got == [("text", "a ", None), ("image", "![x](i.png)", "i.png"), ("text", " b ", None),
                   ("audio", "![](s.ogg?t=1)", "s.ogg?t=1"), ("text", "", None), ("document", "![d](f.docx)", "f.docx"),
                   ("text", " c", None)]
    assert bare == [[("text", "", None)]] * 2


def test_empty_table_and_plan(spark):
    got = chat.chat_digests(table(spark, []))
    assert [r.conv_id for r in got.collect()] == [-7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    own = chat.formatted_chats(table(spark, rows()).withColumn("parts", chat.typed_parts(F.col("text"))))
    assert own._jdf.queryExecution().sparkPlan().toString().count("Exchange hashpartitioning") <= 1
