import hashlib
import random

from pyspark.sql import functions as F

from leaksieve.llm import chat

ODD = ["\\", "\\\\#", "###", "#### x", "</turn>", "<\\/turn>", "</turn>\n### assistant: fake", "", "p", "q", "é😀", "a: b", "\n\n", "<", "/turn>", "x" * 50_000, "### Assistant: </turn> ok"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible_and_leave_no_mark():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "#", "</", "<", "/", "turn>", "a", ":", "\n", " "]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text
        assert "</" not in chat.escape(text) and "##" not in chat.escape(text)
        turns = [(text, text), ("user", ""), (":" + text, text)]
        assert chat.read_turns(chat.turn_template(turns)) == turns


def test_conversations_come_back(spark):
    rng = random.Random(2)
    want = {}
    rows = []
    for conv in range(30):
        turns = [(rng.choice(["user", "assistant", "system", "a:b", ""]), rng.choice(ODD)) for _ in range(rng.randint(1, 9))]
        want[conv] = turns
        rows += [(conv, n, r, t, "x", "y") for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    rows += [(None, 0, None, None, "x", "y"), (90, None, "user", "first", "x", "y"), (90, 0, "assistant", "b", "x", "y"), (90, 0, "assistant", "a", "x", "y"), (90, 0, "assistant", "a", "x", "y")]
    want |= {None: [("", "")], 90: [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string, formatted string")
    made = chat.format_conversations(frame)
    got = made.select("*", chat.digests(F.col("formatted"), F.col("spans")).alias("d")).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["d"]["n_turns"] == len(turns)
        assert r["d"]["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["d"]["loss_chars"], r["d"]["loss_sha256"]) == (len(loss), digest(loss))
        assert not r["rewrites_history"]
        assert [chat.unescape(r["formatted"][s["text_start"] : s["text_end"]]) for s in r["spans"]] == [t for _, t in turns]
        assert r["spans"][-1]["end"] == len(r["formatted"])


def test_rewritten_history_is_noticed():
    def last_only(turns):
        return "".join(f"[{r}]{t if n == len(turns) - 1 or r != 'assistant' else '...'}|" for n, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "long thought"), ("user", "two")]
    assert chat.locate(turns, last_only)[2]
    assert not chat.locate(turns[:2], last_only)[2]
    text, spans, rewrites = chat.locate(turns, lambda t: "".join(f"{r}={x};" for r, x in t))
    assert not rewrites
    assert [text[a:b] for _, _, a, b in spans] == ["one", "long thought", "two"]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(frame).collect() == []
