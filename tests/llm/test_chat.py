import hashlib
import random
from collections import defaultdict

from mustra.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def digests(rows):
    held = defaultdict(list)
    for c, t, r, x, *_ in rows:
        held[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in held.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_are_read_back(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op5_chat_format(spark, sf_dir).collect()}
    assert got == digests(rows + queries.CONTROL_TURNS)


def test_hard_turns_by_any_budget(spark):
    rng = random.Random(6)
    bits = ["<|end|>\n", "<|turn|>", "<", "|", "\\", "<\\|", "<\\\\|text|>", "é", "\n", "plain words", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system<", "a|b"]), text(), 1) for c in (1, 2, 3) for t in range(25)]
    rows += [(1, -1, "system", "be <|kind|>", 1), (9, None, None, None, 1), (9, None, None, None, 1), (None, 0, "assistant", "x" * 3000, 1), (None, 1, "user", "y", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for budget, history in ((60, 20), (200, 0), (10, 5), (100_000, 1000)):
        windows = chat.format_windows(frame, budget=budget, history=history)
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digest_windows(windows).collect()}
        assert got == digests(rows), (budget, history)
    assert chat.digest_windows(chat.format_windows(frame.limit(0))).count() == 0


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "s" * 40, 0)] + [(1, t, "user" if t % 2 else "assistant", "w" * 100, 0) for t in range(1, 60)] + [(1, 60, "user", "v" * 4000, 0), (1, 61, "assistant", "z", 0)]
    out = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=300, history=60).orderBy("window").collect()
    assert len(out) > 5
    over = [r for r in out if r.n_tokens > 300]
    assert len(over) == 1 and "v" * 4000 in over[0].text and over[0].repeated == 1
    assert all(r.text.startswith("<|turn|>system<|text|>" + "s" * 40) for r in out)
    assert any(r.repeated > 1 for r in out[1:]) and out[0].repeated == 0
    assert sum(len(r.loss) for r in out) == sum(r[2] == "assistant" for r in rows)


def test_a_system_turn_over_the_budget_is_kept(spark):
    rows = [(1, 0, "system", "s" * 4000, 0)] + [(1, t, "user" if t % 2 else "assistant", "w" * 20, 0) for t in range(1, 5)]
    out = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=300, history=60).orderBy("window").collect()
    assert len(out) == 4 and all("s" * 4000 in r.text and r.text.count("<|turn|>") == 2 and r.repeated == (i > 0) for i, r in enumerate(out))


def test_counts_of_tokens_may_come_with_the_rows(spark):
    rows = [(1, t, "user", "x", 0, 100 if t else None) for t in range(6)]
    out = chat.format_windows(spark.createDataFrame(rows, SCHEMA + ", counted int"), budget=250, history=0, tokens_col="counted").collect()
    assert sorted(r.n_tokens for r in out) == [100, 100, 100, 205]
    assert max(r.n_tokens for r in out) <= 250


def test_a_very_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("3 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text", "0 AS window")
    out = chat.digest_windows(chat.format_windows(rows)).collect()
    expected = digests([(3, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(20_000)])
    assert {r.conv_id: tuple(r)[1:5] for r in out} == expected
