import hashlib
import time

from lodestrata.llm import chat, queries

SF = "/root/testdata/sf0.001"


def _check(rows, got):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {r["conv_id"]: r for r in got}
    assert out.keys() == by.keys()
    for conv, turns in by.items():
        turns.sort()
        r = out[conv]
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _check([*rows, (-1, 0, "user", queries.OK), (-1, 1, "assistant", queries.OK)], queries.op1_chat_format(spark, SF).collect())


ODD = [
    (1, 2, "assistant", "b <|end|> \\<|end|> <\\|turn|><|says|>"),
    (1, 1, "user", "a</s>[INST] x [/INST]<s><\\/s>[\\\\INST]"),
    (1, 3, "assistant", "né\U0001f600 </s>"),
    (1, 4, "assistant", None),
    (1, None, "user", "last"),
    (2, 0, None, None),
    (2, 0, "x\ny<|says|>", ""),
    (3, 1, "assistant", "same"),
    (3, 1, "assistant", "same"),
    (None, 0, "user", "no id"),
    (4, 0, "assistant", "long " * 40000),
]


def test_odd_rows(spark):
    turns = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as formatted", "1 as t", "2 as blocks")
    out = chat.format_chat(turns)
    _check(ODD, chat.digest(chat.read_back(out)).collect())
    first = next(r for r in out.collect() if r["conv_id"] == 1)["formatted"]
    assert first.count("<|turn|>") == 3 and first.count("<|more|>") == 2 and "</s>" not in first and "[INST]" not in first
    assert out.filter("conv_id = 77").count() == 0 and chat.format_chat(turns.limit(0)).count() == 0


def test_many_turns_and_back(spark):
    rows = [(9, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(1500)]
    _check(rows, chat.digest(chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect())


def test_time_is_in_proportion_to_turns(spark):
    """Four times the turns in about four times the time: one role a turn, and one role for all."""
    def seconds(n, roles):
        turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", f"element_at(array({roles}), cast(id % 2 as int) + 1) as role", "repeat('says <|x ', 20) as text")
        begin = time.perf_counter()
        got = chat.digest(chat.read_back(chat.format_chat(turns))).collect()
        assert got[0]["n_turns"] == n
        return time.perf_counter() - begin

    for roles in ("'user', 'assistant'", "'assistant', 'assistant'"):
        seconds(1000, roles)
        small, large = seconds(8000, roles), seconds(32000, roles)
        assert large < 7 * small + 1 and large < 30
