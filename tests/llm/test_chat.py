import hashlib

from specframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, last string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_odd_conversations(spark):
    turns = [
        (1, 0, "user", "\\### Assistant: </turn> ok\n"), (1, 1, "assistant", "<\\/turn> \\\\ ### </turn>\n### user: x"), (1, 2, "user", None),
        (2, 0, "us:er\\", "only"), (3, None, "assistant", "first"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, 0, None, "z")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], SCHEMA)
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = [(role or "", text or "") for c, _, role, text in turns if c == conv]
        loss = "".join(text for role, text in mine if role == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for role, text in mine))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), digest(loss))
    examples = {(r["conv_id"], r["example"]): r for r in chat.expand(df).collect()}
    assert [k for k in examples if k[0] == 1] == [(1, 0), (1, 1)] and examples[1, 1]["loss_length"] == 0
    assert examples[1, 1]["text"].startswith(examples[1, 0]["text"])


def test_no_conversations(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], SCHEMA))).collect() == []
