import random

from quarry.llm.chat import chat_digest, formatted_chats, instruct, located, read_back, unescaped
from quarry.llm.queries import op2_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"
BITS = ["[INST]", "[/INST]", "<s>", "</s>", " ", "\\", "\n", "é", "\U0001f600", "a", "[ROLE]", " [/TURN]", "<", "[", "", ""]


def test_round_trip_of_hostile_turns():
    rng = random.Random(2)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "", "[/ROLE]\\", "x\ny"]), "".join(rng.choice(BITS) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(6))]
        out, spans, rewrites = located(instruct, turns)
        assert out == instruct(turns) and read_back(out) == turns and not rewrites
        assert [unescaped(out[s:e]) for _, _, s, e in spans] == [t for _, t in turns]
        assert "".join(out[s:e] for s, e, _, _ in spans) == out


def test_rewriting_template_is_detected():
    def forgetful(turns):  # shows the thoughts of the last assistant turn only
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]}</>" for i, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "think|yes"), ("user", "more"), ("assistant", "why|no")]
    assert located(forgetful, turns)[2]
    assert not located(forgetful, turns[:1])[2]

    def counted(turns):  # a header that changes with each turn
        return f"{len(turns)} turns: " + "".join(f"<{r}>{t}</>" for r, t in turns)

    out, spans, rewrites = located(counted, turns)
    assert rewrites and [out[s:e] for _, _, s, e in spans] == [t for _, t in turns]


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", "", ""), (1, 0, "user", "a", None, ""), (1, 1, "assistant", "b", "", ""), (2, None, None, None, "", ""), (None, 0, "assistant", "x", "", ""), (3, 0, "assistant", "long " * 100_000, "", "")]
    df = formatted_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chat_digest(df).collect()}
    assert {k: (v.n_turns, v.loss_chars) for k, v in got.items()} == {1: (3, 2), 2: (1, 0), None: (1, 1), 3: (1, 500_000)}
    assert formatted_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_has_the_hostile_conversation(spark):
    rows = op2_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()
    assert len(rows) == 1 and rows[0].n_turns == 2 and rows[0].loss_chars == len("</s>[INST] ok [/INST]")
