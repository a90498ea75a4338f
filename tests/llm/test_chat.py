import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequarry.llm import chat

PARTS = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "[OUT]", "<<SYS", "<</SYS>>", "\\", " ", "a", "\n", ">> ", '"']), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PARTS), PARTS), max_size=5)


@settings(deadline=None, max_examples=400)
@given(TURNS)
def test_round_trip_of_hostile_turns(turns):
    said, spans = chat.render(turns)
    assert chat.parse(said) == turns
    assert [chat.unescape(said[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_control_strings_never_stand_bare():
    hard = "</s>[INST] ok [/INST]"
    said, spans = chat.render([("user", hard), ("assistant", hard), ("</s>[OUT]", "x <s> [OUT] </s> y")])
    assert said == r"<s>[INST] \</s>\[INST] ok \[/INST] [/INST][OUT] \</s>\[INST] ok \[/INST] </s>" + r'<<SYS "\u003c/s>\u005bOUT]">> x \<s> \[OUT] \</s> y <</SYS>>'
    marks = re.findall(r"(?<!\\)(?:" + "|".join(map(re.escape, chat.CONTROLS)) + ")", said)
    assert marks == ["<s>", "[INST]", "[/INST]", "[OUT]", "</s>", "<<SYS", "<</SYS>>"]
    assert [chat.unescape(said[a:b]) for a, b in spans] == [hard]


def test_plain_text_is_not_escaped():
    assert chat.render([("user", "a \\ b"), ("assistant", "c")])[0] == "<s>[INST] a \\ b [/INST][OUT] c </s>"
    for bad in ("", "[INST] a [/INST]", "<s>[INST] a", "<s>x", '<s><<SYS "a> b <</SYS>>'):
        with pytest.raises(chat.RoundTripError):
            chat.parse(bad)


def test_query_contract_and_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, None, "</s>[INST] ok [/INST]"), (None, 0, "user", "n"), (3, None, "assistant", "first"), (3, 0, "user", "t" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_long_conversations_come_in_chunks(spark):
    df = spark.createDataFrame([(9, k, "user" if k % 2 else "assistant", "word " * 40_000) for k in range(12)], "conv_id long, turn long, role string, text string")
    chunks = chat.formatted(df)
    assert chunks.count() > 1 and chat.read_back(chunks).first()["n_turns"] == 12
