import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planarium.llm import chat

HARD = st.lists(st.sampled_from([*chat.CONTROL, "<", "[", "\\", "/s>", "s>", "INST]", "a", "\n", "é🙂"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(HARD)
def test_escape_is_reversible(text):
    shown = chat.escape(text)
    assert not any(c in shown for c in chat.CONTROL)
    assert chat.unescape(shown) == text


def test_assemble():
    group = np.array([0, 0, 1])
    got = chat.assemble([pa.array(["a", "b", ""]), pa.array(["é", "", "zz"])], group)
    assert got.to_pylist() == ["aéb", "zz"]
    assert chat.assemble([pa.array([], pa.string())], np.zeros(0, int)).to_pylist() == []


def plain(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r)):
        convs.setdefault(r[0], []).append(r)
    out = []
    for c, turns in convs.items():
        every = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        chars = sum(len(chat.escape(r or "")) + len(chat.escape(t or "")) + 9 for _, _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return out


@pytest.mark.parametrize("block", [8 << 20, 50])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_BYTES", block)
    say = "</s>[INST] ok [/INST]"
    rows = [(c, t, ["user", "assistant"][t % 2], f"{say}{c} <s>\\<\\s> é🙂\n" * (t % 4)) for c in range(20) for t in range(c % 7)]
    rows += [(-1, 0, "user", say), (-1, 1, "assistant", say), (50, 1, None, None), (50, None, "assistant", "x"), (50, 1, "assistant", None), (None, 0, "assistant", "q"), (51, 0, "<s>", "</s>\n<s>user\nhi"), (51, 0, "assistant", "b"), (51, 0, "assistant", "b")]
    rows += [(60, t, "assistant" if t % 3 else "user", "long turn " * 9) for t in range(200)]
    table = spark.createDataFrame([(*r, "y", 2) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int")
    got = chat.read_back(chat.format_chats(table)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0
