"""Chat formatting: exact round trips, masks and turn order."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pulseloom.llm import chat

T = chat.Template()
NASTY = st.lists(st.sampled_from(["<", "|", "turn", "|>", "\\", "<|turn|>", "<|body|>", "<|close|>", "<\\|turn|>", "é", "\n", "x"]), max_size=10).map("".join)


@given(NASTY)
def test_escape_is_reversible_and_hides_controls(text):
    escaped = T.escaped(text)
    assert T.plain(escaped) == text
    assert not any(c in escaped for c in T.controls)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_reader_gives_the_turns(turns):
    reader, found = chat.Reader(T), []
    for role, text in turns:
        for piece, _ in T.segments(role, text):
            found += reader.feed(piece)
    assert found == turns


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(turn="<\\x>")
    with pytest.raises(ValueError):
        chat.Template(turn="<a<")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows(spark):
    rows = [
        (1, 0, "user", "hi", "q"), (1, 1, "assistant", "\\<|close|> ok", "q"), (1, 2, "user", None, "q"),
        (2, 5, "assistant", "first", None), (2, 6, "user", "late", None),
        (None, None, "user", "a", None), (None, 1, "assistant", "b", None),
        (3, 1, "user", "same", None), (3, 1, "user", "same", None), (3, 2, None, "", None),
        (4, 0, "system", "s", None), (4, 1, "user", "u", None), (4, 2, "assistant", "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        r = got[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == sha("".join(f"{m[2] or ''}\n{m[3] or ''}\n" for m in mine))
        loss = "".join(m[3] or "" for m in mine if m[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(p) for m in mine for p, _ in T.segments(m[2] or "", m[3] or ""))
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, None: True, 3: False, 4: True}


def test_segments_mark_the_break(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    found = chat.format_turns(df).orderBy("segment").collect()
    assert [r.valid for r in found] == [True] * 3 + [False] * 6
    assert [r.text for r in found if r.trained] == ["c"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(df)).collect() == []
