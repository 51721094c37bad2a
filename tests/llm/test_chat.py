"""Chat formatting: against a plain Viterbi, and one result whatever the blocks and partitions."""

import brute
import numpy as np
import pytest

from corvid.llm import chat

SCHEMA = "conv_id long, turn long, text string"
KINDS = ["User: x", "AI: y", "plain", "what?", "Speaker: z", "", "System: s", "w" * 500, "### Assistant:", "[USER] hello?"]


def _all(df, **options):
    return sorted(map(tuple, chat.parsed(df, **options).collect()), key=str)


def test_defined_cases(spark):
    rows = [(1, 0, "User: hi\nthere?"), (1, 1, "Assistant: yes\n\nmore  "), (1, 1, "Assistant: yes\n\nmore  "), (2, 0, None), (None, 0, "Human: a"), (3, None, "no marker"), (4, 0, "Speaker 1: hello?\nSpeaker 2: hello.\nSpeaker 1: bye?")]
    got = sorted((r.conv_id or 0, r.turn or 0, r.line, r.role, r.rendered) for r in chat.parsed(spark.createDataFrame(rows, SCHEMA)).collect())
    twice = (1, 1, 0, "assistant", "<|assistant|>\nyes\n\nmore\n<|end|>\n")
    assert got[1:4] == [(1, 0, 0, "user", "<|user|>\nhi\nthere?\n<|end|>\n"), twice, twice]
    assert [role for i, _, line, role, _ in got if i == 4] == ["user", "assistant", "user"]
    assert len(got) == 9


def test_plain_viterbi():
    rng, hmm = np.random.default_rng(4), chat.Viterbi()
    for _ in range(60):
        lines = [x for k in range(rng.integers(1, 25)) for x in chat.lines_of(str(rng.choice(KINDS)))]
        e = hmm.scores(lines)
        score, want = brute.viterbi([x[:2] for x in lines], hmm.model)
        got = [(s % 3, s < 3) for s in hmm.decode(e)]
        path = [s[0] + 3 * (not s[1]) for s in want]
        total = lambda p: hmm.first[p[0]] + e[0][p[0]] + sum(hmm.trans[a, b] + x[b] for a, b, x in zip(p, p[1:], e[1:], strict=False))
        assert got == want or abs(total(path) - total([r + 3 * (not new) for r, new in got])) <= 2 * len(lines)  # a tie but for rounding
        assert abs(total(path) / chat.SCALE - score) < 1e-3


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("block", [1, 7, 50])
def test_blocks_change_nothing(spark, parts, block):
    rng = np.random.default_rng(5)
    rows = [(1, k, str(rng.choice(KINDS))) for k in range(300)]
    rows += [(2, k, "AI: one\n" + "\n".join(rng.choice(KINDS, 40))) for k in range(3)]
    rows += [(None, None if k % 3 else 0, f"{rng.choice(['User: ', 'AI: ', 'Speaker: ', '', 'also '])}{k % 50:03d}{rng.choice(['', '?'])}") for k in range(200)]
    rows += [(k, 0, f"User: {k}") for k in range(4, 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert _all(df, block=block) == _all(df, block=100_000)


def test_two_turns_of_forty_lines(spark):
    df = spark.createDataFrame([(1, k, "User: a" if not k else "AI: b" if k == 1 else "more") for k in range(40)], SCHEMA)
    for block in (7, 4096):
        assert [(r.turn, r.n_lines) for r in sorted(chat.parsed(df, block=block).collect(), key=lambda r: r.turn)] == [(0, 1), (1, 39)]


def test_one_text_of_very_many_lines(spark):
    text = "User: a\n" + "\n".join(f"x{k}" for k in range(30_000)) + "\nAssistant: b"
    df = spark.createDataFrame([(1, 0, text)], SCHEMA)
    got = sorted(chat.parsed(df).collect(), key=lambda r: r.line)
    assert [(r.line, r.role, r.n_lines) for r in got] == [(0, "user", 30_001), (30_001, "assistant", 1)]
    assert got[0].rendered == "<|user|>\n" + text[6 : -len("\nAssistant: b")] + "\n<|end|>\n"


def test_equal_lines_all_count(spark):
    df = spark.createDataFrame([(1, None, t) for t in ("User: a", "User: a", "AI: b", "AI: b")], SCHEMA)
    assert len(chat.parsed(df).collect()) == len(chat.parsed(df, block=2).collect()) == 4
