"""Chat formatting: the grammar's round trip, and digests against plain Python."""

from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from closebook.llm.chat import CONTROL, NULL_ROLE, escape, format_conversations, parse, read_conversations, render_turn, unescape

PIECES = [*CONTROL, "\\", "[", "<", "/", "a", " ", "\n", "[\\INST]", "s>", "/INST]", "é😀"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=7).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", NULL_ROLE, "[/TURN] x"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=4))
def test_round_trip(turns):
    rendered = "".join(render_turn(*t)[0] for t in turns)
    assert [t[:2] for t in parse(rendered)] == turns
    for _, text in turns:
        assert unescape(escape(text)) == text


def test_plain_text_stays_as_it_is():
    assert render_turn("user", "hello [there]")[0] == "<s>[INST] hello [there] [/INST]"


def test_not_of_the_grammar():
    assert parse("hello") is None and parse("<s>[INST] a") is None and parse(" a </s>b") is None


def test_table(spark):
    rnd = random.Random(1)
    rows = []
    for conv in [*range(20), None]:
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(9)))))
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>" * 3) for t in range(2000)]
    rows += [(51, 0, None, None), (51, 1, "assistant", None), (51, None, "assistant", "first"), (51, 1, "assistant", None)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    table = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS loss")
    formatted = format_conversations(table, chunk=5000)
    assert formatted.filter("conv_id = 50").count() > 5
    got = {r["conv_id"]: r for r in read_conversations(formatted).collect()}
    by = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or NULL_ROLE, r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert read_conversations(format_conversations(table.limit(0))).collect() == []


def test_hot_conversation_is_rendered_in_several_tasks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(4000)] + [(c, 0, "user", "x") for c in range(5)]
    formatted = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=500)
    tasks = formatted.filter("conv_id = 7").selectExpr("shiftright(part, 32) AS task").distinct().count()
    assert tasks > 1
    (row,) = read_conversations(formatted).filter("conv_id = 7").collect()
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:4000])
    assert (row["n_turns"], row["turns_sha256"]) == (4000, hashlib.sha256(whole.encode()).hexdigest())
