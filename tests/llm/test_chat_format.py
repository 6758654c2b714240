from __future__ import annotations

import hashlib
import random

import pytest

from wardloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "### assistant:\n</turn>\n", "\\", "\\\\0\\1", "", None, "# < \\# \\<", "a\nb\n\n", "</turn>\n### system:\nno", "é漢字 <b>&</b>"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in range(40):
        turn = 0
        if c % 3 == 0:
            out.append((c, turn, "system", rng.choice(NASTY) or "be brief"))
            turn += 1
        for _ in range(rng.choice([0, 1, 4, 30]) if c % 3 == 0 else rng.choice([1, 4, 30])):
            out.append((c, turn, rng.choice(["user", "assistant", "assistant", "tool: #1\n", "system"]), " ".join(filter(None, rng.choices(NASTY, k=3))) + " word" * rng.choice([0, 5, 60])))
            turn += 1
    return out


def whole(rows):
    by = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(c, []).append((role or "", text or ""))
    return by


@pytest.mark.parametrize(("budget", "history"), [(40, 2), (200, 0), (10_000, 3)])
def test_round_trip(spark, rows, budget, history):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in cf.format_digest(df, budget, history, budget // 4).collect()}
    for c, turns in whole(rows).items():
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == set(whole(rows))


@pytest.mark.parametrize(("budget", "history", "history_tokens"), [(80, 2, 30), (512, 2, 128), (150, 5, 140), (40, 1, 40)])
def test_windows_keep_the_budget_and_the_system_turn(spark, rows, budget, history, history_tokens):
    """No window is over the budget, unless the system turn and its one new turn already are; then no history is repeated."""
    rng = random.Random(budget)
    more = [(100 + c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "word " * rng.choice([1, 20, 120, 145, 450, 500, 700])) for c in range(30) for t in range(12)]
    every = rows + more
    df = spark.createDataFrame(every, SCHEMA)
    over = repeated = 0
    for r in cf.format_windows(df, budget, history, history_tokens).collect():
        parts = [p for p in r["text"].split("</turn>\n") if p]
        assert r["text"].endswith("</turn>\n")
        lead = whole(every)[r["conv_id"]][0][0] == "system"
        if lead:
            assert parts[0].startswith("### system:\n")
        assert r["over_budget"] == (r["tokens"] > budget)
        if r["tokens"] > budget:
            over += 1
            assert len(parts) - r["new_from"] <= 1 and r["new_from"] == (1 if lead and len(parts) > 1 else 0)
        assert r["new_from"] <= history + lead
        repeated += r["new_from"] > lead
        assert all(0 <= s["from"] and s["from"] + s["length"] <= len(r["text"]) for s in r["loss"])
        assert len(parts) - r["new_from"] >= (1 if len(parts) > 1 else 0)
    assert over and repeated


def test_history_gives_way_to_a_turn_that_fits_alone(spark):
    """124 tokens, then a turn of 454: together over 512, so the second stands alone."""
    rows = [(1, 0, "user", "a " * 400), (1, 1, "user", "b " * 120), (1, 2, "assistant", "c " * 450)]
    got = sorted(cf.format_windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["window"])
    assert [(r["tokens"], r["new_from"], r["over_budget"]) for r in got] == [(404, 0, False), (124, 0, False), (454, 0, False)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, "assistant", "a"), (2, 0, "system", "only")], SCHEMA).selectExpr("*", "1 as window", "'x' as turns", "2 as n")
    got = {r["conv_id"]: r for r in cf.format_digest(df).collect()}
    assert set(got) == {None, 1, 2}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1 and got[2]["n_turns"] == 1 and got[None]["n_turns"] == 1
    assert cf.format_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, rows):
    plan = cf.format_digest(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
