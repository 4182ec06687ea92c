"""Queries that must not leave out a part of their job."""

from __future__ import annotations

import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Conversations of seven turns each."""
    d = str(tmp_path_factory.mktemp("talks"))
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for c in range(4) for t in range(7)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_a_prompt_lists_every_source(spark, talks):
    got = {r.ticket_id: r.user_message for r in E.queries()["build_answer_prompt"](spark, talks).collect()}
    for c in range(4):
        assert got[c].startswith("Sources:\n" + "".join(f"Source {t - 1}:\nc{c} t{t}\n\n" for t in range(1, 7)) + "Support ticket:\n")


def test_an_answer_is_judged_with_all_contexts(spark, talks):
    got = {r.ticket_id: r.contexts for r in E.queries()["answer_eval_set"](spark, talks).collect()}
    assert got and all(v == [f"c{c} t{t}" for t in range(1, 7)] for c, v in got.items())


def test_only_valid_predictions_are_scored(spark, monkeypatch):
    from ticketlake.sources import logical as lg
    good = '{"predicted_category": "Refund request", "predicted_priority": "Low", "confidence_score": 0.7, "routing_action": "suggest"}'
    raw = [good, '{"predicted_category": "Refund request", "confidence_score": 0.7}', '<think>cut', 'no json']
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raw)], "ticket_id long, attempt long, raw string")
    monkeypatch.setattr(lg, "class_completions", lambda spark, sf: df)
    got = {r.ticket_id: (r.predicted_category, r.confidence_score, r.tier_used, r.failed, r.error)
           for r in E.queries()["score_with_errors"](spark, "").collect()}
    assert got == {0: ("Refund request", 0.7, "groq", False, None), 1: ("", 0.0, "error", True, "invalid prediction"),
                   2: ("", 0.0, "error", True, "empty response"), 3: ("", 0.0, "error", True, "invalid prediction")}
