from __future__ import annotations

import pandas as pd
import pytest

from callgauge.operators import judges, replies, scoring

PERFECT = dict(necessity=10, sel_correctness=10, sel_specificity=10, sel_completeness=10, completeness=10, name_accuracy=10,
               value_accuracy=10, type_compliance=10, format_compliance=10, relevancy=10)


def frame(spark, rows):
    columns = ["call_id", *PERFECT, "failures", "sequence_logic", "dependency_handling", "execution_efficiency", "ordered"]
    types = ", ".join(["call_id bigint", *[f"{c} double" for c in PERFECT], "failures array<string>",
                       "sequence_logic double, dependency_handling double, execution_efficiency double, ordered boolean"])
    data = []
    for i, change in enumerate(rows):
        row = {**PERFECT, "call_id": i, "failures": [], "sequence_logic": 10, "dependency_handling": 10, "execution_efficiency": 10, "ordered": False, **change}
        data.append(tuple(None if row[c] is None else float(row[c]) if c in PERFECT or c in columns[-4:-1] else row[c] for c in columns))
    return spark.createDataFrame(data, types)


def scores(spark, rows, verdicts=None):
    done = scoring.tool_calling(scoring.collapse(frame(spark, rows), verdicts), "ordered")
    return {r.call_id: r for r in done.collect()}


def test_collapse_and_average(spark):
    got = scores(spark, [
        {},
        {"name_accuracy": 2},
        {"value_accuracy": 1},
        {"failures": ["argument_name"]},
        {"failures": ["bad enum"]},
        {"failures": ["argument_completeness"]},
        {"relevancy": None, "name_accuracy": 0},
        {"necessity": 15, "completeness": -3},
        {"necessity": float("nan"), "relevancy": float("inf")},
        {"ordered": True, "sequence_logic": 0, "dependency_handling": 5},
        {"relevancy": None},
    ])
    assert got[0].overall == 1.0
    assert got[1].arguments == pytest.approx(0.2 / 6) and got[1].collapsed == "name" and got[1].failures == ["argument_name_collapse"]
    assert got[2].arguments == pytest.approx(2.2 / 6) and got[2].collapsed == "value"
    assert got[3].collapsed == "name" and got[4].collapsed == "value" and got[5].collapsed == "none"
    assert got[6].relevancy == 0.2
    assert (got[7].necessity, got[7].completeness) == (1.0, 0.0)
    assert (got[8].necessity, got[8].relevancy) == (0.0, 0.0)
    assert got[9].ordering == pytest.approx(0.5) and got[9].overall == pytest.approx(0.875)
    assert got[10].relevancy == 1.0 and got[10].ordering is None


def test_lint_verdicts_collapse(spark):
    verdicts = spark.createDataFrame([(0, True, True, 2), (1, False, True, 1)], "call_id bigint, name_fault boolean, value_fault boolean, n_violations bigint")
    got = scores(spark, [{}, {}, {}], verdicts)
    assert [got[i].collapsed for i in range(3)] == ["name", "value", "none"]


def test_collapse_never_raises_a_score(spark):
    rows = [{"name_accuracy": n, "value_accuracy": v, "relevancy": r} for n in (0, 2, 3, 10) for v in (0, 2, 3, 10) for r in (0, 2, 9)]
    before = {r.call_id: r.overall for r in scoring.tool_calling(frame(spark, rows)).collect()}
    after = scores(spark, rows)
    assert all(after[i].overall <= before[i] for i in before)


def test_spearman_with_ties(spark):
    both = spark.createDataFrame([(1, 0.1, 0.5), (2, 0.1, 0.7), (3, 0.9, 0.7), (4, 0.8, 0.9)], "call_id bigint, tc_a double, tc_b double")
    row = judges.spearman(both).first()
    a, b = pd.Series([0.1, 0.1, 0.9, 0.8]).rank(), pd.Series([0.5, 0.7, 0.7, 0.9]).rank()
    assert row.spearman == pytest.approx(a.corr(b), abs=1e-6)


@pytest.mark.parametrize("text,want", [
    ('{"status": "ok"}', '{"status":"ok"}'),
    ('   {"val": 123}   \n', '{"val":123}'),
    ('```json\n{"score": 9.5}\n```', '{"score":9.5}'),
    ('```\n{"score": 8.0}\n```', '{"score":8}'),
    ('Result:\n```json\n{\n  "nested": {"field": true}\n}\n```\nEnd.', '{"nested":{"field":true}}'),
    ('Here it is:\n{"corrected": true, "code": 200}\nHope this helps!', '{"code":200,"corrected":true}'),
    ('{"items": [1, 2, 3, ], "config": {"timeout": 30, }, }', '{"config":{"timeout":30},"items":[1,2,3]}'),
    ('[{"turn": 1}, {"turn": 2}]', '{"items":[{"turn":1},{"turn":2}]}'),
    ('["a", "b", "c", ]', '{"items":["a","b","c"]}'),
    ("true", '{"data":true}'),
    ("12345", '{"data":12345}'),
    ("This is pure english text with no json whatsoever.", None),
    ('{"unclosed_key": "val', None),
    ('prose [{"a":1}] prose', '{"a":1}'),
    ("", None),
])
def test_json_out_of_text(spark, text, want):
    rows = spark.createDataFrame([(text,)], "reply string")
    assert replies.with_json(rows, "reply").selectExpr("to_json(payload) AS p").first().p == want


def test_judge_errors_become_rows(spark):
    def judge(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "id bigint, prompt string")
    rows = {r.id: (r.reply, r.error) for r in replies.ask(prompts, judge, ["id"]).collect()}
    assert rows == {1: ("OK", None), 2: (None, "ValueError: no")}
