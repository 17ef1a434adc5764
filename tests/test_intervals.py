"""Bootstrap intervals against numpy, and the indicator table."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from callgauge.operators import gates, intervals


def plain_weights(keys, replicates):
    """Weights of every key in every replicate, from the digests and multipliers alone."""
    digests = [hashlib.md5(str(k).encode()).hexdigest() for k in keys]
    h = [int(d[:8], 16) % intervals.PRIME for d in digests]
    g = [int(d[8:16], 16) % intervals.PRIME for d in digests]
    marks = intervals.thresholds()
    out = np.ones((replicates + 1, len(keys)), dtype=np.int64)
    for r, (a, b, c) in enumerate(intervals.multipliers(replicates), 1):
        for i in range(len(keys)):
            out[r, i] = sum((a * h[i] + b * g[i] + c) % intervals.PRIME >= t for t in marks)
    return out


def test_draws_are_poisson():
    counts = plain_weights(range(3000), 30)[1:]
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.05
    assert abs((counts == 0).mean() - np.exp(-1)) < 0.01
    # Cases are independent of each other within a replicate: the total's variance is the number of cases.
    assert 0.4 < plain_weights(range(500), 300)[1:].sum(axis=1).var() / 500 < 1.8


def test_intervals_equal_numpy(spark):
    rng = np.random.default_rng(5)
    n, replicates = 300, 60
    kind = np.where(rng.random(n) < 0.6, "correct", "broken")
    tc = np.round(np.clip(rng.normal(np.where(kind == "correct", 0.9, 0.6), 0.2), 0, 1), 4)
    rows = [(i, "a", str(kind[i]), float(tc[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "call_id bigint, judge string, kind string, tc double")
    got = intervals.judge_intervals(frame.repartition(3), ["judge"], 0.9, replicates).first()
    w = plain_weights(range(n), replicates)
    mean = lambda r, k: (w[r] * tc * (kind == k)).sum() / (w[r] * (kind == k)).sum()
    gap = np.array([mean(r, "correct") - mean(r, "broken") for r in range(replicates + 1)])
    passed = np.array([(w[r] * ((kind == "broken") & (tc >= 0.9))).sum() / (w[r] * (kind == "broken")).sum() for r in range(replicates + 1)])
    for name, values in (("gap", gap), ("false_pass", passed)):
        assert got[name] == pytest.approx(values[0], abs=1e-6)
        assert got[f"{name}_low"] == pytest.approx(np.quantile(values[1:], 0.025), abs=1e-6)
        assert got[f"{name}_high"] == pytest.approx(np.quantile(values[1:], 0.975), abs=1e-6)
    assert got.gap_low < got.gap < got.gap_high


def test_correlation_interval_equals_numpy(spark):
    rng = np.random.default_rng(6)
    a = np.round(rng.random(200), 4)
    b = np.round(np.clip(a + rng.normal(0, 0.2, 200), 0, 1), 4)
    both = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(200)], "call_id bigint, tc_a double, tc_b double")
    got = intervals.agreement_intervals(both, 40).first()
    w = plain_weights(range(200), 40)
    values = []
    for weights in w:
        cov = np.cov(a, b, aweights=weights, ddof=0)
        values.append(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))
    assert got.pearson == pytest.approx(values[0], abs=1e-6)
    assert got.pearson_low == pytest.approx(np.quantile(values[1:], 0.025), abs=1e-6)
    assert got.pearson_high == pytest.approx(np.quantile(values[1:], 0.975), abs=1e-6)


def test_empty_null_and_one_sided_groups(spark):
    schema = "call_id bigint, judge string, kind string, tc double"
    assert intervals.judge_intervals(spark.createDataFrame([], schema), ["judge"], 0.9, 10).collect() == []
    rows = [(1, "a", "correct", 0.5), (None, "a", "correct", 0.7), (2, "b", "broken", None), (3, None, "broken", 1.0)]
    got = {r.judge: r for r in intervals.judge_intervals(spark.createDataFrame(rows, schema), ["judge"], 0.9, 10).collect()}
    assert got["a"].gap is None and got["a"].false_pass is None  # no broken case to compare with
    assert got["b"].gap is None and got["b"].false_pass == 0.0
    assert got[None].false_pass == 1.0


def test_indicator_states(spark):
    values = [
        ("false_pass_rate", "a", 0.0), ("false_pass_rate", "b", 0.01), ("discrimination_gap", "a", 0.19), ("discrimination_gap", "b", 0.2),
        ("discrimination_gap", "c", 0.17), ("judge_correlation", "all", None), ("grounding_ratio", "all", 0.75), ("of no mark", "all", 1.0),
    ]
    got = {(r.indicator, r.scope): r.state for r in gates.indicators(spark.createDataFrame(values, "indicator string, scope string, value double")).collect()}
    assert got == {
        ("false_pass_rate", "a"): "met", ("false_pass_rate", "b"): "alert", ("discrimination_gap", "a"): "short", ("discrimination_gap", "b"): "met",
        ("discrimination_gap", "c"): "alert", ("judge_correlation", "all"): "unknown", ("grounding_ratio", "all"): "short",
    }


def test_replicates_make_no_rows_before_they_are_summed(spark):
    rows = spark.range(5000).selectExpr("id AS call_id", "IF(id % 2 = 0, 'a', NULL) AS kind", "999999999999999999 - id AS v")
    made = intervals.resampled(rows, ["kind"], "IF(call_id < 10, NULL, call_id)", {"n": "1", "v": "v"}, replicates=3)
    assert "explode" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.kind, r.replicate): (int(r.n), int(r.v)) for r in made.collect()}
    assert len(got) == 8
    assert got["a", 0] == (2500, sum(999999999999999999 - i for i in range(0, 5000, 2)))
    assert got[None, 0] == (2500, sum(999999999999999999 - i for i in range(1, 5000, 2)))
