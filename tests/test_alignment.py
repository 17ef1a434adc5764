"""Edit scripts against the full table of distances."""

from __future__ import annotations

import random

import pytest

from callgauge.operators import alignment

EXPECTED = "transcript_id bigint, step_index int, tool_name string"
EMITTED = "transcript_id bigint, call_index int, tool_name string"
OPS = {"K": "keep", "R": "replace", "D": "delete", "I": "insert"}


def plain_script(e, g):
    cost = [[0] * (len(g) + 1) for _ in range(len(e) + 1)]
    for i in range(len(e) + 1):
        for j in range(len(g) + 1):
            if i and j:
                cost[i][j] = min(cost[i - 1][j - 1] + (e[i - 1] != g[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
            else:
                cost[i][j] = i + j
    i, j, ops = len(e), len(g), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (e[i - 1] != g[j - 1]):
            i, j = i - 1, j - 1
            ops.append(("keep" if e[i] == g[j] else "replace", i, j, e[i], g[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            ops.append(("delete", i, None, e[i], None))
        else:
            j -= 1
            ops.append(("insert", None, j, None, g[j]))
    return [(n, *op) for n, op in enumerate(reversed(ops))]


def scripts(spark, pairs, band=alignment.BAND):
    expected = [(t, 10 * i, x) for t, (e, _) in enumerate(pairs) for i, x in enumerate(e)]
    emitted = [(t, 5 + i, x) for t, (_, g) in enumerate(pairs) for i, x in enumerate(g)]
    random.Random(1).shuffle(expected)
    rows = alignment.workflow_script(spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(emitted, EMITTED), band).collect()
    found = {t: [] for t in range(len(pairs))}
    for r in rows:
        found[r.transcript_id].append(tuple(r)[1:])
    return [sorted(found[t]) for t in range(len(pairs))]


def test_hand_cases(spark):
    pairs = [
        (["make", "clip", "mix"], ["make", "clip", "mix"]),
        (["make", "clip", "mix"], ["look", "make", "clip", "mix"]),  # one extra call shifts all
        (["make", "clip", "mix"], ["make", "mix"]),
        (["make", "clip", "mix"], ["make", "song", "mix"]),
        ([], ["make"]),
        (["make", None], []),
        ([None, "a"], [None, "b"]),
    ]
    found = scripts(spark, pairs)
    assert [op[1] for op in found[1]] == ["insert", "keep", "keep", "keep"]
    assert [op[1] for op in found[2]] == ["keep", "delete", "keep"]
    assert [op[1] for op in found[3]] == ["keep", "replace", "keep"]
    assert found == [plain_script(e, g) for e, g in pairs]


@pytest.mark.parametrize("band", (0, 2, 50))
def test_equals_the_full_table(spark, band):
    draw = random.Random(band)
    pairs = []
    for _ in range(150):
        e = [draw.choice("abc") for _ in range(draw.randrange(0, 14))]
        g = [x for x in e if draw.random() > 0.2]
        for _ in range(draw.randrange(0, 6)):
            g.insert(draw.randrange(len(g) + 1), draw.choice("abcd"))
        pairs.append((e, g if draw.random() < 0.8 else [draw.choice("abc") for _ in range(draw.randrange(0, 14))]))
    assert scripts(spark, pairs, band) == [plain_script(e, g) for e, g in pairs]


def test_long_lists_stay_in_a_narrow_band(spark):
    draw = random.Random(8)
    e = [draw.choice("abcdefgh") for _ in range(1500)]
    g = e[:200] + ["x"] + e[200:900] + e[903:1400] + ["y", "y"] + e[1400:]
    lists = spark.createDataFrame([(1, e, g)], "transcript_id bigint, e array<string>, g array<string>")
    row = alignment.edit_scripts(lists).first()
    assert row.cost == 6 and len(row.ops) == 1503 and sum(o.op == "keep" for o in row.ops) == 1497


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], EXPECTED), spark.createDataFrame([(1, 0, "a")], EMITTED)
    assert alignment.workflow_script(none, some.limit(0)).count() == 0
    assert [r.op for r in alignment.workflow_script(none, some).collect()] == ["insert"]
