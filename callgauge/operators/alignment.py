"""Edit scripts between expected and emitted workflows.

The two step lists of a transcript are aligned by edit distance: keep, replace, delete (an expected step is missing) and insert
(an extra call), the last three at cost 1. The table of distances is a fold over the expected steps that holds one row
of it, only cells within a band around the diagonal, and one text of directions for each row. A distance of at
most the band's half width proves that no cheaper script leaves the band; the other transcripts are folded again in
a wider one. Everything is SQL expressions over arrays.

A transcript's two step lists are one row, so they are held by one task, with memory of their length times the band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.session import saved

BAND = 4
WIDER = 4
_FAR = 1 << 30


def step_lists(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """(transcript_id, e, g): tools of both sides in order, an empty list where a side has no step."""

    def listed(steps: DataFrame, order: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "tool_name")))
        return steps.groupBy("transcript_id").agg(F.transform(ordered, lambda s: s["tool_name"]).alias(name))

    both = listed(expected, "step_index", "e").join(listed(emitted, "call_index", "g"), "transcript_id", "full")
    return both.selectExpr("transcript_id", "coalesce(e, array()) AS e", "coalesce(g, array()) AS g")


def _folded(lists: DataFrame) -> DataFrame:
    """Adds ``cost`` and ``dirs`` for the band of half width ``k``; cell c of row i stands for the first i expected and i + c - k emitted steps."""
    top = (
        f"transform(sequence(0, 2 * k), c -> CASE WHEN c < k OR c - k > size(g) THEN {_FAR} ELSE c - k END)"
    )
    top_dirs = "concat(repeat('.', k), 'S', repeat('I', k))"
    # Of equal costs a step on the diagonal comes first, then a delete, then an insert.
    step = (
        "CASE WHEN i + c - k < 0 OR i + c - k > size(g) THEN named_struct('v', {far}, 'o', 0, 'd', '.')"
        " ELSE array_min(array("
        "  named_struct('v', CASE WHEN i + c - k = 0 THEN {far} WHEN e[i - 1] <=> g[i + c - k - 1] THEN acc.row[c] ELSE acc.row[c] + 1 END, 'o', 0,"
        "    'd', CASE WHEN i + c - k > 0 AND e[i - 1] <=> g[i + c - k - 1] THEN 'K' ELSE 'R' END),"
        "  named_struct('v', CASE WHEN c = 2 * k THEN {far} ELSE acc.row[c + 1] + 1 END, 'o', 1, 'd', 'D'),"
        "  named_struct('v', line.last + 1, 'o', 2, 'd', 'I'))) END"
    ).format(far=_FAR)
    line = (
        f"aggregate(sequence(0, 2 * k), named_struct('last', {_FAR}, 'row', CAST(array() AS array<int>), 'dirs', ''),"
        f" (line, c) -> aggregate(array({step}), line, (l, s) -> named_struct('last', least(s.v, {_FAR}), 'row', concat(l.row, array(least(s.v, {_FAR}))), 'dirs', concat(l.dirs, s.d))))"
    )
    table = (
        f"aggregate(sequence(1, size(e)), named_struct('row', {top}, 'dirs', array({top_dirs})),"
        f" (acc, i) -> aggregate(array({line}), acc, (a, l) -> named_struct('row', l.row, 'dirs', concat(a.dirs, array(l.dirs)))))"
    )
    table = f"CASE WHEN size(e) = 0 THEN named_struct('row', {top}, 'dirs', array({top_dirs})) ELSE {table} END"
    return lists.selectExpr("*", f"{table} AS t").selectExpr("* EXCEPT (t)", "t.row[size(g) - size(e) + k] AS cost", "t.dirs AS dirs")


# The way back from the last cell: (steps of e left, steps of g left, script so far).
_SCRIPT = """
aggregate(
  CASE WHEN size(e) + size(g) = 0 THEN CAST(array() AS array<int>) ELSE sequence(1, size(e) + size(g)) END,
  named_struct('i', size(e), 'j', size(g), 'ops', CAST(array() AS array<struct<op: string, i: int, j: int>>)),
  (at, n) -> CASE WHEN at.i = 0 AND at.j = 0 THEN at ELSE aggregate(
    array(substring(dirs[at.i], at.j - at.i + k + 1, 1)), at, (a, d) -> named_struct(
      'i', CASE WHEN d = 'I' THEN a.i ELSE a.i - 1 END,
      'j', CASE WHEN d = 'D' THEN a.j ELSE a.j - 1 END,
      'ops', concat(array(named_struct('op', CASE d WHEN 'K' THEN 'keep' WHEN 'R' THEN 'replace' WHEN 'D' THEN 'delete' ELSE 'insert' END, 'i', a.i, 'j', a.j)), a.ops))) END,
  at -> at.ops)
"""


def edit_scripts(lists: DataFrame, band: int = BAND) -> DataFrame:
    """(transcript_id, cost, n_expected, n_called, ops) of ``step_lists``; ops is an array of (op, i, j), i and j counted from 1.

    i and j are the last steps of both sides that are used up after the operation. Steps are equal if their tools are,
    null tools too. Of several cheapest scripts it is the one that, from the end, stays on the diagonal, else deletes,
    else inserts.
    """
    # Steps that differ at the same place, with the difference in length, are a script: no wider band is needed.
    apart = "size(filter(zip_with(slice(e, 1, least(size(e), size(g))), slice(g, 1, least(size(e), size(g))), (x, y) -> NOT (x <=> y)), z -> z))"
    longer = "abs(size(e) - size(g))"
    todo = lists.selectExpr("*", f"{longer} + least({apart}, {int(band)}) AS k")
    done = []
    while True:
        folded = saved(_folded(todo), "edit-tables")
        done.append(folded.where("cost <= k").selectExpr("transcript_id", "cost", "size(e) AS n_expected", "size(g) AS n_called", f"{_SCRIPT} AS ops"))
        rest = folded.where("cost > k")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = rest.selectExpr("transcript_id", "e", "g", f"least(greatest(size(e), size(g)), {WIDER} * k + {longer} + 1) AS k")


def workflow_script(expected: DataFrame, emitted: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each operation: transcript_id, op_index (from 0), op, expected_index, call_index, expected_tool, called_tool.

    expected: transcript_id, step_index, tool_name; emitted: transcript_id, call_index, tool_name. The indexes of the
    output count the steps of each list from 0; they and the tool are NULL on the side an operation does not use.
    """
    lists = saved(step_lists(expected, emitted), "step-lists")
    scripts = edit_scripts(lists, band).join(lists, "transcript_id")
    rows = scripts.select("transcript_id", "e", "g", F.posexplode("ops").alias("op_index", "o"))
    return rows.selectExpr(
        "transcript_id", "op_index", "o.op AS op",
        "CASE WHEN o.op <> 'insert' THEN o.i - 1 END AS expected_index", "CASE WHEN o.op <> 'delete' THEN o.j - 1 END AS call_index",
        "CASE WHEN o.op <> 'insert' THEN e[o.i - 1] END AS expected_tool", "CASE WHEN o.op <> 'delete' THEN g[o.j - 1] END AS called_tool",
    )
