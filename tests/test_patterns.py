"""First matching patterns through the gram index against trying each pattern on each text."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from callgauge.operators import patterns, replies

WORDS = [f"{a}{b}{c}" for a in ("ta", "ke", "mi", "zo") for b in ("l", "rn", "st") for c in ("um", "a", "ix", "ow")]

HARD = [
    "", "a", "(?i)KELUM", r"\d+", r"a|b\.c", "[0-9]{3}", "kelum?", "kelum*x", "(kelum|talum)a", "(kelum)?", "mi+la", "zo.*ix", r"ke\.lum", r"\Qke.lum\E", r"\x41b",
    "ke(l(u(m(a(b)?)?)?)?)?", "[a[b]]kelum", "x{2}y", "^ta", "um$", "a{0,3}ke", "ke??lum", "talum++", r"\\d", "é+t", "😀?é", "p|", "(?:a|b)c|zo(?=st)", "$", ".", "^", "T.rnum", "|",
]
TEXTS = [
    "", "a", "kelum", "KELUM", "abc1234", "b.c", "keluuum", "ke.lum", "Ab", "xxy", "miiiila", "zo then ix", r"\d", "éét", "zost", "talumm", "nothing here", "talum kelum", "x" * 70_000 + "kelum",
    "line\nta", "T\nrnum", "pé😀 é", "a" * 9, "[0-9]{3}", "(kelum)?", "ke(l(u", None,
]


def plain(text, table):
    for priority, pattern, reply in sorted(table, key=lambda p: p[0]):
        if text is None or pattern is None:
            continue
        quoted = pattern.replace(r"\Q", "").replace(r"\E", "").replace(".", r"\.") if r"\Q" in pattern else pattern
        quoted = "[ab]kelum" if pattern == "[a[b]]kelum" else quoted  # a class inside a class is a union
        if pattern in text or re.search(quoted, text):
            return reply
    return None


def test_each_kind_of_pattern_alone(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc int, prompt string")
    for pattern in HARD:
        table = spark.createDataFrame([(1, pattern, "yes")], "priority int, pattern string, reply string")
        needed = patterns.required_grams(table).collect()
        # Where an alternative's grams are known, a text without any of them never matches.
        for text in TEXTS:
            if text is not None and plain(text, [(1, pattern, "yes")]):
                held = {r.alternative: [] for r in needed}
                for r in needed:
                    held[r.alternative].append(r.gram)
                assert any(all(g is None or g in text for g in own) for own in held.values()), (pattern, text)
    every = [(i, p, f"r{i}") for i, p in enumerate(HARD) if p not in ("", "|", "(kelum)?", ".", "^", "$", "p|", "a", "ke(l(u(m(a(b)?)?)?)?)?", "a|b\\.c", "a{0,3}ke")]
    table = spark.createDataFrame([*every, (900, None, "no")], "priority int, pattern string, reply string")
    got = {r.doc: r.reply for r in replies.replies_from_table(texts, table).collect()}
    assert got == {i: plain(t, every) for i, t in enumerate(TEXTS)}
    table = spark.createDataFrame([(2, "", "all"), (1, "kelum", "one")], "priority int, pattern string, reply string")
    got = {r.doc: r.reply for r in replies.replies_from_table(texts, table).collect()}
    assert got == {i: None if t is None else "one" if "kelum" in t else "all" for i, t in enumerate(TEXTS)}


def test_ten_thousand_patterns(spark):
    draw = random.Random(3)

    def phrase():
        return [draw.choice(WORDS) for _ in range(draw.randrange(2, 5))]

    made = []
    for i in range(10_000):
        words = phrase()
        form = i % 5
        text = " ".join(words) if form < 2 else r"\s+".join(words) if form == 2 else f"({words[0]}|{words[-1]}) {' '.join(words)}x?" if form == 3 else ".{1,3}".join(words)
        made.append((i, text, f"reply-{i}"))
    made[7777] = (7777, "[0-9]{2}", "digits")
    draw.shuffle(made)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(3, 14))) + draw.choice(["", " 42", "  x"]) for _ in range(120)]
    rows = [(i, t, "kept") for i, t in enumerate([*texts, *texts[:9], *[texts[0]] * 50])]
    table = spark.createDataFrame(made, "priority int, pattern string, reply string")
    frame = spark.createDataFrame(rows, "doc int, prompt string, extra string")
    out = replies.replies_from_table(frame, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    compiled = [(p, re.compile(p), r) for _, p, r in sorted(made)]
    known = {t: next((r for p, regex, r in compiled if p in t or regex.search(t)), None) for t in texts}
    assert out.columns == ["doc", "prompt", "extra", "reply"]
    assert {(r.doc, r.prompt, r.extra, r.reply) for r in out.collect()} == {(i, t, e, known[t]) for i, t, e in rows}
    # Candidates stay near the matches: the rarest gram, not any gram.
    texts_by_id = frame.select(F.md5("prompt").alias("id"), F.col("prompt").alias("text")).distinct()
    needed = patterns.required_grams(table).where("gram IS NOT NULL")
    candidates = patterns._indexed(texts_by_id, needed, [8, 4, 2]).count()
    assert candidates < len(known) * len(made) / 10


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, "a", "x")], "priority int, pattern string, reply string")
    texts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert replies.replies_from_table(texts.limit(0), table).count() == 0
    assert [r.reply for r in replies.replies_from_table(texts, table.limit(0)).collect()] == [None, None]
    longer = spark.createDataFrame([("b" * 200_000 + "needle in it",)], "prompt string")
    assert replies.replies_from_table(longer, spark.createDataFrame([(1, "needle", "x")], table.schema)).first().reply == "x"


def test_texts_give_out_the_grams_that_patterns_want(spark):
    """All wanted grams of each text, also over a cut and beyond the 16-bit characters, and hardly any other one."""
    draw = random.Random(9)
    held = ["", "a", "😀?é", "\x00b", *["".join(draw.choice("abcdé😀 ") for _ in range(n)) for n in (1, 7, 8, 9, 500, patterns.PIECE + 3, 2 * patterns.PIECE + 20)]]
    texts = spark.createDataFrame(list(enumerate(held)), "id int, text string")
    edge = held[-2][patterns.PIECE - 5 : patterns.PIECE + 3]
    want = {edge, "a", "é😀", "😀?", "ab", "\x00b", "abcd", held[8][40:48], held[9][100:104], "never", "zz"} - {"never"}
    wanted = spark.createDataFrame([(g,) for g in sorted(want)], "gram string")
    found = [(r.id, r.gram) for r in patterns._text_grams(texts, [8, 4, 2, 1], wanted).collect()]
    exact = {(i, g) for i, t in enumerate(held) for g in want if g in t}
    assert exact <= set(found)
    every = sum(len({t[i : i + n] for i in range(len(t) - n + 1)}) for t in held for n in (8, 4, 2, 1))
    assert len(set(found) - exact) <= 3 + every // 10_000
    assert all(g in held[i] for i, g in found)
