"""Periodic runs, hard negatives and license scan against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from callgauge.llm import licenses, negatives, queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(text):
    """Every run by trying each period at each place."""
    n, found = len(text), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            begin = i
            while i + q < n and text[i] == text[i + q]:
                i += 1
            length = i + q - begin
            part = text[begin : i + q]
            smallest = all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                found.append((begin, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(1500):
        kinds = draw.choice([1, 2, 3, 4])
        text = [draw.choice("abcd"[:kinds]).encode() for _ in range(draw.randrange(0, 60))]
        if draw.random() < 0.6 and len(text) > 4:
            at, unit = draw.randrange(len(text)), draw.randrange(1, 8)
            text = text[:at] + (text[at : at + unit] * 60)[: draw.randrange(1, 40)] + text[at:]
        expected = plain_runs(text)
        assert runs.find_runs(text) == expected
        if text:  # the trees alone, on the whole text, without cutting stretches first
            number = {w: i for i, w in enumerate(dict.fromkeys(text))}
            rows = runs.stretch_runs(np.array([number[w] for w in text]))
            assert sorted(map(tuple, rows.tolist()), key=lambda r: (r[0], r[2])) == expected


def test_suffix_tree_extensions():
    draw = random.Random(7)
    for _ in range(100):
        text = [draw.randrange(1, 4) for _ in range(draw.randrange(2, 40))]
        tree = runs.SuffixTree(text)
        pairs = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text))]
        i, j = np.array(pairs).T
        expected = []
        for a, b in pairs:
            k = 0
            while b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            expected.append(k)
        assert tree.common(i, j).tolist() == expected
        order = sorted(range(len(text) + 1), key=lambda k: text[k:])
        assert [order[r] for r in sorted(tree.ranks())] == order and [tree.ranks()[k] for k in order] == list(range(len(text) + 1))
        mirrored = sorted(range(len(text) + 1), key=lambda k: [-x for x in text[k:]])
        assert [tree.ranks(True)[k] for k in mirrored] == list(range(len(text) + 1))


def test_many_words_of_one_kind_are_linear():
    text = [b"a"] * 60_000
    assert runs.find_runs(text) == [(0, 60_000, 1)]
    text = [f"w{i % 5000}".encode() for i in range(50_000)]
    assert runs.find_runs(text) == [(0, 50_000, 5000)]


def plain_report(key, text):
    own = (text or "").encode().split()
    if key is not None and own:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(own)
            p = 1 + (len(own) - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(len(own))]
    found = plain_runs(own)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_report_on_a_table(spark):
    rows = [(i, " ".join(random.Random(i).choice("ab c d".split()) for _ in range(i))) for i in range(120)]
    rows += [(None, "x " * 9), (3, None), (4, ""), (4, ""), (5, " a  \t\n"), (6, "na " * 50), (6, "na " * 50)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = [tuple(r) for r in runs.report(docs).collect()]
    assert sorted(got, key=repr) == sorted((plain_report(*r) for r in rows), key=repr)
    assert runs.report(docs.limit(0)).count() == 0
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.report(docs).columns == columns


def test_run_query_on_small_documents(spark):
    found = {r.doc_id: tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, SF).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len(found) == len(texts)
    for key, text in texts:
        if len((text or "").split()) <= 400:
            assert found[key] == plain_report(key, text)


def test_strassen_is_exact():
    draw = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (17, 64, 33), (40, 65, 51), (128, 64, 257), (3, 0, 4), (100, 100, 100)):
        a, b = draw.integers(-(2**20), 2**20, (m, k)), draw.integers(-(2**20), 2**20, (k, n))
        assert (negatives.strassen(a, b, 8) == a @ b).all()


def plain_negatives(rows, every=10, positives=3, size=4):
    rows = list(dict.fromkeys((i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v))
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in rows]
        for s, j in sorted({(s, j) for s, j, other in sorted(x for x in scored if x[2] == lab and x[1] != i)[:positives]}):
            fits = sorted((t, k) for t, k, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fits[:size], start=1)]
    return sorted(out)


@pytest.mark.parametrize("small", (False, True))
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many cells and tiles
        for name, value in (("CELL_ANCHORS", 3), ("CELL_CANDIDATES", 20), ("TILE_ANCHORS", 2), ("TILE_CANDIDATES", 7)):
            monkeypatch.setattr(negatives, name, value)
    draw = random.Random(11)
    rows = [(i, draw.randrange(3), [draw.randrange(-4, 9) for _ in range(6)]) for i in range(150)]
    rows += [(200, 1, [9, 9, 9, 9, 9, 9]), (201, 1, [9, 9]), (None, 1, [1]), (202, None, [1]), (203, 1, None), (204, 0, [1, None]), (205, 2, [])]
    rows += [rows[5], rows[20], (33, 0, [1, 1, 1, 1, 1, 1])]  # repeated rows, and an id with two different vectors
    rows += [(k, 2, [1, 1, 1, 1, 1, 1]) for k in range(300, 320)]  # ties
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, vector array<long>, row int")
    got = negatives.mine(table, "vec_id % 10 = 0", positives=3, negatives=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert negatives.mine(table.limit(0)).count() == 0


def test_negatives_refuse_scores_beyond_64_bits(spark):
    table = spark.createDataFrame([(0, 1, [2**40, 1])], "vec_id long, label int, vector array<long>")
    with pytest.raises(Exception, match="too large"):
        negatives.mine(table).count()


def test_prepared_vectors(spark):
    rows = [(7, 9, [0.5, -0.001]), (8, 9, [1.0, float("nan")]), (9, None, [float("inf"), 1.0]), (10, 3, [None, 1.0]), (11, 2, None), (14, None, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = [tuple(r) for r in negatives.prepared_vectors(table).orderBy("vec_id").collect()]
    assert got == [(7, 0, [128, -1]), (8, 9, None), (9, None, None), (10, 3, None), (11, 2, None), (14, None, [])]


def plain_words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 0x80:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def plain_scan(text, templates=licenses.TEMPLATES):
    own = plain_words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    step, labels, best = max(len(t.text.split()) for t in templates), set(base), 0.0
    for i in range(0, len(own), step):
        block = set(own[i : i + 2 * step])
        for t in templates:
            need = set(t.text.split())
            if len(need & block) >= t.share * len(need) - 1e-9:
                labels.add(t.label)
                best = max(best, len(need & block) / len(need))
    places.sort()
    return len(own), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def license_texts():
    draw = random.Random(2)
    texts = [None, "", "  \n", "Released under the MIT License.", "cc BY-NC cc-by-nc", "under the mit\nlicense under, the MIT licenses", "Apache License, Version 2.0", "Éa ünder the mit license"]
    filler = "the of and license software terms public under any to this free".split()
    for t in licenses.TEMPLATES:
        for cut in (0, 1, 2, 3, 5, 8):
            words = t.text.split()
            for _ in range(cut):
                words[draw.randrange(len(words))] = draw.choice(["zz", "the"])
            before = [draw.choice([*filler, "q1", "q2"]) for _ in range(draw.randrange(0, 90))]
            text = [*before, *words, *before[:7]]
            texts.append("\n".join(text[i] if i % 9 else text[i].upper() for i in range(len(text))))
    texts.append(" ".join(draw.choice(filler) for _ in range(20_000)))
    return texts


def test_license_scan_equals_plain_version(spark):
    texts = license_texts()
    rows = [(i % 40, t, "x", i, 2) for i, t in enumerate(texts)] + [(None, texts[9], "x", 900, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, _row int, word int")
    got = sorted((tuple(r) for r in licenses.report(docs).collect()), key=repr)
    assert got == sorted(((r[0], *plain_scan(r[1])) for r in rows), key=repr)
    assert {r[6] for r in got} >= {"mit", "gpl", "gpl-3", "bsd", "apache-2", "unlicense", "mpl-2", "cc-by-nc"}
    full = licenses.scan(docs)
    assert full.columns == ["doc_id", "text", "_row", "word", "license"] and full.count() == len(rows)
    assert licenses.report(docs.limit(0)).count() == 0


def test_license_filters_lose_no_template_of_random_words(spark):
    """Small vocabularies and low shares bring many near misses at every bound."""
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = tuple(licenses.Template(f"t{i}", " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(3, 12))), draw.choice([0.5, 0.7, 0.9, 1.0])) for i in range(12))
    texts = [" ".join(draw.choice([*vocabulary, "x", "y", "z"]) for _ in range(draw.randrange(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license.labels, r.license.score) for r in licenses.scan(docs, templates=templates).collect()}
    for i, text in enumerate(texts):
        labels, score = plain_scan(text, templates)[-2:]
        assert (",".join(got[i][0]), got[i][1]) == (labels, pytest.approx(score))


def test_license_plan_has_no_python_and_no_cross_join(spark):
    plan = queries.queries()["op11_licenses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
