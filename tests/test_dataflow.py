from __future__ import annotations

import json
import random

import pytest

from callgauge.operators import dataflow

PIC = ("pic_make", {"aspect_ratio": "16:9", "gcs_bucket_uri": "gs://mybucket/outputs/", "output_filename": "car.png"})
CLIP = ("clip_image", {"image_uri": "gs://mybucket/outputs/car.png", "aspect_ratio": "16:9", "bucket": "gs://mybucket/outputs/"})
SONG = ("song_make", {"output_gcs_bucket": "mybucket", "output_filename": "bgm.wav"})
MIX = ("mix", {"input_video_uri": "gs://mybucket/outputs/car_video.mp4", "input_audio_uri": "gs://mybucket/bgm.wav"})
PROMPT = "Save the clip to gs://mybucket/anim.mp4 and the music to gs://mybucket/bgm.wav"

CHAINS = {
    0: [PIC, CLIP, SONG, MIX],
    1: [PIC, (CLIP[0], {**CLIP[1], "image_uri": "gs://mybucket/outputs/wrong.png"}), SONG, MIX],
    2: [(PIC[0], {**PIC[1], "aspect_ratio": "9:16"}), CLIP, SONG, MIX],
    3: [PIC, MIX, CLIP, SONG],
    4: [("pic_make", {"gcs_bucket_uri": "gs://g/story/", "output_filename": "s.png"}),
        ("film_make", {"images": ["gs://g/story/s.png"], "gcs_bucket_uri": "gs://g/video/", "output_filename": "a.mp4"}),
        ("song_make", {"output_gcs_bucket": "g", "output_filename": "t.wav"}),
        ("mix", {"input_video_uri": "gs://g/video/a.mp4", "input_audio_uri": "gs://g/t.wav"})],
    5: [("pic_make", {"gcs_bucket_uri": "gs://g/story/", "output_filename": "s.png"}),
        ("film_make", {"images": ["gs://g/story/other.png"], "gcs_bucket_uri": "gs://g/video/", "output_filename": "a.mp4"})],
    6: [("mix", {"input_video_uri": "gs://g/video/a.mp4"}),
        ("film_make", {"gcs_bucket_uri": "gs://g/video/", "output_filename": "a.mp4"})],
}


def chains(spark):
    rows = [(t, i, f"2024-01-01 00:00:{i:02d}", 100 * t + i, tool, json.dumps(a)) for t, calls in CHAINS.items() for i, (tool, a) in enumerate(calls)]
    made = spark.createDataFrame(rows, "transcript_id bigint, call_index int, ts string, call_id bigint, tool_name string, arguments string")
    prompts = spark.createDataFrame([(t, PROMPT if t < 4 else "go") for t in CHAINS], "transcript_id bigint, prompt string")
    return made, prompts


def test_grounding(spark):
    got = {(r.transcript_id, r.call_index, r.uri) for r in dataflow.ungrounded(*chains(spark)).collect()}
    assert got == {
        (1, 1, "gs://mybucket/outputs/wrong.png"),
        (3, 1, "gs://mybucket/outputs/car_video.mp4"),
        (5, 1, "gs://g/story/other.png"),
        (6, 0, "gs://g/video/a.mp4"),
    }


def test_order(spark):
    calls, _ = chains(spark)
    needs = spark.createDataFrame([("mix", "clip_image"), ("mix", "song_make")], "tool_name string, needs_tool string")
    got = {(r.transcript_id, r.needs_tool, r.state) for r in dataflow.order_violations(calls.where("transcript_id < 4"), needs).collect()}
    assert got == {(3, "clip_image", "late"), (3, "song_make", "late")}


def test_setting_mismatch(spark):
    calls, _ = chains(spark)
    written, read = dataflow.call_uris(calls)
    ratio = calls.selectExpr("transcript_id", "call_index", "get_json_object(arguments, '$.aspect_ratio') AS ratio")
    key = ["transcript_id", "call_index"]
    bad = dataflow.setting_mismatch(read.join(ratio, key), written.where("uri IS NOT NULL").join(ratio, key), "ratio")
    assert [r.transcript_id for r in bad.collect()] == [2]


def depths(edges, nodes):
    parents = {n: [p for c, p in edges if c == n and p in nodes] for n in nodes}
    best = {}
    for node in sorted(nodes):  # parents have smaller numbers
        best[node] = max((1 + best[p] for p in parents[node]), default=0)
    return best


def graph_levels(spark, edges, nodes):
    made = spark.createDataFrame([(1, i) for i in nodes], "transcript_id bigint, node int")
    links = spark.createDataFrame([(1, c, p) for c, p in edges], "transcript_id bigint, node int, parent int")
    return {r.node: r.level for r in dataflow.levels(made, links).collect()}


def random_graph(seed, n, parents):
    draw = random.Random(seed)
    return {(c, draw.randrange(max(0, c - 6), c)) for c in range(1, n) for _ in range(draw.randrange(0, parents + 1))}


def test_levels_of_chains_and_of_graphs(spark, monkeypatch):
    chain = [(i, i - 1) for i in range(1, 40)]
    graph = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 0), (5, 3), (5, 4)]
    outside = [(1, 0), (2, 99), (98, 1), (2, 1), (2, 1)]
    for edges, n in ((chain, 40), (graph, 6), (outside, 3), ([], 2), (random_graph(1, 60, 3), 60)):
        assert graph_levels(spark, edges, range(n)) == depths(edges, range(n))
    monkeypatch.setattr(dataflow, "GROWTH", 0)  # single pointers only
    monkeypatch.setattr(dataflow, "MERGED_ROUNDS", 3)
    for edges, n in ((graph, 6), (random_graph(2, 20, 2), 20)):
        assert graph_levels(spark, edges, range(n)) == depths(edges, range(n))


def test_a_long_chain_with_diamonds_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = dataflow._followed
    monkeypatch.setattr(dataflow, "_followed", lambda *a: rounds.append(1) or real(*a))
    n = 5000
    chain = [(i, i - 1) for i in range(1, n)]
    # Every 100 steps a step can be skipped, once by a short cut of three.
    diamonds = [(i, i - 2) for i in range(102, n, 100)] + [(4000, 3997)]
    edges = chain + diamonds
    assert graph_levels(spark, edges, range(n)) == {i: i for i in range(n)}
    assert len(rounds) <= 20


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "transcript_id bigint, node int")
    for edges in ([(1, 2), (2, 1)], [(1, 2), (2, 1), (1, 0), (3, 2)]):
        links = spark.createDataFrame([(1, c, p) for c, p in edges], "transcript_id bigint, node int, parent int")
        with pytest.raises(ValueError, match="cycle"):
            dataflow.levels(nodes, links).count()


def test_the_last_writer_before_a_read_counts(spark):
    writes = [(1, "u", i, "16:9" if i < 600 else "21:9") for i in (0, 2, 300, 600, 900)]
    produced = spark.createDataFrame(writes, "transcript_id bigint, uri string, call_index int, ratio string")
    consumed = spark.createDataFrame([(1, "u", i, "16:9") for i in (0, 1, 2, 3, 299, 599, 600, 601, 2000)] + [(1, "v", 5, "16:9")], produced.schema)
    got = {(r.uri, r.call_index): r.producer_index for r in dataflow.provenance(consumed, produced, ["ratio"]).collect()}
    assert got == {
        ("u", i): max((w[2] for w in writes if w[2] < i), default=None) for i in (0, 1, 2, 3, 299, 599, 600, 601, 2000)
    } | {("v", 5): None}
    assert {r.call_index for r in dataflow.setting_mismatch(consumed, produced, "ratio").collect()} == {601, 2000}
