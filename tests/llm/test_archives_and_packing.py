"""WARC archives and packing: exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from callgauge.llm import packing, queries, warc
from callgauge.llm.common import prepared
from callgauge.session import scratch_path

SF = "/root/testdata/sf0.001"
LONG = "<p>" + "payload é " * 30
PAGES = [
    (1, "http://a/x", LONG), (2, None, LONG), (3, "http://a/\r\n%0A", "short"), (4, "http://b", "short"), (5, "http://c", None), (6, "http://d", ""),
    (None, "http://e", LONG), (None, None, None), (7, "http://f", LONG + "z"), (7, "http://f", LONG + "z"), (9, "http://g", LONG + "z"), (8, "http://h", "y" * 300_000),
]
SCHEMA = "page_id long, url string, html string"


def expected(pages):
    low = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 100 and i is not None:
            low[h] = min(i, low.get(h, i))
    rows = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = low.get(h) if i is not None and i > low.get(h, i) else None
        rows.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(rows, key=str)


def told(rows):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_round_trip(spark):
    prepared(spark)
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert told(warc.round_trip(pages).collect()) == expected(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark):
    prepared(spark)
    folder = f"file://{scratch_path(spark, 'warc')}"
    warc.write(spark.createDataFrame(PAGES, SCHEMA), folder)
    made = sorted(((str(r.page_id), r.url, bytes(r.payload)) for r in warc.payloads(spark, folder).collect()), key=str)
    assert made == sorted(((str(i), u, (h or "").encode()) for i, u, h in PAGES), key=str)


def test_shards_follow_the_data(spark):
    """One outlying id, an id and nulls of a third of the rows each: no shard is large, the order holds on both ways."""
    prepared(spark)
    rows = [(i, f"u{i}", str(i)) for i in range(2000)] + [(1 << 60, "far", "x")] + [(77, f"v{i}", str(i)) for i in range(2000)] + [(None, f"n{i}", str(i)) for i in range(2000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    records = warc.classify(pages)
    seen = []
    for most in (1 << 20, 0):
        dealt, count = warc.with_shard(records, pages.select("page_id"), (20_000, 20_000), most)
        found = [(r.page_id if r.page_id is not None else -1, r.digest, r.url, r.shard, r.size) for r in dealt.collect()]
        found.sort()
        assert len(found) == len(rows) and [r[3] for r in found] == sorted(r[3] for r in found) and found[-1][3] < count
        held = defaultdict(int)
        for *_, shard, size in found:
            held[shard] += size + 512
        assert len(held) > 100 and max(held.values()) < 21_000
        seen.append(found)
    assert seen[0] == seen[1]
    sizes = [r["count"] for r in warc.with_slice(records, pages.select("page_id")).groupBy("slice").count().collect()]
    assert max(sizes) < 100


def test_parsing_takes_time_in_proportion():
    record = gzip.compress(warc.make_record(1, "http://a", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None), 6, mtime=0)
    taken = {}
    for n in (500, 8000):
        data, start = record * n, time.perf_counter()
        rows = list(warc.parse(data, "f"))
        taken[n] = time.perf_counter() - start
        assert [r[7] for r in rows] == [i * len(record) for i in range(n)] and all(r[8] and r[9] == b"x" * 50 for r in rows)
    assert taken[8000] < 16 * 4 * taken[500]
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.parse(record[:-9], "f"))


def test_round_trip_of_the_table(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert told(queries.queries()["op1_warc"](spark, SF).collect()) == expected(pages)


def test_files_do_not_depend_on_the_cluster_and_roll(spark, tmp_path):
    prepared(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    seen = []
    for n, parts in enumerate((1, 7)):
        folder = f"file://{tmp_path}/{n}"
        manifest = warc.write(pages.repartition(parts), folder, roll_bytes=20_000, shard_bytes=(100_000, 100_000)).collect()
        assert all(r.compressed_bytes <= 20_000 or r.n_records == 1 for r in manifest) and len(manifest) > 3
        names = sorted(f for f in os.listdir(tmp_path / str(n)) if f.endswith(".warc.gz"))
        assert names == sorted(r.file for r in manifest) and not any(f.startswith("_temporary") for f in os.listdir(tmp_path / str(n)))
        seen.append([(name, hashlib.sha256((tmp_path / str(n) / name).read_bytes()).hexdigest()) for name in names])
        ids = [i for r in sorted(manifest, key=lambda r: r.file) for i in (r.first_id, r.last_id)]
        assert ids == sorted(ids)
        data = gzip.decompress((tmp_path / str(n) / names[0]).read_bytes())
        assert data.startswith(b"WARC/1.1\r\n")
    assert seen[0] == seen[1]
    broken = tmp_path / "1" / seen[1][0][0]
    broken.write_bytes(broken.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read(spark, f"file://{tmp_path}/1").count()


def test_ids_equal_the_library():
    path = queries.vocabulary_path()
    made, library = packing.Encoder(path), Tokenizer.from_file(path)
    draw = random.Random(5)
    signs = "ab é'strevmlld  \n\t\r 　 12³Ⅷ.,!?\"😀 ß中-'' ‍́﻿"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 50))) for _ in range(4000)]
    texts += ["", "<|endoftext|>x a", "'s", "'", "it's 're 'r 'll'l", "   ", "a   b\n\n c", "''s '' 'd", "a'S", "x" * 100_000, " " * 5000 + "y"]
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_assign_fills_sequences():
    draw = np.random.default_rng(1)
    lengths = np.concatenate([draw.integers(1, 700, 500), [5000, 1024, 1]])
    pieces = packing.assign(lengths)
    used, owned = defaultdict(int), defaultdict(int)
    for doc, start, n, s, offset in pieces:
        assert n > 0 and offset == used[s] and start == owned[doc]
        used[s] += n
        owned[doc] += n
    assert [owned[d] for d in range(len(lengths))] == lengths.tolist()
    assert max(used.values()) <= 1024 and sum(1024 - n for n in used.values()) < 1024


def test_packing_query(spark):
    library = Tokenizer.from_file(queries.vocabulary_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, queries.vocabulary_path()).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    rows = docs.collect()
    assert set(by_doc) == {r.doc_id for r in rows}
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs.limit(0), queries.vocabulary_path()).count() == 0
