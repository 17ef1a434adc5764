"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by key, and a shard is a stretch of about equal bytes of that order, so the same table gives the same
files on any cluster. Bytes are summed up in slices that follow the data; only where each shard begins goes back to the
records, by their slice. A task writes a shard under
temporary names, one gzip member per record, and rolls to a new file when the compressed size passes a limit. Its files
then take their final names, and the shard's rows go to the manifest. Readers read the files that the manifest names,
so half-written or repeated attempts are never seen.

Headers are made anew from the payloads: lengths, SHA-256 digests, record ids derived from the key. A payload equal to
that of a smaller key becomes a revisit record that names the earlier record and keeps only the HTTP header.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm.common import written
from callgauge.session import scratch_path

ROLL_BYTES = 8 << 20
# A shard holds a 64th of the table's bytes, but no less and no more than this.
SHARD_BYTES = (1 << 20, 128 << 20)
# A shard's first key takes about 200 bytes: at most 100 MB are broadcast.
BROADCAST_SHARDS = 500_000
SLICES, DIGITS = 256, 2
LEAST_REVISIT_BYTES = 100
CHUNK = 1 << 14
ROWS = 256
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "shard long, file string, n_records long, compressed_bytes long, first_id long, last_id long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, fine boolean"


def classify(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): of equal payloads of at least ``least`` bytes, all but the smallest id refer to it.

    Where several rows share the smallest id, all of them are responses. Rows without an id never refer and are not referred to.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size")
    )
    long = F.when(F.col("size") >= least, F.col("digest"))
    groups = rows.select("page_id", long.alias("same")).filter("same IS NOT NULL AND page_id IS NOT NULL").groupBy("same").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # Only payloads that repeat are looked up; a payload held by very many pages is split by the join itself.
    repeated = written(groups.filter("n > 1").drop("n"), "warc-repeated")
    joined = rows.withColumn("same", long).join(repeated, "same", "left")
    return joined.select("page_id", "url", "html", "digest", "size", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def with_slice(records: DataFrame, ids: DataFrame, slices: int = SLICES, digits: int = DIGITS) -> DataFrame:
    """Add ``slice``, an array that ascends with (page_id, digest), nulls first: between which of ``slices`` quantiles of ``ids``
    a row lies, or on which; ids on a quantile, and nulls, are cut again by the first hexadecimal ``digits`` of the digest.

    So a range full of ids, one outlying id, and an id of very many rows all come apart. The quantiles, one row of bounded
    size, are a sketch; where shards begin does not depend on them.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = sorted(set(ids.agg(F.percentile_approx("page_id", shares, 10 * slices)).first()[0] or []))

    # Twice the number of cuts below, one more on a cut.
    bounds = F.array(*[F.lit(cut) for cut in cuts]).cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda cut: cut < F.col("page_id"))) * 2 + F.array_contains(bounds, F.col("page_id")).cast("int")
    first = F.when(F.col("page_id").isNull(), F.lit(-1)).otherwise(place)
    second = F.when(first % 2 != 0, F.conv(F.substring("digest", 1, digits), 16, 10).cast("int")).otherwise(F.lit(0))
    return records.withColumn("slice", F.array(first, second))


def with_shard(records: DataFrame, ids: DataFrame, shard_bytes: tuple[int, int] = SHARD_BYTES, most: int = BROADCAST_SHARDS) -> tuple[DataFrame, int]:
    """``records`` with the column shard, and the number of shards: the bytes before a record in the order of (page_id, digest,
    url), nulls first, divided by a shard's bytes. Rows equal in all three are together in one shard. Up to ``most`` shards, their first
    records are broadcast; beyond, records meet their shard by a shuffle."""
    sliced = with_slice(records, ids)
    keys = written(sliced.groupBy("slice", "page_id", "digest", "url").agg(F.sum(F.col("size") + 512).alias("bytes")), "warc-keys")
    # At most two rows for a quantile and 16 ** DIGITS for each of those that stand for one id.
    sums = keys.groupBy("slice").agg(F.sum("bytes").alias("in_slice"))
    before = sums.select("slice", F.coalesce(F.sum("in_slice").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = sums.agg(F.sum("in_slice")).first()[0] or 0
    target = min(max(total // 64, shard_bytes[0]), shard_bytes[1])
    inside = Window.partitionBy("slice").orderBy("page_id", "digest", "url")
    upto = F.coalesce(F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shard = F.floor((F.col("before") + F.col("upto")) / F.lit(target)).cast("long")
    placed = keys.withColumn("upto", upto).join(before, "slice").withColumn("shard", shard)
    count = total // target + 1
    if count > most:
        names = ("page_id", "digest", "url")
        dealt = placed.select(*[F.col(n).alias(f"key_{n}") for n in names], "shard")
        same = [F.col(n).eqNullSafe(F.col(f"key_{n}")) for n in names]
        return records.join(dealt, same).drop(*[f"key_{n}" for n in names]), count
    key = F.struct("page_id", "digest", "url")
    first = placed.groupBy("slice", "shard").agg(F.min(key).alias("key"))
    starts = first.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("key", "shard"))).alias("starts"))
    found = F.element_at(F.filter("starts", lambda start: start["key"] <= key), -1)["shard"]
    dealt = sliced.join(F.broadcast(written(starts, "warc-shards")), "slice").withColumn("shard", found).drop("starts", "slice")
    return dealt, count


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}|{url}|{digest}' if page_id is None else str(page_id))}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A null URL or id leaves its header out."""
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page_id} does not have the digest {digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _escaped(url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, None, '')}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _escaped(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: tuple[int, int] = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``folder`` (any file system the workers reach) and return
    the committed manifest. A null page is an empty payload; an empty table gives an empty manifest."""
    spark = pages.sparkSession
    records = classify(pages)
    records, count = with_shard(records, pages.select(F.col("page_id").cast("long").alias("page_id")), shard_bytes)
    file_schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_records", pa.int64()), ("compressed_bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.shard != row["shard"]:
                    if out is not None:
                        yield out.committed(file_schema)
                    out = _Shard(fs, base, row["shard"], roll_bytes)
                record = make_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"])
                out.add(row["page_id"], gzip.compress(record, 6, mtime=0))
        if out is not None:
            yield out.committed(file_schema)

    first, base = pafs.FileSystem.from_uri(folder)
    first.create_dir(base, recursive=True)
    dealt = (
        records.repartitionById(count, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "url")
        .select("shard", "page_id", "url", "html", "digest", "refers_to")
    )
    made = dealt.mapInArrow(task, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Shard:
    """The files of one shard, under temporary names until all are written."""

    def __init__(self, fs: pafs.FileSystem, base: str, shard: int, roll_bytes: int):
        self.fs, self.base, self.shard, self.roll = fs, base, shard, roll_bytes
        self.attempt, self.files, self.out = uuid.uuid4().hex, [], None

    def add(self, page_id: int | None, member: bytes):
        if self.out is not None and self.size + len(member) > self.roll:
            self._end()
        if self.out is None:
            self.temporary = f"{self.base}/_temporary-{self.attempt}-{len(self.files):05d}"
            self.out, self.size, self.n, self.first, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, page_id, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id

    def _end(self):
        self.out.close()
        self.files.append((self.temporary, f"part-{self.shard:05d}-{len(self.files):05d}.warc.gz", self.n, self.size, self.first, self.last, self.sha.hexdigest()))
        self.out = None

    def committed(self, schema: pa.Schema) -> pa.RecordBatch:
        """Rename to the final names. A second attempt writes the same bytes, so it may replace the first one's files."""
        if self.out is not None:
            self._end()
        for temporary, name, *_ in self.files:
            self.fs.move(temporary, f"{self.base}/{name}")
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (self.shard, *f[1:]), strict=True)) for f in self.files], schema=schema)


def parse(data: bytes, file: str) -> Iterator[tuple]:
    """Rows of ``READ`` and the payload from the bytes of an archive; ``fine`` tells whether its digests hold."""
    at, whole = 0, memoryview(data)
    while at < len(data):
        inflate, parts, fed = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if fed >= len(data):
                raise ValueError(f"{file} ends within a record")
            parts.append(inflate.decompress(whole[fed : fed + CHUNK]))
            fed += CHUNK
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = fields["WARC-Type"]
        fine = rest[len(block) :] == b"\r\n\r\n" and hashlib.sha256(block).hexdigest() == fields["WARC-Block-Digest"].removeprefix("sha256:")
        if kind == "response":
            fine = fine and len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
        url, page, first = fields.get("WARC-Target-URI"), fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
        yield (page and int(page), url if url is None else _unescaped(url), size, digest, kind, first and int(first), file, at, fine, payload if kind == "response" else None)
        at = min(fed, len(data)) - len(inflate.unused_data)


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest names, as ``READ``; ``with_payload`` adds the bytes that a record itself holds.

    A file is at most the roll size, so it is one task's row. A file that is missing or differs from the manifest, and a
    record whose digests do not hold, end the job with an error.
    """
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string()}
    columns |= {"refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64(), "fine": pa.bool_()} | ({"payload": pa.binary()} if with_payload else {})
    schema = pa.schema(list(columns.items()))
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['file']} differs from the manifest")
                rows, n = [], 0
                for row in parse(data, entry["file"]):
                    if not row[8]:
                        raise ValueError(f"a digest of page {row[0]} in {entry['file']} does not hold")
                    rows.append(row if with_payload else row[:9])
                    n += 1
                    if len(rows) == ROWS:
                        yield batch_of(rows)
                        rows = []
                if n != entry["n_records"]:
                    raise ValueError(f"{entry['file']} holds {n} records, not {entry['n_records']}")
                if rows:
                    yield batch_of(rows)

    files = max(manifest.count(), 1)
    return manifest.select("file", "sha256", "n_records").repartition(files, "file").mapInArrow(task, READ + (", payload binary" if with_payload else ""))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload) of every record, the payload of a revisit taken from the response that it names."""
    rows = read(spark, folder, with_payload=True)
    named = F.col("record_type") == "revisit"
    asked = rows.filter(named).select("page_id", "url", F.col("refers_to").alias("first_id"), F.col("payload_digest").alias("digest"))
    wanted = asked.select("first_id", "digest").distinct()
    held = rows.filter(~named).select(F.col("page_id").alias("first_id"), F.col("payload_digest").alias("digest"), "payload")
    # A payload that is asked for stands in one row; a much repeated one is split by the join itself.
    held = held.join(wanted, ["first_id", "digest"], "left_semi").dropDuplicates(["first_id", "digest"])
    return rows.filter(~named).select("page_id", "url", "payload").unionByName(asked.join(held, ["first_id", "digest"], "left").select("page_id", "url", "payload"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")
