"""WARC archives written with an index, and read back by coalesced byte ranges.

Writing: pages with equal payloads become one ``response`` record and ``revisit`` records
that refer to it. Each task writes one archive, a gzip member per record, and returns the
index: file, offset, length, URL and digest of each record. Reading: selected index rows
are sorted by file and offset; neighbours that lie close together are fetched by one range
read. Archives are never scanned.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bloom import possible
from lexmill.llm.common import durable, open_fs, out_of_the_way, scratch_path, small_batches

#: Copies of each original that the join with its revisits is salted over.
SALTS = 16
#: A range read goes on over gaps up to GAP bytes, and takes up to RANGE bytes.
GAP = 64 << 10
RANGE = 8 << 20
#: Archive bytes that one task reads, about.
TASK_BYTES = 32 << 20
#: Fixed value: the date of records whose pages have none.
DATE = "2000-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, digest string, record_type string"


def base32_of_hex(hex40):
    """Upper-case base32 of a SHA-1 in hex: each five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame, *, page_id: str = "page_id", payload: str = "html", min_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """``pages`` with digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest
    page_id is the response and the others revisit it; rows with smaller payloads are all
    responses. Null payloads count as empty. Null page_ids come last; among repeated
    page_ids any one row is the response. Result columns in ``pages`` are replaced.

    ``pages`` is read more than once and must give the same rows each time, in whatever order and
    number of tasks. Payloads stay where they are, but for those whose digest a blocked Bloom filter
    of the repeated digests lets through: these are written with a row number and joined, each original
    copied ``salts`` times, so that a payload with a third of all rows is dealt to as many tasks.
    Payloads of any length that Spark holds are taken whole; one of them must fit a task."""
    out_of_the_way(pages, page_id, payload)
    added = ("digest", "payload_bytes", "record_type", "refers_to")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in added],
        base32_of_hex(F.sha1(body.cast("binary"))).alias("digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.count("*").alias("__n")).where("__n > 1")
    groups = durable(groups.select("digest"), "repeated-payloads", few=True)
    tested = rows.withColumn("__maybe", possible(groups, "digest", "digest"))
    own = F.struct(F.col(f"`{page_id}`").isNull().alias("last"), F.col(f"`{page_id}`").alias("id"), F.monotonically_increasing_id().alias("row"))
    # row numbers depend on how a scan is split: they are written once, before anything compares them
    suspects = durable(tested.where("__maybe").withColumn("__self", own), "suspects")
    firsts = suspects.groupBy("digest", "payload_bytes").agg(F.min("__self").alias("__first"))
    copies = firsts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = suspects.withColumn("__salt", F.pmod(F.xxhash64("__self.row"), F.lit(salts)).cast("int"))
    joined = salted.join(copies, ["digest", "payload_bytes", "__salt"], "left")
    again = F.col("__first").isNotNull() & (F.col("__first") != F.col("__self")) & (F.col("payload_bytes") >= min_bytes)
    joined = joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__first.id")))
    alone = tested.where(~F.col("__maybe")).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(pages.schema[page_id].dataType))
    return alone.drop("__maybe").unionByName(joined.drop("__self", "__maybe", "__first", "__salt"))


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(member: bytes) -> dict:
    """A record's fields and its payload (None for a revisit), from one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(said["Content-Length"])
    if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("a payload differs from its header")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": body if kind == "response" else None}


def write_archives(pages: DataFrame, directory: str, *, payload: str = "html", level: int = 1) -> DataFrame:
    """Write pages (page_id, url, payload, digest, payload_bytes, record_type, refers_to) as
    one archive per partition below ``directory``; returns, lazily, the index rows (INDEX).

    An archive gets its final name when complete. Empty partitions write none. A null
    URL leaves the target out; blanks and control characters in URLs are percent-encoded
    in the archive and kept in the index."""
    columns = ["page_id", "url", payload, "digest", "payload_bytes", "record_type", "refers_to"]
    out_of_the_way(pages, *columns)
    small_batches(pages.sparkSession)
    source = pages.select(*columns, F.spark_partition_id().alias("part"))

    def run(batches):
        out, offset = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{batch.column(7)[0].as_py():06d}.warc.gz"
                fs, folder = open_fs(directory)
                fs.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
            offsets, lengths = [], []
            for page, url, body, digest, _, kind, refers in zip(*(batch.column(i) for i in range(7)), strict=True):
                data = (body.as_py() or "").encode()
                record = record_bytes(page.as_py(), url.as_py(), data, digest.as_py(), kind.as_py(), refers.as_py())
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), *(batch.column(i) for i in (0, 1, 4, 3, 5))],
                names=["file", "offset", "length", "page_id", "url", "payload_bytes", "digest", "record_type"],
            )
        if out is not None:
            out.close()
            fs.move(temporary, f"{folder}/{name}")

    return source.mapInArrow(run, INDEX)


def coalesced(rows, gap: int = GAP, most: int = RANGE):
    """Runs of (file, offset, length) rows, sorted, that one range read serves."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[1] - (run[-1][1] + run[-1][2]) > gap or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(index: DataFrame, directory: str, *, gap: int = GAP, most: int = RANGE, payload: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with
    ``payload``, the payload of the records that ``index`` (file, offset, length, ...) selects.

    A response's payload is checked against its digest; a damaged record raises. An
    index row selected twice gives its record twice. Revisits have a null payload. The number of
    tasks follows from the bytes that are to be read, not from the size of the index."""
    out_of_the_way(index, "file", "offset", "length")
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    ranges = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        rows = ((f, o, n) for b in batches for f, o, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        handle, opened = None, None
        for group in coalesced(rows, gap, most):
            if group[0][0] != opened:
                if handle is not None:
                    handle.close()
                fs, folder = open_fs(directory)
                opened = group[0][0]
                handle = fs.open_input_file(f"{folder}/{opened}")
            start = group[0][1]
            data = handle.read_at(max(o + n for _, o, n in group) - start, start)
            found = [parse_record(data[o - start : o - start + n]) for _, o, n in group]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, types)], names=names)
        if handle is not None:
            handle.close()

    return ranges.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archived(pages)


def archived(pages: DataFrame) -> DataFrame:
    """The contract's columns, taken from the archives read back through the index."""
    directory = scratch_path(pages.sparkSession, "warc")
    index = durable(write_archives(with_originals(pages), directory), "warc-index")
    return read_records(index, directory, payload=False).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT page_id, h, html, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i) AS payload_digest
      FROM f, range(32) r(i) GROUP BY ALL)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM b
"""
