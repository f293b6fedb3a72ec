"""WARC archives: records written through Spark, and read back from byte ranges by verified boundary chains."""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged, table, unstage

MAGIC = "WARC/1.0\r\n"
#: Payloads of so many bytes are stored once; equal ones are revisits.
LEAST_BYTES = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_END, _LENGTH = b"\r\n\r\n", re.compile(rb"[0-9]{1,18}").fullmatch
_RECORD = "file string, split long, node long, next long, exit long, whole boolean, type string, record_id string, target_uri string, digest string, refers_to string, payload_bytes long, payload_sha256 string"


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) as WARC files under path, one record per row and a file per task.

    Of rows with equal html of least_bytes bytes or more, that of the least page_id is a response
    record and the others revisit it; rows that repeat the least page_id are a response each.  A null
    html is empty, a null url is left out, a null page_id comes after all others; where all of a
    group are null, each is a response.  Line breaks and angle brackets in a url are percent-encoded.
    Other columns are not looked at.

    The bodies don't move, unless the list of repeated payloads is too large to broadcast.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("own"), "page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    repeated = staged(
        rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated"
    )
    url = F.col("url")
    for sign, code in (("\r", "%0D"), ("\n", "%0A"), ("<", "%3C"), (">", "%3E")):
        url = F.replace(url, F.lit(sign), F.lit(code))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page, F.lit("")), F.lit(":"), F.substring("digest", 1, 16), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("own"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.concat(F.lit("<"), url, F.lit(">"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("first").cast("string"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n\r\n"),
        block,
    )
    rows.join(repeated, "digest", "left").select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    unstage(repeated)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, file, split): what stands between magic strings, in order within each byte range of a file.

    The reader has a session of its own, in which byte ranges depend on the files alone: both scans
    of an archive see the same ones, whatever executors come and go.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = own.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _parsed(chunk: bytes):
    """(fields, start and end of the block) of a candidate record, the bytes after its magic; None if they are no record."""
    head = chunk.find(_END)
    if head < 0:
        return None
    fields: dict = {}
    for text in chunk[:head].split(b"\r\n"):
        key, _, value = text.partition(b":")
        fields.setdefault(key.strip().lower(), value.strip())
    length = fields.get(b"content-length", b"")
    return (fields, head + 4, head + 4 + int(length)) if _LENGTH(length) else None


def _payload(fields: dict, block: bytes) -> bytes:
    """A block without its HTTP header, where it has one."""
    if not fields.get(b"content-type", b"").startswith(b"application/http"):
        return block
    head = block.find(_END)
    return block[head + 4 :] if head >= 0 else b""


def _described(fields: dict, block: bytes | None) -> list:
    """type to payload_sha256 of _RECORD; the last two are null without a block."""
    read = lambda key: fields[key].decode("utf-8", "replace") if key in fields else None
    payload = None if block is None else _payload(fields, block)
    uri, digest = read(b"warc-target-uri"), read(b"warc-payload-digest")
    uri = uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri
    return [read(b"warc-type"), read(b"warc-record-id"), uri, digest, read(b"warc-refers-to"), None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()]


def _candidates(batches):
    """A row of _RECORD per candidate, and one of node -1 per byte range, whose next is the range's bytes.

    node is where a candidate's bytes begin, just after its magic, counted from the range's first
    byte; next is where the record after it must begin; exit is the first such place, going on from
    record to record, that lies beyond this range.  whole: the chunk is just this record.
    """
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split(" ")[1]] for f in _RECORD.split(", ")]
    at, rows, running = None, [], 0

    def ended():
        leave: dict = {}
        for r in reversed(rows):
            r[4] = leave[r[2]] = None if r[3] is None else leave.get(r[3], r[3])
        rows.append([*at, -1, running, *[None] * 9])
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), types)], names=names)

    for batch in batches:
        for chunk, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, split) != at:
                if at:
                    yield from ended()
                at, rows, running = (file, split), [], 0
            chunk = chunk.as_py()
            if found := _parsed(chunk):
                fields, start, stop = found
                whole = stop + 4 == len(chunk) and chunk.endswith(_END)
                rows.append([*at, running, running + stop + 4 + len(MAGIC), None, whole, *_described(fields, chunk[start:stop] if whole else None)])
            else:
                rows.append([*at, running, None, None, False, *[None] * 7])
            running += len(chunk) + len(MAGIC)
    if at:
        yield from ended()


def _entries(spots: DataFrame) -> DataFrame:
    """(file, node): where the chain of each file enters a byte range, by pointer jumping from the file's start.

    spots(file, node, exit) has a row per candidate, in bytes of the file. Only targets of exits take
    part, a few to a range; each round doubles how far a pointer goes, so a file of n ranges takes log n.
    """
    starts = spots.select("file").distinct().withColumn("node", F.lit(len(MAGIC)).cast("long"))
    targets = spots.select("file", F.col("exit").alias("node")).union(starts).distinct()
    jump = staged(spots.where("exit IS NOT NULL").join(targets, ["file", "node"], "left_semi"), "jump")
    reached = [staged(starts, "reached")]
    while not jump.isEmpty():
        so_far = reduce(DataFrame.union, reached)
        reached.append(staged(so_far.join(jump, ["file", "node"]).select("file", F.col("exit").alias("node")), "reached"))
        further = jump.select("file", F.col("node").alias("exit"), F.col("exit").alias("beyond"))
        before, jump = jump, staged(jump.join(further, ["file", "exit"]).select("file", "node", F.col("beyond").alias("exit")), "jump")
        unstage(before)
    unstage(jump)
    out = staged(reduce(DataFrame.union, reached), "entries")
    unstage(*reached)
    return out


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the WARC files under path, staged; with payloads, their payload bytes too.

    Columns: file, offset (of the magic), type, record_id, target_uri, digest, refers_to (header
    fields, null where absent), payload_bytes, payload_sha256, and payload.  The payload is the
    block without its HTTP header.

    Tasks split files at the magic anywhere, take what follows as a candidate and note where its
    Content-Length puts the next record.  Only candidates on the chain from a file's start are
    records; a magic inside a payload never is.  A file that doesn't begin with a record has none,
    and a chain that breaks ends its file's records there; an empty file or folder gives no rows.
    A header line may not end in the magic: hence the angle brackets around a written URI.

    Payloads are hashed in the task that scans them. Only those of records with a magic inside, or
    all of them on demand, are read again: a record's chunks meet in a group of their own.
    """
    scan = staged(_chunks(spark, path).mapInArrow(_candidates, _RECORD), "candidates")
    found = spark.read.schema(scan.schema).parquet(scan._staged_at)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.where("node = -1").select("file", "split", F.coalesce(F.sum("next").over(before), F.lit(0).cast("long")).alias("base"))
    ranges = staged(ranges, "ranges")
    spots = found.where("node >= 0").join(ranges, ["file", "split"]).withColumns({"place": F.col("base") + F.col("node"), "after": F.col("base") + F.col("next"), "exit": F.col("base") + F.col("exit")})
    spots = staged(spots.drop("base"), "spots")
    entries = _entries(spots.select("file", F.col("place").alias("node"), "exit"))
    entered = spots.join(entries.withColumnRenamed("node", "place"), ["file", "place"]).select("file", "split", F.col("node").alias("entry"))
    along = spots.join(entered, ["file", "split"]).groupBy("file", "split")
    reached = staged(along.applyInArrow(_on_chain, spots.schema), "reached")

    owner = F.struct("place", "after", "whole")
    last = reached.groupBy("file", "split").agg(F.max(owner).alias("last"))
    carried = ranges.join(last, ["file", "split"], "left").select("file", "split", F.last("last", ignorenulls=True).over(before).alias("carried"))
    heads = reached.select("file", "split", "node", owner.alias("head"))
    within = Window.partitionBy("file", "split").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    held = spots.select("file", "split", "node", "place").join(heads, ["file", "split", "node"], "left").withColumn("local", F.last("head", ignorenulls=True).over(within))
    held = held.join(carried, ["file", "split"]).withColumn("owner", F.coalesce("local", "carried"))
    again = F.lit(True) if payloads else ~F.col("owner.whole")
    needed = staged(held.where((F.col("place") < F.col("owner.after")) & again).select("file", "split", "node", "place", F.col("owner.place").alias("owner")), "needed")
    bodies = _chunks(spark, path).mapInArrow(_placed, "file string, split long, node long, chunk binary")
    joined = needed.join(bodies, ["file", "split", "node"]).select("file", "owner", "place", "chunk").groupBy("file", "owner")
    out = "file string, place long, bytes long, sha256 string" + ", payload binary" * payloads
    read = joined.applyInArrow(_assembled(payloads), out)
    records = reached.join(read, ["file", "place"], "left").select(
        "file", (F.col("place") - len(MAGIC)).alias("offset"), "type", "record_id", "target_uri", "digest", "refers_to",
        F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), F.coalesce("payload_sha256", "sha256").alias("payload_sha256"), *["payload"] * payloads,
    )
    records = staged(records, "records")
    unstage(scan, ranges, spots, entries, reached, needed)
    return records


def _on_chain(rows: pa.Table) -> pa.Table:
    """The candidates of a byte range that its chain visits, from where it enters."""
    node, following = rows.column("node").to_pylist(), rows.column("next").to_pylist()
    row, at, visited = {n: i for i, n in enumerate(node)}, rows.column("entry")[0].as_py(), []
    while at in row:
        if following[row[at]] is None:
            break
        visited.append(row[at])
        at = following[row[at]]
    return rows.take(pa.array(visited, pa.int64())).drop_columns(["entry"])


def _placed(batches):
    """(file, split, node, chunk) of each chunk, node as in _candidates."""
    at, running = None, 0
    for batch in batches:
        nodes = []
        for size, file, split in zip(pa.compute.binary_length(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, split) != at:
                at, running = (file, split), 0
            nodes.append(running)
            running += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(nodes, pa.int64()), batch.column(0)], names=["file", "split", "node", "chunk"])


def _assembled(payloads: bool):
    def run(rows: pa.Table) -> pa.Table:
        """The payload of one record, from its chunks."""
        data = MAGIC.encode().join(c.as_py() for c in rows.sort_by("place").column("chunk"))
        fields, start, stop = _parsed(data)
        payload = _payload(fields, data[start:stop])
        own = {"file": rows.column("file")[:1], "place": rows.column("owner")[:1], "bytes": pa.array([len(payload)], pa.int64()), "sha256": pa.array([hashlib.sha256(payload).hexdigest()])}
        return pa.table(own | ({"payload": pa.array([payload], pa.binary())} if payloads else {}))

    return run


def resolved(records: DataFrame) -> DataFrame:
    """Records with `page` (the page id in their name) and `first` (that of the record they revisit); revisits get the payload figures of what they revisit."""
    page = lambda name: F.regexp_extract(name, "^<urn:page:([^:>]*):", 1)
    stored = records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("of_bytes"), F.max("payload_sha256").alias("of_sha256"))
    columns = lambda first, figures: (page("record_id").alias("page"), first.alias("first"), "type", *(F.col(a).alias(b) for a, b in zip(figures, ("payload_bytes", "payload_sha256"))))
    again = records.where("type = 'revisit'").join(stored, "refers_to", "left").select(*columns(page("refers_to"), ("of_bytes", "of_sha256")))
    # Other records have no partner: they stay out of the join, in which their null would be one key.
    return again.union(records.where("type IS DISTINCT FROM 'revisit'").select(*columns(F.lit(None).cast("string"), ("payload_bytes", "payload_sha256"))))


def op12_warc(spark, sf_dir):
    """All pages, written as WARC files and read back; edge cases as write_archives() and read_archives() say."""
    path = f"{shared_dir(spark)}/touchline-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = resolved(read_archives(spark, path))
    archive = spark._jvm.org.apache.hadoop.fs.Path(path)
    archive.getFileSystem(spark._jsc.hadoopConfiguration()).delete(archive, True)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return found.select(number("page").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), number("first").alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
"""
