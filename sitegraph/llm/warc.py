"""WARC archives with an index of every record, read back by coalesced byte ranges.

Pages with equal payloads are one response (the largest page_id) and revisits of it,
decided by one aggregate on the payload's SHA-1.  Each task writes its records, one
gzip member each, to archive files of its own in the shared folder and returns an
index row per record: file, offset, length, URL, digest.  The index is a written
table; a task that runs again writes a new file, and only the files that the index
names count.  Reading starts from the index: the selected records of a file are
sorted by offset, near ones become one byte range, and tasks read ranges.

Cases: null html is an empty payload; a row without page_id is a record without one,
a revisit where another row holds its payload; rows equal in page_id and html are
written each; null url is an empty target; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegraph.llm.common import Tables, local_path, tasks, utf8

FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20           # a byte range is read at once
GAP_BYTES = 64 << 10            # unselected bytes that are read rather than skipped
INDEX = ("file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string,"
         " record_type string, refers_to long")
_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in INDEX.split(", ")]


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 (five hex digits are four base32 digits)."""
    code = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(code, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest, record type and the response that a revisit refers to."""
    payload = utf8(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), utf8(F.col("url")).alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        digest(payload).alias("payload_digest"))
    keepers = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest") \
        .agg(F.max("page_id").alias("keeper"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("payload_bytes") >= least_bytes)
    return rows.join(keepers, "payload_digest").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(row: dict, date: str) -> bytes:
    """One record: header, empty line, block (the payload; nothing for a revisit)."""
    block = (row["payload"] or "").encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", date),
            ("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Content-Type", "text/html; charset=utf-8"),
            ("Content-Length", len(block)), ("X-Payload-Bytes", row["payload_bytes"])]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", row["page_id"]))
    if row["refers_to"] is not None:
        head += [("WARC-Refers-To", record_id(row["refers_to"])), ("X-Refers-To-Page", row["refers_to"]),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member (no time stamp, so that equal records are equal bytes)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(spark: SparkSession, pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; return the written index."""
    store = Tables(spark, "warc")
    folder = store.path("archive")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches):
        files, root = local_path(folder)
        files.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for b in batches:
                index = []
                for row in b.to_pylist():
                    data = member(record(row, date))
                    if out is None or offset + len(data) > file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    index.append((name, offset, len(data), row["page_id"], row["url"], row["payload_bytes"],
                                  row["payload_digest"], row["record_type"], row["refers_to"]))
                    offset += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*index, strict=True), _TYPES, strict=True)], names=_NAMES)
        finally:
            if out is not None:
                out.close()

    index = store.write(roles(pages).mapInArrow(archive, INDEX), "index")
    return index.withColumn("folder", F.lit(folder))


def ranges(index: DataFrame) -> DataFrame:
    """``folder, file, start, end, records`` of the index rows given: sorted, near ones together."""
    order = Window.partitionBy("folder", "file").orderBy("offset")
    last_end = F.lag(F.col("offset") + F.col("length")).over(order)
    cut = last_end.isNull() | (F.col("offset") - last_end > GAP_BYTES) | (
        F.floor(F.col("offset") / RANGE_BYTES) != F.floor(F.lag("offset").over(order) / RANGE_BYTES))
    marked = index.withColumn("cut", cut.cast("int")).withColumn("range", F.sum("cut").over(order))
    return marked.groupBy("folder", "file", "range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name: what their headers and blocks say."""
    def records(batches):
        for b in batches:
            for r in b.to_pylist():
                files, root = local_path(r["folder"])
                with files.open_input_file(f"{root}/{r['file']}") as f:
                    f.seek(r["start"])
                    data = f.read(r["end"] - r["start"])
                out = []
                for at in r["records"]:
                    lo = at["offset"] - r["start"]
                    head, block = parse(data[lo:lo + at["length"]])
                    own = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != own:
                        raise ValueError(f"damaged record at {r['file']}:{at['offset']}")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    out.append((number("X-Page-ID"), head["WARC-Target-URI"], number("X-Payload-Bytes"), own,
                                head["WARC-Type"], number("X-Refers-To-Page")) + ((block.decode(),) if with_payload else ()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names, types = _NAMES[3:], _TYPES[3:]
    if with_payload:
        names, types = [*names, "payload"], [*types, pa.string()]
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types, strict=True))
    # a range row is small and its bytes are not: deal the rows out before they are read
    spread = ranges(index).repartition(tasks(index.sparkSession), "folder", "file", "start")
    return spread.mapInArrow(records, schema)


def oracle() -> str:
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, {5 * k + 1}, 5) AS INTEGER)"
                         f" >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (hex)"""
