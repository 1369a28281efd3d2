"""WARC archives, index first.

Writing appends records to archives in the shared folder and yields an index row for each: archive, offset, length, URL, digest.  The index
is written before anything is read.  Reading selects index rows, sorts them by archive and offset, joins ranges that
touch or nearly touch into one read, and parses the records out of the bytes.  Paths are opened through
pyarrow's file systems, so any store that these know will do.  An archive's name carries its attempt: what a lost task leaves is
in no index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, bloom_test, heavy_light_join, own_columns, partitions

INDEX = "archive string, offset long, length long, url string, digest string, record_id string, record_type string"
#: An archive is closed at this size; ranges no further apart than GAP are read at once, up to SPAN bytes.
ARCHIVE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 4 << 20
#: Groups of equal payloads that are broadcast, at about 60 bytes each; more are joined.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base 32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, size: int | None = None) -> bytes:
    """One WARC/1.1 response, or with ``refers_to`` a revisit: HTTP headers without the payload, whose size they state."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short or run over")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def pack(data: bytes, gzip: bool) -> bytes:
    if not gzip:
        return data
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def unpack(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def write_archives(records: DataFrame, path: str, gzip: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` (record_id, url, payload binary, sha1 binary, size, refers_to) and give the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: dict[str, list] = {k: [] for k in ("archive", "offset", "length", "url", "digest", "record_id", "record_type")}
            for r in map(dict, zip(*[[(c, v) for v in batch[c].to_pylist()] for c in batch.schema.names], strict=True)):
                if out is None:
                    name, at = f"{path}/{uuid.uuid4().hex}.warc{'.gz' * gzip}", 0
                    fs, local = pafs.FileSystem.from_uri(name)
                    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)  # the name would have it packed twice
                digest = base64.b32encode(r["sha1"]).decode()
                data = pack(record(r["record_id"], r["url"], r["payload"] or b"", digest, r["refers_to"], r["size"]), gzip)
                out.write(data)
                for k, v in (("archive", name), ("offset", at), ("length", len(data)), ("url", r["url"]), ("digest", digest), ("record_id", r["record_id"]), ("record_type", "response" if r["refers_to"] is None else "revisit")):
                    rows[k].append(v)
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64() if k in ("offset", "length") else pa.string()) for k in rows]))
        if out is not None:
            out.close()

    return records.mapInArrow(run, INDEX)


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) -> reads (archive, start, end, records); a record longer than ``span`` is read alone."""
    out: list[tuple[str, int, int, list[tuple[int, int]]]] = []
    for archive, offset, length in rows:
        if out and out[-1][0] == archive and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= span:
            _, start, end, held = out[-1]
            held.append((offset, length))
            out[-1] = (archive, start, max(end, offset + length), held)
        else:
            out.append((archive, offset, offset + length, [(offset, length)]))
    return out


def read_records(index: DataFrame, with_payload: bool = False, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that ``index`` selects: record_id, record_type, url, digest, payload_bytes, refers_to and, if wanted, payload."""
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "digest", "payload_bytes", "refers_to", "payload"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        opened, file = None, None
        for batch in batches:
            rows = list(zip(*[batch[c].to_pylist() for c in ("archive", "offset", "length")], strict=True))
            for archive, start, end, held in ranges(rows, gap, span):
                if archive != opened:
                    fs, local = pafs.FileSystem.from_uri(archive)
                    opened, file = archive, fs.open_input_file(local)
                data = memoryview(file.read_at(end - start, start))
                out: dict[str, list] = {n: [] for n in names}
                for offset, length in held:
                    fields, http, payload = parse(unpack(bytes(data[offset - start : offset - start + length])))
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    refers = fields.get("warc-refers-to")
                    for n, v in zip(names, (_bare(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), digest, int(http["content-length"]), refers and _bare(refers), payload if with_payload else None), strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    # A stretch of an archive goes to one task, in order.
    dealt = index.select("archive", "offset", "length").repartition(partitions(spark), "archive", F.floor(F.col("offset") / (8 * span)))
    read = dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, "record_id string, record_type string, url string, digest string, payload_bytes long, refers_to string, payload binary")
    return read if with_payload else read.drop("payload")


def _bare(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def write_pages(pages: DataFrame, path: str | None = None, least: int = 0, gzip: bool = True) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and give the written index as a table.

    Of records whose payloads (html in UTF-8; null: empty) are equal and hold at least ``least`` bytes, that with the largest page_id is the
    response and the others revisit it; smaller ones are all responses.  A null page_id loses to any other and is written as
    ``null``; of rows that repeat the largest page_id one is the response.  A null url leaves the header out.  No rows give no archives.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha2(html, 256)).alias("key"))
    ids = scratch.table(p.where(F.col("size") >= least).select("page_id", "key"), "payloads")
    total = ids.count()
    groups = ids.groupBy("key").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ids.groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("reps")).where("reps > 1")
    groups = scratch.table(groups, "groups")
    repeated = not again.join(groups, "key").where(F.col("page_id").eqNullSafe(F.col("lead"))).isEmpty()
    many = groups.count()
    alone = None
    if many <= BROADCAST_ROWS:
        joined = p.join(F.broadcast(groups), "key", "left")
    else:  # payloads that no other page has stay where they are
        maybe = bloom_test(groups, "key", many)(F.col("key"))
        alone = p.where(~maybe).withColumns({"lead": F.lit(None).cast("long"), "leads": F.lit(True)})
        joined = heavy_light_join(p.where(maybe), groups, "key", "n", total, F.col("page_id"))
    small = F.col("size") < least
    leads = F.col("n").isNull() | small | F.col("page_id").eqNullSafe(F.col("lead"))
    if repeated:  # rare: of the rows with the largest identifier only the first is the response
        joined = scratch.table(joined.withColumn("row", F.monotonically_increasing_id()), "joined")
        first = joined.where(F.col("n").isNotNull() & ~small & F.col("page_id").eqNullSafe(F.col("lead"))).groupBy("key").agg(F.min("row").alias("first"), F.max("n").alias("n1"))
        joined = heavy_light_join(joined, first, "key", "n1", total, F.col("row"))
        leads = F.col("n").isNull() | small | F.col("row").eqNullSafe(F.col("first"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    joined = joined.withColumn("leads", leads)
    joined = joined if alone is None else alone.unionByName(joined.select(*alone.columns))
    rows = joined.select(
        named("page_id").alias("record_id"), "url", F.when(F.col("leads"), F.col("payload")).alias("payload"), "size",
        F.unhex(F.sha1("payload")).alias("sha1"), F.when(~F.col("leads"), named("lead")).alias("refers_to"),
    )
    return scratch.table(write_archives(rows, path or f"{scratch.path}/archives", gzip), "index")
