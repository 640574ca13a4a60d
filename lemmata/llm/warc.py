"""WARC archives: index first, then coalesced byte-range reads.

Writing: records with equal payloads (by SHA-1 and length) keep one full
response, that of the largest id; the others become revisit records that refer
to it.  Each task writes its rows as gzip members to archives of bounded size in
the shared folder and gives an index row per record (archive, offset, length,
url, digest).  The index is stored before anything is read.

Reading: the index rows of the selected records are sorted by archive and
offset, neighbouring ranges are joined into reads of bounded size, and records
are parsed from these.

Null html counts as empty; null urls as the empty url; control characters in
urls are percent-encoded.  Repeated page ids give a record each, an empty table gives none, and other columns are
not read.  Ids are integers (other types raise ``TypeError``); a null id is written
as an empty one and read back as null, and is never the largest.  A very long html is one record, whole in memory where it is
written and read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lemmata.llm import arrays
from lemmata.llm.skew import hot_join
from lemmata.llm.storage import partitions, shared_folder, stored

#: Largest archive before a task begins another; largest single read; largest gap read over.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
LEVEL = 3


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, page: int | None, url: str, body: bytes, digest: str, size: int, refers: int | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all rows; the stored index (id, archive, offset, length, url, digest, record_type)."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, as the largest id of equal payloads keeps them")
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("body"))
    rows = rows.withColumn("sha", F.concat(F.sha1("body"), F.length("body").cast("string")))
    keys = rows.select("sha", "page")
    first = stored(keys.groupBy("sha").agg(F.max("page").alias("response"), F.count("*").alias("copies")).filter(F.col("copies") > 1), "payloads")
    # decided on ids and digests alone; bodies are dealt by page, so a common payload does not gather them
    again = hot_join(keys.distinct(), first, "sha", "copies", "page").select(F.col("page").alias("_page"), F.col("sha").alias("_sha"), "response")
    joined = rows.join(again, F.col("page").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left").select("page", "url", "body", "sha", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        number, out, at = 0, None, 0
        name = ""
        for batch in batches:
            index: list[tuple] = []
            for page, url, body, sha, response in zip(*(arrays.column(batch, c).to_pylist() for c in ("page", "url", "body", "sha", "response"))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{stem}-{number:04d}.warc.gz", 0
                    out, number = files.open_output_stream(f"{root}/{name}", compression=None), number + 1
                digest = _b32(bytes.fromhex(sha[:40]))
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                again = response is not None and response != page and len(body) >= min_revisit_bytes
                data = _record("revisit" if again else "response", page, url, b"" if again else body, digest, len(body), response if again else None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
                out.write(data)
                index.append((page, name, at, len(data), url, digest, "revisit" if again else "response"))
                at += len(data)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = zip(*index) if index else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "archive", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    index = joined.mapInArrow(run, "page_id long, archive string, offset long, length long, url string, digest string, record_type string")
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records an index selects.

    Length and digest are those of the full payload: recomputed from a response's bytes, and a revisit's as its header states.
    """

    def spans(rows: list[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
        at, group = None, []
        for r in rows:
            if group and (r[1] != at[0] or r[2] - at[2] > GAP_BYTES or r[2] + r[3] - at[1] > READ_BYTES):
                yield at[0], at[1], at[2], group
                group = []
            if not group:
                at = [r[1], r[2], r[2]]
            group.append(r)
            at[2] = max(at[2], r[2] + r[3])
        if group:
            yield at[0], at[1], at[2], group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        files = source = None
        opened = None
        for batch in batches:
            rows = list(zip(*(arrays.column(batch, c).to_pylist() for c in ("folder", "archive", "offset", "length"))))
            for archive, begin, end, group in spans(rows):
                path = (group[0][0], archive)
                if path != opened:
                    if source is not None:
                        source.close()
                    files, root = _file_system(group[0][0])
                    source, opened = files.open_input_file(f"{root}/{archive}"), path
                block = source.read_at(end - begin, begin)
                out = []
                for _, _, offset, length in group:
                    head, body = parse_record(zlib.decompress(block[offset - begin : offset - begin + length], 31))
                    page = int(p) if (p := head["warc-record-id"][10:-1]) else None
                    if head["warc-type"] == "response":
                        size, digest, refers = len(body), _b32(hashlib.sha1(body).digest()), None
                        if head["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"record of page {page} is damaged")
                    else:
                        size, digest, refers, body = int(head["x-payload-length"]), head["warc-payload-digest"][5:], int(head["warc-refers-to"][10:-1]), None
                    out.append((page, head["warc-target-uri"], size, digest, head["warc-type"], refers, body))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if source is not None:
            source.close()

    n = partitions(index.sparkSession)
    rows = index.select("folder", "archive", "offset", "length").repartition(n, "folder", "archive").sortWithinPartitions("folder", "archive", "offset")
    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
