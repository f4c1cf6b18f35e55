r"""WARC archives of pages with a two-level capture index.

Each page becomes one record (WARC/1.1, its own gzip member): a response with the
HTTP header and the page, or, where a page with an equal payload and a larger id
exists, a revisit that has the header only and refers to that response.  Records are
gathered into archives of about ``FILE_BYTES``, written and read by Spark's file sources, so
any store that Spark reaches will do.

The capture index is sorted by (URL with its host reversed, page id): entries are cut
into compressed blocks of ``BLOCK_ENTRIES``, and a sparse directory keeps the first
key of every so many blocks (at most about ``DIRECTORY`` keys, whatever the input).  A look-up
finds its place in the directory and its entries in the blocks by binary search, and
then reads the byte ranges of the archives that the entries name.

Equal payloads are found by their SHA-256, one aggregate row per payload and task, and
joined back by an equi-join that Spark can split where one payload is hot.

Edge cases: null html is an empty payload; a null or odd URL is kept under the key it
gives, without line breaks; a null page id never is the one others refer to, and its
page is a response only where no equal payload has an id; rows that repeat the id of a response are responses too; an
empty table gives an empty archive and index; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from equiflow.llm.common import checkpointed, partition_bound, shared_folder, table

FILE_BYTES = 4 << 20
BLOCK_ENTRIES = 512
DIRECTORY = 65_536
DATE = "2024-01-01T00:00:00Z"  # pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0
ENTRY = "key string, page_id long, file string, start long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def target_uri(url: str) -> str:
    """The URL as a record holds it: without outer white space, other odd characters percent-encoded (again: no change)."""
    return quote(url.strip(), safe="%/:=&?#,);@!$()*+~[]'")


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; scheme, user and fragment go."""
    url = target_uri(url or "")
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:  # not a URL: sorted as it stands
        return url
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {target_uri(url)}"]), f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """Fields of RECORD from one unpacked record; the digest of a payload that is there is taken again."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("WARC-Refers-To")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """The pages (page_id, url, html) as WARC files in ``folder``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"))
    rows = rows.withColumn("content", F.coalesce(F.unhex(F.sha2("html", 256)), F.lit(b"")))
    last = rows.groupBy("content").agg(F.max("page_id").alias("last"))
    last = last.repartition(partition_bound(pages))  # both sides of the join are dealt anew, so a hot payload can be split
    refers = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(last, "content").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            ids, to = batch["page_id"].astype("Int64").tolist(), batch["refers_to"].astype("Int64").tolist()
            for page_id, url, html, refers_to in zip(ids, batch["url"], batch["html"], to):
                held.append(record(None if page_id is pd.NA else page_id, url, html.encode("utf-8", "surrogatepass"), None if refers_to is pd.NA else refers_to))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield pd.DataFrame({"file": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"file": [b"".join(held)]})

    # the text sink writes a string's bytes as they are: one row is one file (and a line end, which no record holds)
    rows.mapInPandas(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, unpacked record) of the gzip members of an archive."""
    view, start, stop = memoryview(content), 0, len(content) - 1  # the last byte is the sink's line end
    while start < stop:
        z, out, at = zlib.decompressobj(31), [], start
        while not z.eof:
            if at >= stop:
                raise ValueError("an archive ends inside a record")
            out.append(z.decompress(view[at : min(at + 65_536, stop)]))
            at = min(at + 65_536, stop)
        length = at - len(z.unused_data) - start
        yield start, length, b"".join(out)
        start += length


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries (ENTRY) of all records, found by reading the archives through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                out = []
                for start, length, data in members(content):
                    page_id, url, *_ = parse(data)
                    out.append((url_key(url), page_id, name, start, length))
                if out:
                    yield pd.DataFrame(out, columns=["key", "page_id", "file", "start", "length"]).astype({"page_id": "Int64"})

    return _files(spark, folder).mapInPandas(run, ENTRY)


def build_index(entries: DataFrame) -> DataFrame:
    """Blocks of sorted entries: ``first_key, first_id, part, seq, n, data`` (part and seq: the order of blocks)."""
    parts = partition_bound(entries)
    ordered = entries.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, rest = TaskContext.get().partitionId(), 0, None

        def block(rows):
            nonlocal seq
            ids = rows["page_id"].astype("Int64").tolist()
            lines = [[k, None if i is pd.NA else i, f, int(a), int(n)] for k, i, f, a, n in zip(rows["key"], ids, rows["file"], rows["start"], rows["length"])]
            seq += 1
            return pd.DataFrame([(lines[0][0], lines[0][1], part, seq - 1, len(lines), zstandard.compress(json.dumps(lines).encode()))], columns=["first_key", "first_id", "part", "seq", "n", "data"]).astype({"first_id": "Int64"})

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= BLOCK_ENTRIES:
                yield block(rest[:BLOCK_ENTRIES])
                rest = rest[BLOCK_ENTRIES:]
        if rest is not None and len(rest):
            yield block(rest)

    return ordered.mapInPandas(run, "first_key string, first_id long, part int, seq int, n int, data binary")


def _place(directory: list[tuple], key: str, page_id: int | None) -> int:
    """Where (key, id) belongs: the last directory key that is not after it (a null id sorts first)."""
    return max(0, bisect.bisect_right(directory, _sortable(key, page_id)) - 1)


def _places(directory: list[tuple], key: str, page_id: int | None) -> list[int]:
    """Where blocks with entries equal to (key, id) are: those that begin with it, and the block before, which may end with it."""
    return sorted({max(0, bisect.bisect_left(directory, _sortable(key, page_id)) - 1), _place(directory, key, page_id)})


def _sortable(key: str, page_id: int | None) -> tuple:
    return key.encode(), page_id is not None, page_id or 0


def look_up(index: DataFrame, captures: DataFrame) -> DataFrame:
    """Entries (ENTRY) of the captures (key, page_id), by binary search in the directory and in the blocks."""
    blocks = index.count()
    stride = -(-blocks // DIRECTORY) or 1
    directory = sorted(_sortable(r.first_key, r.first_id) for r in index.where(F.col("seq") % stride == 0).select("first_key", "first_id").collect())

    def placed(key_col: str, id_col: str, places):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch[id_col].astype("Int64").tolist()
                at = [places(directory, k, None if i is pd.NA else i) for k, i in zip(batch[key_col], ids)]
                yield batch.assign(place=at).explode("place").astype({id_col: "Int64", "place": "int64"})

        return run

    def search(wanted: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        entries = [e for data in found["data"] for e in json.loads(zstandard.decompress(data))]
        entries.sort(key=lambda e: _sortable(e[0], e[1]))
        keys = [_sortable(e[0], e[1]) for e in entries]
        ids = wanted["page_id"].astype("Int64").tolist()
        out = []
        for k, i in zip(wanted["key"], ids):
            at = _sortable(k, None if i is pd.NA else i)
            out += entries[bisect.bisect_left(keys, at) : bisect.bisect_right(keys, at)]
        return pd.DataFrame(out, columns=["key", "page_id", "file", "start", "length"]).astype({"page_id": "Int64"})

    wanted = captures.select("key", "page_id").distinct().mapInPandas(placed("key", "page_id", _places), "key string, page_id long, place long")
    held = index.mapInPandas(placed("first_key", "first_id", lambda *x: [_place(*x)]), StructType.fromDDL(index.schema.toDDL() + ", place long"))
    # a block has one place, so an entry is found once
    return wanted.groupBy("place").cogroup(held.select("place", "data").groupBy("place")).applyInPandas(search, ENTRY)


def read_ranges(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """The records (RECORD) that the entries name, from their byte ranges of the archives."""
    by_file = entries.groupBy("file").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))  # as many as a file has records

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, ranges in zip(batch["content"], batch["ranges"]):
                out = [parse(zlib.decompress(content[r["start"] : r["start"] + r["length"]], 31)) for r in ranges]
                yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _files(spark, folder).join(by_file, "file").select("content", "ranges").mapInPandas(run, RECORD)


def captures(pages: DataFrame) -> DataFrame:
    """``key, page_id`` of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": [url_key(u) for u in batch["url"]], "page_id": batch["page_id"].astype("Int64")})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInPandas(run, "key string, page_id long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    index = checkpointed(build_index(checkpointed(scan_archives(spark, folder))))
    return read_ranges(spark, folder, look_up(index, captures(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(x, 5 * g + 1, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM b
"""
