"""WARC archives with an index: offset, length, URL and digest of every record.

Archives are .warc.gz files of one gzip member a record, so that a record can be read alone. A task writes the records of
its archives in order to new files and returns the index rows, which name the file; the index table is written from these.
A task that runs again writes new files, and the index names those of the run that counted. A reader needs only the index: it sorts the
selected rows by file and offset, coalesces ranges that lie close together, and reads each coalesced range once.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import shared_folder, table

SHORTEST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive int, file string, offset long, length long"
#: Ids pass workers as text: beside nulls, pandas would make floats of them.
_IDS = ("page_id", "refers_to")
_PASSED = INDEX.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
#: Copies beyond which a payload is found by a count before; at most 100,000 payloads are, which bounds what is broadcast.
HOT_COPIES, HOT_PAYLOADS = 1000, 100_000


def _records(pages: DataFrame, shortest: int, archive_bytes: int) -> DataFrame:
    """Each page with its archive, payload (null where it isn't stored), digest and the page it revisits.

    Equal payloads go to one archive, where a window finds the first. A payload that more than HOT_COPIES rows have is
    found by a count before: only its first row carries it, the others are spread over all archives without it. Payloads
    are moved once. Archives are dealt to as many tasks as there are archives.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    octets = F.encode("payload", "UTF-8")
    rows = rows.withColumns({"bytes": F.octet_length(octets).cast("long"), "digest": F.sha2(octets, 256), "row": F.monotonically_increasing_id()})
    total, n = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    archives = max(1, -(-int(total) // archive_bytes), min(int(n), 2 * pages.sparkSession.sparkContext.defaultParallelism))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("row"))
    hot = rows.where(F.col("bytes") >= shortest).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_COPIES, int(n) // HOT_PAYLOADS))
    hot = hot.select("digest", F.col("first.page_id").alias("hot_page"), F.col("first.row").alias("hot_row"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    again = F.col("hot_row").isNotNull() & (F.col("row") != F.col("hot_row"))
    place = F.when(again | (F.col("bytes") < shortest), F.xxhash64("row")).otherwise(F.xxhash64("digest"))
    rows = rows.withColumns({"again": again, "archive": F.pmod(place, F.lit(archives)).cast("int"), "payload": F.when(~again, F.col("payload"))})
    same = Window.partitionBy("archive", "digest", "again").orderBy(F.col("page_id").asc_nulls_last(), "row")
    late = (F.col("bytes") >= shortest) & (F.row_number().over(same) > 1) & ~F.col("again")
    rows = rows.repartition(archives, "archive").withColumns({"late": late, "first_page": F.first("page_id").over(same)})
    revisit = F.col("late") | F.col("again")
    return rows.select(
        "archive", "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(F.col("again"), F.col("hot_page")).when(F.col("late"), F.col("first_page")).alias("refers_to"),
        F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"), "row",
    )


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page}|{digest}'.encode()).hexdigest())}>"


def _as(frame: DataFrame, kind: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast(kind) for c in _IDS})


def _member(page: str | None, url: str, kind: str, refers_to: str | None, size: int, digest: str, payload: str | None, date: str) -> bytes:
    """A record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload.encode("utf-8", "surrogatepass") if kind == "response" else b"")
    revisit = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {_record_id(refers_to, digest)}\r\n" if kind == "revisit" else ""
    clean = url.replace("\r", "").replace("\n", "")
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_record_id(page, digest)}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {clean}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
        f"{revisit}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def write_archives(pages: DataFrame, folder: str, shortest: int = SHORTEST_REVISIT, archive_bytes: int = 64 << 20, date: str = DATE) -> DataFrame:
    """Write a record for every row of ``pages`` under ``folder``/archives and return the index, kept in ``folder``/index.

    Payload: html in UTF-8, null is empty. Rows of equal payloads of at least ``shortest`` bytes refer to the one of
    smallest page_id (null ids come last; of equal rows either is the response). A null URL is written as an empty one,
    line breaks in URLs are left out of the header. Extra columns are not archived; an empty table gives no archive. A
    payload of any length is one record; a task holds one record's bytes at a time, and a batch of rows.
    """
    spark = pages.sparkSession
    schema = [c.split()[0] for c in INDEX.split(", ")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(f"{folder}/archives")
        out, now, name, at = None, None, "", 0
        for pdf in batches:
            offsets, lengths, names = [], [], []
            for r in pdf.itertuples(index=False):
                if r.archive != now:
                    if out is not None:
                        out.close()
                    system.create_dir(base, recursive=True)
                    now, name, at = r.archive, f"archive-{r.archive:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed already
                page, refers = (None if pd.isna(v) else v for v in (r.page_id, r.refers_to))
                member = _member(page, r.url, r.record_type, refers, r.payload_bytes, r.payload_digest, r.payload, date)
                out.write(member)
                names.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pdf.assign(file=names, offset=offsets, length=lengths)[schema]
        if out is not None:
            out.close()

    records = _as(_records(pages, shortest, archive_bytes).sortWithinPartitions("archive", "page_id", "row"), "string")
    _as(records.mapInPandas(write, _PASSED), "long").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a WARC record (and of its HTTP part, in lower case) and its HTTP payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if not record.startswith(b"WARC/1.1\r\n") or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("an index row doesn't point at a whole record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    return fields | {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}, payload


def read_records(selected: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Read the records of the given index rows; adds what the archive itself says of them, and the payload's hash.

    Ranges of one file that are at most ``gap`` bytes apart are read together, up to ``most`` bytes a read (a longer
    record is read alone). Files are opened by their URI in the shared file system.
    """
    archives = max(1, selected.agg(F.count_distinct("archive")).first()[0])
    columns = [c.split()[0] for c in INDEX.split(", ")]
    asked = _as(selected.select(*columns).repartition(archives, "archive").sortWithinPartitions("file", "offset"), "string")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(f"{folder}/archives")
        for pdf in batches:
            for name, rows in pdf.groupby("file", sort=False):
                out = []
                with system.open_input_file(f"{base}/{name}") as source:
                    starts, sizes = rows["offset"].tolist(), rows["length"].tolist()
                    i = 0
                    while i < len(starts):
                        j, end = i + 1, starts[i] + sizes[i]
                        while j < len(starts) and starts[j] - end <= gap and starts[j] + sizes[j] - starts[i] <= most:
                            end = max(end, starts[j] + sizes[j])
                            j += 1
                        chunk = source.read_at(end - starts[i], starts[i])
                        for k in range(i, j):
                            fields, payload = _parse(gzip.decompress(chunk[starts[k] - starts[i] : starts[k] - starts[i] + sizes[k]]))
                            whole = fields["WARC-Type"] == "response"
                            digest = hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            out.append((fields["WARC-Type"], len(payload) if whole else int(fields["content-length"]), digest, fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                        i = j
                found = pd.DataFrame(out, columns=["read_type", "read_bytes", "read_digest", "record_id", "refers_to_id"], index=rows.index)
                yield pd.concat([rows, found], axis=1)

    return _as(asked.mapInPandas(fetch, _PASSED + ", read_type string, read_bytes long, read_digest string, record_id string, refers_to_id string"), "long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    read = read_records(index, folder)
    return read.select("page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), F.col("read_type").alias("record_type"), "refers_to")
