"""WARC archives: a writer that turns repeated payloads into revisit records, and a PySpark data source that reads them.

Files hold one gzip member per record; beside each file lies an index of its members' places. The data source plans
partitions of about SPLIT_BYTES of files with an index and one of each other file, takes over predicates on record type and
header fields, parses the headers of a record first, and neither inflates nor decodes the rest of a record that the predicates
reject or whose content isn't asked for. It reads archives of other writers too: without an index, with several records in a
member, with header names in any case, folded header lines, or colons without a blank.

Null payloads count as empty. A null id writes a record without a number, a null URL one without a target; control
characters in a URL are percent-encoded. Rows that share an id are so many records. An empty table gives an empty
archive and no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from . import shared_files
from .common import attach, new_path, saved

ROLL_BYTES = 64 << 20  # compressed; then a new file begins
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 4096
SPLIT_BYTES = 32 << 20  # compressed

# ---------------------------------------------------------------- writer


def record(kind: str, name: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the HTTP header of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row; returns a row per file (uri, records). Of rows with equal payloads of at least `least`
    bytes, those with the smallest id are responses, the others revisit it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.concat(F.sha1("html"), F.sha2("html", 256)))
    rows = attach(rows, "key", "id", rows.groupBy("key").agg(F.min("id").alias("first")))
    first = F.when((F.octet_length("html") >= least) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("id", "url", "html", first.alias("of")).sortWithinPartitions("id", "url")  # a task that is tried again writes the same files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), []
        with ExitStack() as open_:
            out, places, at = None, [], 0

            def close() -> None:
                nonlocal out
                if out is not None:
                    with shared_files.new_file(f"{files[-1]}.idx") as f:
                        f.write(np.array(places, "<i8").tobytes())
                    counts.append(len(places))
                    open_.pop_all().close()
                    out = None

            counts: list[int] = []
            for batch in batches:
                for i in range(batch.num_rows):
                    key, url, html, of = (batch.column(c)[i].as_py() for c in range(4))
                    payload = html.encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    data = record("response" if of is None else "revisit", f"{NAME}{'' if key is None else key}", url, digest, payload, None if of is None else f"{NAME}{of}")
                    if out is None:
                        files.append(f"{folder}/{part:06d}-{len(files):04d}.warc.gz")
                        out, places, at = open_.enter_context(shared_files.new_file(files[-1])), [], 0
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                    if at >= ROLL_BYTES:
                        close()
            close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64())], ["uri", "records"])

    return rows.mapInArrow(run, "uri string, records long")


# ---------------------------------------------------------------- data source

COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", http_length long, payload binary"


class WarcPartition(InputPartition):
    def __init__(self, uri: str, part: int = 0, parts: int = 1):
        self.uri, self.part, self.parts = uri, part, parts


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.content = options["path"], options.get("content", "payload")
        if self.content not in ("none", "http", "payload"):
            raise ValueError("content is none, http or payload")
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over =, IN and IS NOT NULL on header columns; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((COLUMNS[column], frozenset([f.value])))
            elif column in COLUMNS and isinstance(f, In):
                self.wanted.append((COLUMNS[column], frozenset(f.value)))
            elif column in COLUMNS and isinstance(f, IsNotNull):
                self.wanted.append((COLUMNS[column], None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        indexed = {uri for uri, _ in shared_files.sizes(self.folder, ".warc.gz.idx")}
        out = []
        for uri, size in shared_files.sizes(self.folder, ".warc.gz"):
            parts = -(-size // SPLIT_BYTES) if f"{uri}.idx" in indexed else 1
            out += [WarcPartition(uri, i, parts) for i in range(max(1, parts))]
        return out or [WarcPartition("")]

    def read(self, partition: WarcPartition) -> Iterator[tuple]:
        if not partition.uri:
            return
        for fields, rest in records(partition.uri, partition.part, partition.parts):
            if all(fields.get(k.lower()) in v if v is not None else k.lower() in fields for k, v in self.wanted):
                http, payload = rest(self.content)
                yield (*(fields.get(h.lower()) for h in COLUMNS.values()), http, payload)


def header(data: bytes) -> dict[str, str]:
    """Fields of a header block by their lower-cased names; of a repeated one the first."""
    fields: dict[str, str] = {}
    name = None
    for line in data.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name in fields:
                name = None
            else:
                fields[name] = value.strip()
    return fields


class Inflated:
    """What a gzip member holds, inflated as far as it is asked for."""

    def __init__(self, f, at: int, length: int):
        self.f, self.at, self.end = f, at, at + length
        self.z, self.got, self.waiting = zlib.decompressobj(31), b"", b""

    def more(self, whole: bool = False) -> bool:
        if self.z.eof:
            return False
        if not self.waiting:
            self.f.seek(self.at)
            self.waiting = self.f.read(min(self.end - self.at, (1 << 30) if whole else HEAD_BYTES))
            self.at += len(self.waiting)
            if not self.waiting:
                return False
        self.got += self.z.decompress(self.waiting, 0 if whole else HEAD_BYTES)
        self.waiting = self.z.unconsumed_tail
        return True


def records(uri: str, part: int = 0, parts: int = 1) -> Iterator[tuple[dict, object]]:
    """Header fields of each record of a part of a file, and a function that inflates as much of the record as is asked for.
    It must be called, if at all, before the next record is taken."""
    with shared_files.opened(uri) as f, ExitStack() as also:
        try:
            index = np.frombuffer(also.enter_context(shared_files.opened(f"{uri}.idx")).read(), "<i8").reshape(-1, 2)
            index, single = index[len(index) * part // parts : len(index) * (part + 1) // parts].tolist(), True
        except FileNotFoundError:
            index, single = members(uri), False
        for at, length in index:
            data = Inflated(f, at, length)
            while True:  # records of a member
                while b"\r\n\r\n" not in data.got and b"\n\n" not in data.got and data.more():
                    pass
                if not data.got.strip():
                    break
                ends = [(data.got.index(e), len(e)) for e in (b"\r\n\r\n", b"\n\n") if e in data.got]
                if not ends:
                    raise ValueError(f"{uri}: a record at {at} is cut short")
                end, gap = min(ends)
                fields = header(data.got[:end])
                data.got = data.got[end + gap :]
                size = int(fields.get("content-length", 0))

                def rest(content: str, data=data, fields=fields, size=size) -> tuple[int | None, bytes | None]:
                    if content == "none":
                        return None, None
                    while len(data.got) < size and not (content == "http" and b"\r\n\r\n" in data.got) and data.more(content == "payload"):
                        pass
                    if not fields.get("content-type", "").startswith("application/http"):
                        return None, data.got[:size] if content == "payload" else None
                    http, _, payload = data.got[:size].partition(b"\r\n\r\n")
                    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    return lengths[0] if lengths else None, payload if content == "payload" and fields.get("warc-type") != "revisit" else None

                yield fields, rest
                if single:
                    break
                while len(data.got) < size and data.more(True):
                    pass
                data.got = data.got[size:]
                while not data.got.strip(b"\r\n") and data.more(True):
                    pass
                data.got = data.got.lstrip(b"\r\n")


def members(uri: str) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of a file without an index."""
    with shared_files.opened(uri) as f:
        z, start, at, data = zlib.decompressobj(31), 0, 0, b""
        while True:
            data = z.unused_data if z.eof else f.read(1 << 20)
            if z.eof:
                end = at - len(data)
                yield start, end - start
                z, start = zlib.decompressobj(31), end
                data = data or f.read(1 << 20)
                at = end + len(data)
                if not data:
                    return
            else:
                at += len(data)
                if not data:
                    return
            z.decompress(data)


class WarcSource(DataSource):
    """spark.read.format("warc").option("content", "none" | "http" | "payload").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, folder: str, content: str = "payload") -> DataFrame:
    """Records of the archives below a folder (columns of SCHEMA). Turns pushed filters of Python sources on for the session:
    Spark asks for them when it plans, not here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("content", content).load(folder)


# ---------------------------------------------------------------- operator


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes pages to archives and reads their records back (columns of the data source)."""
    folder = new_path(pages.sparkSession, "warc")
    shared_files.of(folder)[0].create_dir(shared_files.of(folder)[1], recursive=True)
    saved(write(pages, folder, id_col, url_col, html_col, least), "warc-files")
    return read_whole(pages.sparkSession, folder)


def read_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All records, by two scans with pushed filters: payloads of responses, and only the HTTP headers of revisits, which have
    no payload to inflate."""
    full = read(spark, folder).where("record_type = 'response'")
    return full.unionByName(read(spark, folder, "http").where("record_type = 'revisit'"))


def digests(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of records."""
    number = lambda c: F.regexp_extract(c, rf"^<{NAME}(-?\d+)>$", 1)
    size = F.when(F.col("record_type") == "revisit", F.col("http_length")).otherwise(F.octet_length("payload"))
    return found.select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias(id_col),
        size.cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"),
    )
