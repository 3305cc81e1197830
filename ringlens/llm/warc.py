"""WARC archives: a writer and a Python data source.

``write_archives`` decides which pages are revisits (small tables of digests only), then every task writes one
archive of plain WARC/1.1 records. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
largest page id is the response and the others revisit it. A response holds HTTP headers and the payload in a gzip content
coding; a revisit holds the HTTP headers alone. File names carry the attempt, and the manifest, a table that
Spark commits, lists the files of the attempts that counted with split points every ``SPLIT_BYTES``, so lost
executors and repeated attempts leave no record twice.

``spark.read.format("warc")`` plans one partition per split. Equality and IN filters on the record type and on header
columns are pushed into the reader, which parses a record's headers first and seeks past the blocks of records that no
filter wants, or of all records when the schema asked for has no payload. It decodes a payload only to return it.

Null html counts as empty; pages with a null id revisit a page with an id and never the reverse; rows of one id and
payload have one type. Extra columns are ignored; no pages give no records.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from ringlens.llm.store import cut_lineage, shared_folder

REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "page_id bigint, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
_HEADER_COLUMNS = ("page_id", "record_type", "url", "payload_digest", "refers_to")


def _identified(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, digest: str, body: bytes, revisit: bool, refers_to: int | None) -> bytes:
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    block = b""
    if not revisit:
        block = zlib.compress(body, 3, 31)
        http.append(b"Content-Encoding: gzip")
    http = b"\r\n".join([*http, b"X-Decoded-Length: %d" % len(body), b"", b""])
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _identified(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _identified(refers_to))]
    fields += [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(http) + len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + http + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) under ``folder``, a path in the shared folder."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), body.alias("body")) \
        .withColumns({"digest": F.sha1("body"), "bytes": F.octet_length("body")})
    small = cut_lineage(rows.select("page_id", "digest", "bytes"))
    groups = small.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select("digest", "first")
    revisits = small.join(groups, "digest").where("NOT (page_id <=> first)").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    planned = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left") \
        .select("page_id", "url", "digest", "body", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(f"{folder}/archives/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        starts, at = [0], 0
        with store.open_output_stream(path) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "body", "revisit", "refers_to"))):
                    piece = record(*row)
                    if at - starts[-1] >= SPLIT_BYTES:
                        starts.append(at)
                    out.write(piece)
                    at += len(piece)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path.rpartition("/")[2]] * len(starts)), pa.array(starts, pa.int64()), pa.array([*starts[1:], at], pa.int64())],
            names=["file", "first", "last"])

    planned.mapInArrow(of, "file string, first bigint, last bigint").write.parquet(f"{folder}/manifest")


@dataclass
class Split(InputPartition):
    file: str
    first: int
    last: int


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]) -> None:
        self.folder, self.columns = folder, columns
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADER_COLUMNS and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, path = fs.FileSystem.from_uri(f"{self.folder}/manifest")
        rows = parquet.read_table(path, filesystem=store).to_pylist()
        return [Split(r["file"], r["first"], r["last"]) for r in rows if r["last"] > r["first"]] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names, types = self.columns, {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[types[n]]) for n in names])
        rows, held = [], 0
        for row in self.records(split):
            rows.append([row[n] for n in names])
            held += len(row["payload"] or b"")
            if len(rows) >= 2000 or held >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def records(self, split: Split) -> Iterator[dict]:
        if split.last == split.first:
            return
        payload_wanted = "payload" in self.columns
        store, path = fs.FileSystem.from_uri(f"{self.folder}/archives/{split.file}")
        with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as file:
            file.seek(split.first)
            at = split.first
            while at < split.last:
                if file.readline() != b"WARC/1.1\r\n":
                    raise ValueError(f"no record at {at} of {split.file}")
                fields = _fields(file)
                at = file.tell() + int(fields["content-length"]) + 4
                row = _header_row(fields)
                if all(row[name] in values for name, values in self.wanted.items()):
                    file.readline()
                    http = _fields(file)
                    row["payload_bytes"] = int(http["x-decoded-length"])
                    if payload_wanted and row["record_type"] == "response":
                        row["payload"] = zlib.decompress(file.read(at - 4 - file.tell()), 31)
                    yield row
                file.seek(at)


def _fields(file: io.BufferedReader) -> dict[str, str]:
    fields = {}
    while (line := file.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(": ")
        fields[name.lower()] = value[:-2]
    return fields


def _page(identifier: str | None) -> int | None:
    number = (identifier or "none>").rpartition(":")[2].rstrip(">")
    return None if number == "none" else int(number)


def _header_row(fields: dict[str, str]) -> dict:
    return {"page_id": _page(fields.get("warc-record-id")), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": _page(fields.get("warc-refers-to")),
            "payload_bytes": None, "payload": None}


class WarcSource(DataSource):
    """Options: ``path``, the folder given to ``write_archives``. A schema of fewer columns reads less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], [f.name for f in schema.fields])


def read_archives(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records under ``folder``. Read anew for every filter: Spark keeps the pushed filters with the relation."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    if columns:
        reader = reader.schema(", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in columns))
    return reader.load(folder)


def archives_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    Responses are measured on their decoded payloads; revisits are read from headers without any payload.
    """
    folder = shared_folder(pages.sparkSession)
    write_archives(pages, folder)
    responses = read_archives(pages.sparkSession, folder, ["page_id", "record_type", "refers_to", "payload"]) \
        .where("record_type = 'response'").select(
            "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
            "record_type", "refers_to")
    revisits = read_archives(pages.sparkSession, folder, ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"]) \
        .where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)
