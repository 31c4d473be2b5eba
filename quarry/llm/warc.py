"""WARC archives: a writer on Spark's text sink and a Python data source that reads headers before payloads."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from quarry.llm.common import new_folder, stored, table

#: Equal payloads of at least so many bytes are stored once; the others become revisit records.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Buckets of digests; a bound on what is broadcast (8 bytes each).
BUCKETS = 1 << 20
#: Records in one archive file, and bytes of archives that one read task takes.
RECORDS_PER_FILE = 20_000
BYTES_PER_PARTITION = 128 << 20

_EPOCH = "1970-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, content_length long, refers_to string, headers map<string,string>, payload binary"


def _urn(key: Column) -> Column:
    """A record id that depends on nothing but the key: an MD5 in the form of a UUID."""
    h = F.md5(F.concat(F.lit("record|"), key.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(key, uri, payload, digest, refers_to): which page keeps its payload and which refers to another.

    Of pages with equal payloads (equal SHA-256 and length) of at least ``revisit_bytes`` bytes the one with the largest
    key keeps it; refers_to is null there and that key elsewhere. Null payloads are empty ones. Copies are counted by
    digest with partial sums and met again by a join, so a payload that a third of the pages share is no group of rows.
    Only pages whose digest falls into a bucket with a repeated digest take part in that join; the buckets are a table of
    bounded size, so it is broadcast, and the other payloads are not shuffled.
    Rows that repeat the largest key are responses all of them; pages with a null key are responses. Other columns of
    ``pages`` are left out, whatever their names. Empty table: no rows.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= revisit_bytes, F.sha2(F.col("payload").cast("binary"), 256)))
    kept = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("key").alias("holder"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("__same"), "holder")
    kept = stored(kept, "warc-holders")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    buckets = F.broadcast(kept.select(bucket("__same").alias("__bucket")).distinct())  # BUCKETS rows at most
    asked = F.coalesce(bucket("same"), F.lit(-1))
    alone = rows.join(buckets, asked == F.col("__bucket"), "left_anti").withColumn("holder", F.lit(None).cast(kept.schema["holder"].dataType))
    shared = rows.join(buckets, asked == F.col("__bucket"), "left_semi").join(kept, F.col("same") == F.col("__same"), "left").drop("__same")
    refers = F.when(F.col("key") != F.col("holder"), F.col("holder"))
    return alone.unionByName(shared).select("key", "uri", "payload", F.sha1(F.col("payload").cast("binary")).alias("digest"), refers.alias("refers_to"))


def _line(text: Column) -> Column:
    """A header value: line breaks become spaces."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write(rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the rows of ``records`` as uncompressed WARC/1.1 files under ``path``, one record per row.

    Spark's text sink does the writing, so any store that Spark reaches will do, and a task that is lost leaves nothing
    behind. A revisit has no payload; its X-Payload-Length tells the length of the one it refers to. The record's key
    is in X-Record-Key. A table without rows gives an archive without records.
    """
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _urn(F.coalesce(F.col("key").cast("string"), F.concat(F.lit("none|"), "uri", F.lit("|"), "digest")))),
        ("WARC-Date", F.lit(_EPOCH)),
        ("WARC-Target-URI", _line(F.col("uri"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("X-Record-Key", F.col("key").cast("string")),
        ("X-Refers-To-Key", F.col("refers_to").cast("string")),
        ("X-Payload-Length", F.octet_length("payload").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(body).cast("string")),
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), value) for name, value in fields))
    text = rows.select(F.concat(head, F.lit("\r\n\r\n"), body).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse_head(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of a header block; folded lines continue the value before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def scan(file, wanted: dict[str, set], payloads: bool, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of an open file whose headers agree with ``wanted`` (name -> allowed values).

    The header block is read and parsed first. A payload that nobody asks for is passed over by a seek, or by dropping
    buffered bytes, and is neither copied nor decoded; in a gzip archive the seek has to inflate it.
    """
    buffer, at = b"", 0
    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            more = file.read(chunk)
            if not more:
                if buffer[at:].strip():
                    raise ValueError("a WARC header block breaks off")
                return
            buffer, at = buffer[at:] + more, 0
        start = at
        while buffer[start : start + 2] == b"\r\n":
            start += 2
        if start > end:
            at = start
            continue
        if start == end or not buffer.startswith(b"WARC/", start):
            raise ValueError("a WARC record was expected")
        head = parse_head(buffer[start:end])
        length = int(head["content-length"])
        at = end + 4
        take = all(head.get(k) in v for k, v in wanted.items())
        have = len(buffer) - at
        if take and payloads:
            if have < length:
                buffer, at = buffer[at:] + file.read(length - have), 0
                if len(buffer) < length:
                    raise ValueError("a WARC payload breaks off")
            yield head, buffer[at : at + length]
            at += length
        else:
            if take:
                yield head, None
            if have >= length:
                at += length
            else:
                file.seek(length - have, 1)
                buffer, at = b"", 0
        if at > chunk:
            buffer, at = buffer[at:], 0


def open_any(uri: str):
    """Opens a file of any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and ":/" in uri:  # file:/x, as Hadoop writes it
        uri = uri.replace(":/", ":///", 1)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def archive(file):
    """What to read an open file's records from: gzip archives (of one member or many, known by their first bytes) are inflated as they are read."""
    zipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    return gzip.GzipFile(fileobj=file) if zipped else file


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    """Plans groups of whole files by size; takes equality and IN predicates on type and header columns."""

    COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}

    def __init__(self, files: list[tuple[str, int]], columns: list[str], bytes_per_partition: int):
        self.files, self.columns, self.most = files, columns, bytes_per_partition
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = self.COLUMNS.get(f.attribute[0]) if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name:
                self.wanted[name] = self.wanted.get(name, {f.value}) & {f.value}
            elif isinstance(f, In) and name:
                self.wanted[name] = self.wanted.get(name, set(f.value)) & set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, group, size = [], [], 0
        for name, n in sorted(self.files, key=lambda x: (-x[1], x[0])):
            if group and size + n > self.most:
                out.append(_Files(group))
                group, size = [], 0
            group.append(name)
            size += n
        return [*out, _Files(group)] if group or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        get = {
            "record_id": lambda h, p: h.get("warc-record-id"), "record_type": lambda h, p: h.get("warc-type"), "target_uri": lambda h, p: h.get("warc-target-uri"),
            "payload_digest": lambda h, p: h.get("warc-payload-digest"), "content_length": lambda h, p: int(h["content-length"]),
            "refers_to": lambda h, p: h.get("warc-refers-to"), "headers": lambda h, p: h, "payload": lambda h, p: p,
        }
        makers = [get[c] for c in self.columns]
        for uri in partition.files:
            with open_any(uri) as file:
                for head, payload in scan(archive(file), self.wanted, "payload" in self.columns):
                    yield tuple(f(head, payload) for f in makers)


class WarcSource(DataSource):
    """format("warc"). Options: files (JSON list of [uri, bytes]), columns (JSON list), bytes_per_partition."""

    KINDS = dict(c.split(" ") for c in SCHEMA.split(", "))

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _columns(self) -> list[str]:
        return json.loads(self.options.get("columns", "null")) or list(self.KINDS)

    def schema(self) -> str:
        return ", ".join(f"{c} {self.KINDS[c]}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        files = [(f, int(n)) for f, n in json.loads(self.options["files"])]
        return WarcReader(files, self._columns(), int(self.options.get("bytes_per_partition", BYTES_PER_PARTITION)))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """The records of all WARC files under ``path``, plain or gzip. ``columns``: the fields to build (all by default).

    Without "payload" among them no payload is read. Filters on record_type, record_id, target_uri and refers_to are
    decided on the headers. Files are listed by Spark's file system layer; folders without records give no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, files = fs.listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            files.append((f.getPath().toString(), f.getLen()))
    options = {"files": json.dumps(files), "bytes_per_partition": str(bytes_per_partition)} | ({"columns": json.dumps(columns)} if columns else {})
    return spark.read.format("warc").options(**options).load()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write(records(table(spark, sf_dir, "pages")), path)
    head = read(spark, path, ["record_type", "headers", "payload_digest"]).where("record_type = 'revisit'")
    body = read(spark, path, ["record_type", "headers", "payload"]).where("record_type = 'response'")
    key = F.col("headers")["x-record-key"].cast("long").alias("page_id")
    revisits = head.select(
        key, F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", F.col("headers")["x-refers-to-key"].cast("long").alias("refers_to"),
    )
    responses = body.select(key, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN strlen(b) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(b) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""
}
