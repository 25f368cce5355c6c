"""WARC archives as a PySpark Python data source, and de-duplicated writing with revisit records (operator 6).

``spark.read.format("warc").load(folder)`` plans one partition for each group of archive files; predicates on record type
and header fields are pushed down.  A reader parses a record's headers first; a record that the predicates drop, or whose
payload isn't asked for, is skipped by its length without being decoded: in ``.warc`` files without being read, in
``.warc.gz`` files (one gzip member for each record) it has to be inflated.  Archives aren't split, so a partition reads
one large file at least.  Ask for fewer columns with ``.schema(...)``: without ``payload`` none is kept.

``df.write.format("warc").mode("append").save(folder)`` writes rolled files whose names begin with ``OWN``.  Manifests of
committed files come last: each is written under another name and moved to the next version's, so a crash before leaves
the last version in force, and own files of failed or repeated tasks are never read.  Archives by others in the folder are
always read; ``overwrite`` leaves them and takes own files out of the manifest.  Paths are URIs that pyarrow's file
systems can reach.

Pages: a null html is an empty payload.  Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the
largest page_id is the response, others revisit it; repeated rows of that page_id are responses all.  A null page_id is
smaller than others; alone with a payload, its rows are responses.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from readloom.llm.common import shared_dir, staged

REVISIT_BYTES = 1000
#: A writer begins a new file at this size; a reader's partition takes files up to this size.
FILE_BYTES = 64 << 20
#: Beginnings of the names of this writer's archives and of manifests' versions.
OWN, MANIFEST = "readloom-part-", "_manifest-"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Field of the WARC header behind each column that predicates can ask for.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _line(value: str) -> str:
    """Header values are single lines."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    """One WARC record, with an HTTP response as its block; a revisit keeps the response's headers only."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row['record_id'])}>", f"WARC-Date: {row.get('date') or '1970-01-01T00:00:00Z'}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row.get("payload_digest"):
        lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row.get("refers_to"):
        lines += [f"WARC-Refers-To: <{_line(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Files(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gz = options["path"].rstrip("/"), options.get("compression") == "gzip"
        self.roll, self.overwrite = int(options.get("filebytes", FILE_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        task, names, out, size = TaskContext.get(), [], None, 0
        stem = f"{OWN}{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    data = record({n: batch.column(n)[i].as_py() for n in batch.schema.names})
                    data = gzip.compress(data, 6, mtime=0) if self.gz else data
                    if out is None or size >= self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"{stem}-{len(names):04d}.warc" + ".gz" * self.gz)
                        out, size = fs.open_output_stream(f"{path}/{names[-1]}", buffer_size=1 << 20, compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        version, old = _manifest(fs, path)
        files = ([] if self.overwrite else old) + [n for m in messages if m for n in m.files]
        part = f"{path}/.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(part, f"{path}/{MANIFEST}{version + 1:010d}.json")

    def abort(self, messages: list[_Files | None]) -> None:
        fs, path = _fs(self.path)
        for m in messages:
            for n in m.files if m else ():
                fs.delete_file(f"{path}/{n}")


def _names(fs, path: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    return sorted(i.base_name for i in fs.get_file_info(FileSelector(path, allow_not_found=True)) if i.type == FileType.File)


def _manifest(fs, path: str) -> tuple[int, list[str]]:
    """The last version (0: none) and its files."""
    found = [n for n in _names(fs, path) if n.startswith(MANIFEST) and n.endswith(".json")]
    if not found:
        return 0, []
    with fs.open_input_stream(f"{path}/{found[-1]}") as f:
        return int(found[-1][len(MANIFEST) : -len(".json")]), json.loads(f.read())["files"]


class _Group(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"].rstrip("/"), [f.name for f in schema.fields]
        self.group = int(options.get("partitionbytes", FILE_BYTES))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, "some", ()))
            else:
                yield f

    def partitions(self) -> list[_Group]:
        fs, path = _fs(self.path)
        names = _manifest(fs, path)[1] + [n for n in _names(fs, path) if n.endswith((".warc", ".warc.gz")) and not n.startswith(OWN)]
        groups: list[list[str]] = []
        size = 0
        for info in fs.get_file_info([f"{path}/{n}" for n in names]):
            if not groups or size + info.size > self.group:
                groups.append([])
                size = 0
            groups[-1].append(info.path)
            size += info.size
        return [_Group(g) for g in groups]

    def _asked(self, row: dict) -> bool:
        for name, how, values in self.wanted:
            v = row.get(name)
            if v is None or how == "in" and v not in values or how == "starts" and not v.startswith(values[0]):
                return False
        return True

    def read(self, partition: _Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files were planned
            return
        types = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        fs, _ = _fs(self.path)
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types.get(c, pa.string())) for c in self.columns], names=self.columns)

        for path in partition.files:
            with fs.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                for row in self._records(stream):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 256
                    if size >= 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    def _records(self, f) -> Iterator[dict]:
        while True:
            line = f.readline()
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = _fields(f)
            length = int(head["content-length"])
            row = {c: head.get(h) for c, h in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                if row[c]:
                    row[c] = _unline(row[c].strip("<>"))
            if row["target_uri"] is not None:
                row["target_uri"] = _unline(row["target_uri"])
            if (row["payload_digest"] or "").startswith("sha1:"):
                row["payload_digest"] = base64.b32decode(row["payload_digest"][5:]).hex()
            if not self._asked(row):
                f.seek(length, 1)
                continue
            if "payload" in self.columns or "payload_bytes" in self.columns:
                left = length
                if (head.get("content-type") or "").startswith("application/http"):
                    at = f.tell()
                    f.readline()
                    http = _fields(f)
                    left -= f.tell() - at
                    row["payload_bytes"] = int(http.get("content-length", left)) if row["record_type"] == "revisit" else left
                else:
                    row["payload_bytes"] = left
                if "payload" in self.columns and row["record_type"] != "revisit":
                    row["payload"] = f.read(left)
                else:
                    f.seek(left, 1)
            else:
                f.seek(length, 1)
            yield row


def _fields(f) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
        out[name.strip().lower()] = value[1:] if value.startswith(" ") else value
    return out


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame) -> DataFrame:
    """The records of ``pages(page_id, url, html)``: digests, and who revisits whom."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Who revisits whom is found without payloads: heads of equal payloads are a table of their own, so that adaptive
    # execution can split a digest that a third of all pages have, and payloads meet the answers by page_id.
    small = p.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_BYTES)
    same = ["payload_digest", "payload_bytes"]
    heads = staged(small.groupBy(*same).agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads")
    revisits = staged(small.join(heads, same).where(~F.col("page_id").eqNullSafe(F.col("keep"))).select("page_id", "payload_digest", "keep").distinct(), "revisits")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.col("keep").isNotNull()
    told = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "keep")
    return p.join(told, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        name("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        "payload_digest",
        F.when(revisit, name("keep")).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """Write ``pages`` to WARC files and return the reader of them."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or shared_dir(spark, "warc")
    records(pages).write.format("warc").options(**options).mode("append").save(folder)
    return spark.read.format("warc").load(folder)
