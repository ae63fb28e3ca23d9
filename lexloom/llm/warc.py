"""WARC files as a PySpark Python data source, for reading and writing.

``register(spark)`` adds the format ``warc``. A read plans its partitions from the file list: files
are packed up to ``partition_bytes`` (option; 64 MiB), a larger file is a partition of its own. Record headers are
parsed first; predicates on record type and other headers are pushed down to that point, and the block
of a record that fails them is passed over (by seeking in a plain file, by inflating and dropping in a gzipped
one) and never decoded. ``http_status`` is tested on the HTTP head alone, before the body is read. Only the columns of
the schema given to the reader are made, so leaving out ``payload`` and ``text`` leaves out their work.

Spark 4.1 keeps the pushed filters with the relation: a DataFrame of a source that is used in two queries with other
filters would be read with the first ones. Spark's own pushdown is therefore an option, ``pushdown``, to be set to
``true`` where a relation serves one query, as ``read_warc`` with ``where`` makes it for each call. Without it
Spark filters after the read and all uses are right.

Options of a read: ``pushdown``; ``partition_bytes``; ``mode``: ``fail`` (default) or ``permissive``, which ends a
damaged file at its last whole record; ``header.NAME``: only records whose header has this value.

A write makes one file for each task under a name of its own and gives it its final name when the job commits, so
that a task that ran twice counts once. Columns (by name, others are ignored): ``record_type``,
``target_uri``, ``date``, ``content_type``, ``headers`` (map), ``payload`` (the whole block).

Defined results: a missing header is null; an empty or missing block has length 0; header names are
read in lower case, of repeated ones the last counts; a text that isn't valid in its charset has U+FFFD in place;
an unknown charset is read as UTF-8; a body in a content encoding that can't be undone here (``br``; ``zstd`` without its
module) has a null text, while its payload holds the bytes; a length that is negative or no number, and a record head of more than
4 MiB, are damage; line ends in written header values become spaces; files that are
empty give no rows; names that begin with ``_`` or ``.`` aren't read; a null ``record_type`` is written as ``resource``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..session import new_dir, ship

try:
    import zstandard
except ModuleNotFoundError:  # bodies in this encoding then have a null text
    zstandard = None

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, text string"
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "content_length": "content-length"}
PARTITION_BYTES, CHUNK, BATCH_ROWS, BATCH_BYTES, EPOCH = 64 << 20, 1 << 20, 1024, 8 << 20, "1970-01-01T00:00:00Z"
ARROW = {"content_length": pa.int64(), "http_status": pa.int32(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string()), "http_headers": pa.map_(pa.string(), pa.string())}


class Damaged(ValueError):
    pass


class Bytes:
    """A stream of plain bytes over a plain or a gzipped file (of any number of members)."""

    def __init__(self, store: fs.FileSystem, path: str, size: int):
        self.file, self.left = store.open_input_file(path), size
        self.buffer, self.at, self.inflate = b"", 0, None
        self.gzip = self.file.read(2) == b"\x1f\x8b"
        self.file.seek(0)

    def _more(self) -> bool:
        """Append what comes next; False at the end."""
        if not self.gzip:
            new = self.file.read(CHUNK)
        else:
            new = b""
            while not new:
                raw = self.inflate.unconsumed_tail or self.inflate.unused_data if self.inflate else b""
                raw = raw or self.file.read(CHUNK)
                if not raw:
                    if self.inflate and not self.inflate.eof:
                        raise Damaged("a gzip member ends early")
                    return False
                if self.inflate is None or self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                try:
                    new = self.inflate.decompress(raw, 4 * CHUNK)
                except zlib.error as error:
                    raise Damaged(str(error)) from error
        if not new:
            return False
        self.buffer, self.at = self.buffer[self.at :] + new, 0
        return True

    def head(self) -> bytes | None:
        """All up to an empty line, without line ends before; None at the end of the file."""
        while True:
            while self.at < len(self.buffer) and self.buffer[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.buffer):
                break
            if not self._more():
                return None
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if len(self.buffer) - self.at > 4 * CHUNK or not self._more():
                raise Damaged("a record header ends early")
        out, self.at = self.buffer[self.at : end], end + 4
        return out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need > 0:
            if self.at == len(self.buffer) and not self._more():
                raise Damaged("a record block ends early")
            parts.append(self.buffer[self.at : self.at + need])
            self.at += len(parts[-1])
            need -= len(parts[-1])
        return b"".join(parts)

    def until(self, mark: bytes, limit: int) -> bytes:
        """All up to ``mark`` and with it; the next ``limit`` bytes if it isn't in them."""
        while (end := self.buffer.find(mark, self.at, self.at + limit)) < 0 and len(self.buffer) - self.at < limit:
            if not self._more():
                raise Damaged("a record block ends early")
        return self.take(limit if end < 0 else end + len(mark) - self.at)

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer) - self.at)
        self.at += have
        n -= have
        if n and not self.gzip:
            if self.file.tell() + n > self.left:
                raise Damaged("a record block ends early")
            self.file.seek(self.file.tell() + n)
            self.buffer, self.at = b"", 0
            return
        while n:
            if not self._more():
                raise Damaged("a record block ends early")
            have = min(n, len(self.buffer) - self.at)
            self.at += have
            n -= have


def fields(lines: bytes) -> dict[str, str]:
    """Header lines as a map; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def test(f: Filter, get) -> bool | None:
    """A filter over a record's values as SQL has it: None is unknown."""
    if isinstance(f, Not):
        x = test(f.child, get)
        return None if x is None else not x
    v = get(f.attribute[0])
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None or (not isinstance(f, In) and f.value is None):
        return None
    if isinstance(f, In):
        return True if v in [x for x in f.value if x is not None] else None if None in f.value else False
    return {EqualTo: lambda: v == f.value, GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value, StringStartsWith: lambda: v.startswith(f.value), StringEndsWith: lambda: v.endswith(f.value), StringContains: lambda: f.value in v}[type(f)]()


KINDS = (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)


def pushable(f: Filter, names: Iterable[str]) -> bool:
    while isinstance(f, Not):
        f = f.child
    return isinstance(f, KINDS) and len(f.attribute) == 1 and f.attribute[0] in names


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body  # not chunked after all
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def inflated(body: bytes, coding: str) -> bytes | None:
    """The body without a content encoding; None if that can't be undone here."""
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # some servers send deflate without its frame
            try:
                return zlib.decompress(body, bits)
            except zlib.error:
                continue
        return body  # already decoded by the crawler, as often
    if coding == "zstd" and zstandard is not None:
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return body
    return body if coding in ("", "identity") else None


def decoded(body: bytes, head: dict[str, str]) -> str | None:
    """The text of an HTTP body or a block."""
    if "chunked" in head.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed(head.get("content-encoding", "").lower().split(",")):
        body = inflated(body, coding.strip())
        if body is None:
            return None
    _, _, charset = head.get("content-type", "").lower().partition("charset=")
    try:
        return body.decode(charset.split(";")[0].strip(" \"'") or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.paths = schema.names, options["path"]
        self.pack = int(options.get("partition_bytes", PARTITION_BYTES))
        self.permissive = options.get("mode", "fail").lower() == "permissive"
        self.given = {k[7:].lower(): v for k, v in options.items() if k.lower().startswith("header.")}
        self.on_header: list[Filter] = []
        self.on_http: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        packs: list[list[tuple[str, int]]] = []
        size = self.pack
        for path, n in sorted(files(self.paths)):
            if size + n > self.pack:
                packs.append([])
                size = 0
            packs[-1].append((path, n))
            size += n
        return [InputPartition(p) for p in packs] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, n in partition.value:
            for row, size in self._file(path, n):
                rows.append(row)
                held += size
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, ARROW.get(k, pa.string())) for k, c in zip(self.names, zip(*rows))], names=self.names)

    def _file(self, path: str, n: int) -> Iterator[tuple[tuple, int]]:
        store, at = fs.FileSystem.from_uri(path)
        stream = Bytes(store, at, n)
        try:
            while (head := stream.head()) is not None:
                row = self._record(stream, head)
                if row is not None:
                    yield row
        except Damaged:
            if not self.permissive:
                raise
        finally:
            stream.file.close()

    def _record(self, stream: Bytes, head: bytes) -> tuple[tuple, int] | None:
        version, _, rest = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise Damaged(f"no record begins with {version[:20]!r}")
        header = fields(rest)
        stated = header.get("content-length", "0")
        if not (stated.isascii() and stated.isdigit()):
            raise Damaged(f"a record of length {stated!r}")
        length = int(stated)

        def get(name: str):
            return length if name == "content_length" else header.get(HEADER[name])

        if not all(test(f, get) is True for f in self.on_header) or any(header.get(k) != v for k, v in self.given.items()):
            stream.skip(length)
            return None
        wanted = set(self.names)
        values: dict = {k: get(k) for k in HEADER if k in wanted}
        values["headers"] = list(header.items())
        if self.on_http or wanted & {"http_status", "http_headers", "payload", "text"}:
            http, status, top = {}, None, b""
            if (get("content_type") or "").startswith("application/http"):
                top = stream.until(b"\r\n\r\n", min(length, 4 * CHUNK))
            left = length - len(top)
            if top[:5] == b"HTTP/":
                first, _, lines = top.removesuffix(b"\r\n\r\n").partition(b"\r\n")
                http, code, top = fields(lines), first.split(b" ")[1:2], b""
                status = int(code[0]) if code and code[0].isdigit() else None
            if not all(test(f, lambda _: status) is True for f in self.on_http):
                stream.skip(left)
                return None
            values |= {"http_status": status, "http_headers": list(http.items())}
            if wanted & {"payload", "text"}:
                body = top + stream.take(left)
            else:
                stream.skip(left)
            if "payload" in wanted:
                values["payload"] = body
            if "text" in wanted:
                values["text"] = decoded(body, http or {"content-type": get("content_type") or ""})
        else:
            stream.skip(length)
        return tuple(values.get(k) for k in self.names), length


class PushingReader(WarcReader):
    """As ``WarcReader``, and takes predicates from Spark's planner."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if pushable(f, HEADER):
                self.on_header.append(f)
            elif pushable(f, ("http_status",)):
                self.on_http.append(f)
            else:
                yield f


def files(paths: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files under a comma list of files and folders."""
    out = []
    for path in paths.split(","):
        uri = path.strip() if "://" in path else "file://" + path.strip() if path.strip().startswith("/") else path.strip()
        store, at = fs.FileSystem.from_uri(uri)
        base = uri[: len(uri) - len(at)] if uri.endswith(at) else uri.split("://")[0] + "://"
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        out += [(base + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
    return out


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        uri = options["path"]
        self.uri, self.overwrite, self.level = uri if "://" in uri else "file://" + uri, overwrite, int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = fs.FileSystem.from_uri(self.uri)
        store.create_dir(at, recursive=True)
        path, out = f"{at}/_{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(path, compression=None)
                c = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                out.write(c.compress(record(row)) + c.flush())
        if out:
            out.close()
        return Written(path if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.uri)
        store.create_dir(at, recursive=True)
        kept = {m.path for m in messages if m and m.path}
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.path not in kept:
                    store.delete_file(f.path)
        for path in kept:
            folder, _, name = path.rpartition("/")
            store.move(path, f"{folder}/part-{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


def record(row: dict) -> bytes:
    """One record as bytes."""
    payload = row.get("payload") or b""
    payload = payload.encode() if isinstance(payload, str) else payload
    extra = row.get("headers") or {}
    given = {"WARC-Type": row.get("record_type") or "resource", "WARC-Target-URI": row.get("target_uri"), "WARC-Date": row.get("date") or EPOCH, "Content-Type": row.get("content_type"), **dict(extra)}
    given.setdefault("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")
    head = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in given.items() if v is not None and k.lower() != "content-length")
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session and let it push filters into Python sources."""
    ship(spark).dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, where=None, **options: str) -> DataFrame:
    """Records as a DataFrame; ``where``, a condition in SQL or a column, is pushed down as far as it can be."""
    rows = register(spark).read.format("warc").schema(schema).options(**options)
    return rows.load(path) if where is None else rows.option("pushdown", "true").load(path).filter(where)


def page_records(pages: DataFrame) -> DataFrame:
    """A request and a response record of each row of ``pages`` (``page_id``, ``url``, ``html``)."""
    own = F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"))
    response = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8"), F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    request = F.encode(F.lit("GET / HTTP/1.1\r\n\r\n"), "utf-8")
    one = lambda kind, block: F.struct(F.lit(kind).alias("record_type"), F.col("url").alias("target_uri"), F.lit(f"application/http; msgtype={kind}").alias("content_type"), own.alias("headers"), block.alias("payload"))
    return pages.select(F.explode(F.array(one("request", request), one("response", response))).alias("r")).select("r.*")


def write_warc(records: DataFrame, path: str) -> str:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)
    return path


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read again: the response records alone, their requests' blocks passed over."""
    path = write_warc(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), new_dir(spark, "warc"))
    schema = "record_type string, target_uri string, headers map<string,string>, http_status int, text string"
    rows = read_warc(spark, path, schema, where="record_type = 'response' and http_status = 200")
    return rows.select(F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


SQL = "SELECT page_id, url, length(coalesce(html, ''))::BIGINT AS n_chars, md5(coalesce(html, '')) AS digest FROM pages"
