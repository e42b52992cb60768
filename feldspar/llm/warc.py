"""WARC archives as a PySpark Python data source.

Reading: files are planned into partitions of bounded bytes, and large archives written here are split; predicates on the record type and other headers are pushed
down and decided from the headers alone; the payload of an unwanted record is neither inflated nor decoded. Compressed
archives are one gzip member a record; members written here carry their compressed length (the ``sl`` extra field of
the WARC standard's annex), so a reader seeks past them, and other members are inflated to find their end. Line breaks
between records are skipped; a Content-Length that is no number is replaced by the record's real length; a record that
is cut short, or anything that isn't a record, raises a ValueError that names the file and position.

Writing: each task writes one archive of its own name; the driver lists the finished ones in a manifest, so files of
lost or repeated tasks are never read. Paths are URIs that ``pyarrow.fs`` opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from ._common import salted_representatives, shared_dir

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, content_length bigint, headers map<string,string>, payload binary"
ARROW = pa.schema([(n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")] + [("payload_length", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Header fields of the columns that predicates can be pushed to. Fixed values of the WARC format, but for the last.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_length": "Content-Length", "payload_length": "X-Payload-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest-"
HEAD = 16_384


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")
    return fs, inner.rstrip("/")


def parse_head(data: bytes) -> dict[str, str]:
    """Header fields of a record, the version line left out; folded lines are joined."""
    lines = data.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _value(head: dict[str, str], column: str):
    low = {k.lower(): v for k, v in head.items()}
    got = low.get(FIELDS[column].lower())
    if got is None or not column.endswith("length"):
        return got
    return int(got) if re.fullmatch(r"[0-9]{1,18}", got) else None


def _test(f) -> bool:
    return len(f.attribute) == 1 and f.attribute[0] in FIELDS


def holds(f, head: dict[str, str]) -> bool:
    """Whether a pushed predicate holds for a record's headers; a missing field satisfies none."""
    v = _value(head, f.attribute[0])
    if v is None:
        return False
    match f:
        case IsNotNull():
            return True
        case EqualTo():
            return v == f.value
        case In():
            return v in f.value
        case StringStartsWith():
            return v.startswith(f.value)
        case StringEndsWith():
            return v.endswith(f.value)
        case GreaterThan():
            return v > f.value
        case GreaterThanOrEqual():
            return v >= f.value
        case LessThan():
            return v < f.value
        case LessThanOrEqual():
            return v <= f.value
    raise ValueError(f)


PUSHED = (IsNotNull, EqualTo, In, StringStartsWith, StringEndsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


#: How a gzip member begins that states its length as written below.
OWN = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"


def _member_length(data: bytes) -> int | None:
    """The compressed length that a gzip member states, if it does."""
    if len(data) < 12 or not data[3] & 4:
        return None
    (size,) = struct.unpack_from("<H", data, 10)
    at, end = 12, 12 + size
    while at + 4 <= min(end, len(data)):
        (n,) = struct.unpack_from("<H", data, at + 2)
        if data[at : at + 2] == b"sl" and n == 8:
            return struct.unpack_from("<I", data, at + 4)[0]
        at += 4 + n
    return None


def first_own(file: pa.NativeFile, size: int, at: int, step: int = 1 << 20) -> int:
    """Where the first member that states its length begins at or after ``at``; the end of the file where none does."""
    while at < size:
        data = file.read_at(min(step + len(OWN), size - at), at)
        found = data.find(OWN)
        if found >= 0:
            return at + found
        at += step
    return size


def _inside(plain: bytes, path: str, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an inflated member."""
    place = 0
    while True:
        place += len(plain) - place - len(plain[place:].lstrip(b"\r\n"))
        if place >= len(plain):
            return
        top = plain.find(b"\r\n\r\n", place)
        if top < 0 or not plain.startswith(b"WARC/", place):
            raise ValueError(f"{path}: no record in the member at {at}")
        head = parse_head(plain[place:top])
        n = _value(head, "content_length")
        if n is None:
            n = len(plain) - top - 4 - 4 * plain.endswith(b"\r\n\r\n")
        if top + 4 + n > len(plain):
            raise ValueError(f"{path}: a record in the member at {at} is cut short")
        yield head, plain[top + 4 : top + 4 + n]
        place = top + 4 + n


def _plain_end(file: pa.NativeFile, size: int, at: int, step: int = 1 << 20) -> int:
    """Where the block that begins at ``at`` ends if its length isn't told: before the next record or the file's end."""
    mark, begin = b"\r\n\r\nWARC/", at
    while at < size:
        found = file.read_at(min(step + len(mark), size - at), at).find(mark)
        if found >= 0:
            return at + found
        at += step
    return max(begin, size - 4 if file.read_at(min(4, size), max(0, size - 4)) == b"\r\n\r\n" else size)


def records(fs: pyarrow.fs.FileSystem, path: str, wanted, payloads: bool, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the wanted records; the block is None where payloads aren't asked for.

    With ``start`` and ``end``: from the first own member at or after ``start`` to the last record before the first own
    member at or after ``end``, so the parts of a file have each record once.
    """
    with fs.open_input_file(path) as file:
        size = file.size()
        at = first_own(file, size, start) if start else 0
        while at < size:
            data = file.read_at(min(HEAD, size - at), at)
            if end is not None and at >= end and data.startswith(OWN):
                return
            if data[:2] == b"\x1f\x8b":
                length, inflate = _member_length(data), zlib.decompressobj(31)
                plain, read = inflate.decompress(data, HEAD), len(data)

                def more() -> bool:
                    nonlocal plain, read
                    rest = inflate.unconsumed_tail
                    if not rest and not inflate.eof and at + read < size:
                        rest = file.read_at(min(1 << 20, size - at - read), at + read)
                        read += len(rest)
                    got = inflate.decompress(rest, 1 << 20) if rest else b""
                    plain += got
                    return bool(got or rest)

                while b"\r\n\r\n" not in plain and not inflate.eof and more():
                    pass
                head = parse_head(plain.lstrip(b"\r\n").partition(b"\r\n\r\n")[0])
                keep = wanted(head)
                if length is None or (keep and payloads):
                    while not inflate.eof and more():
                        pass
                    if not inflate.eof:
                        raise ValueError(f"{path}: a member at {at} has no end")
                    found = _inside(plain, path, at)
                    yield from ((h, b if payloads else None) for h, b in found if wanted(h))
                    length = read - len(inflate.unused_data) if length is None else length
                elif keep:
                    yield head, None
                if at + length > size:
                    raise ValueError(f"{path}: the member at {at} is cut short")
                at += length
                continue
            blank = len(data) - len(data.lstrip(b"\r\n"))
            if blank:
                at += blank
                continue
            while b"\r\n\r\n" not in data and at + len(data) < size:
                data += file.read_at(min(HEAD, size - at - len(data)), at + len(data))
            top, found, _ = data.partition(b"\r\n\r\n")
            if not found or not top.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {at}")
            head, begin = parse_head(top), at + len(top) + 4
            n = _value(head, "content_length")
            if n is None:
                n = _plain_end(file, size, begin) - begin
            if begin + n > size:
                raise ValueError(f"{path}: the record at {at} is cut short")
            if wanted(head):
                yield head, file.read_at(n, begin) if payloads else None
            at = begin + n


class Files(InputPartition):
    """(path, start, end) of files and parts of files."""

    def __init__(self, parts: list[tuple[str, int, int | None]]) -> None:
        self.parts = parts


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("maxpartitionbytes", 32 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, PUSHED) and _test(f):
                self.filters.append(f)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        fs, inner = _fs(self.path)
        info = fs.get_file_info(inner)
        if info.type == pyarrow.fs.FileType.File:
            return [(inner, info.size)]
        found = {x.path: x.size for x in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if x.type == pyarrow.fs.FileType.File}
        manifests = [p for p in found if p.rpartition("/")[2].startswith(MANIFEST)]
        if manifests:  # one a write; what no manifest names was left by a task that didn't commit
            named = set()
            for path in manifests:
                with fs.open_input_file(path) as f:
                    named |= set(json.loads(f.read()))
            return sorted((f"{inner}/{n}", found[f"{inner}/{n}"]) for n in named)
        return sorted((p, n) for p, n in found.items() if re.search(r"\.warc(\.gz)?$", p))

    def partitions(self):
        fs, _ = _fs(self.path)
        out, held, size = [], [], 0
        for path, n in self.files():
            if n > self.most:
                with fs.open_input_file(path) as file:
                    own = file.read_at(len(OWN), 0) == OWN
                if own:  # its members can be told from any place in the file
                    ends = [*range(self.most, n, self.most), n]
                    out += [Files([(path, a, b)]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    continue
            if held and size + n > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, 0, None))
            size += n
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition):
        fs, _ = _fs(self.path)
        rows, size = [], 0
        for path, start, end in partition.parts:
            for head, block in records(fs, path, lambda h: all(holds(f, h) for f in self.filters), self.payloads, start, end):
                payload = block
                if block is not None and block.startswith(b"HTTP/"):
                    payload = block.partition(b"\r\n\r\n")[2]
                if _value(head, "warc_type") == "revisit":
                    payload = None
                rows.append((*(_value(head, c) for c in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length", "content_length")), list(head.items()), payload))
                size += len(block or b"") + 500
                if size > 4 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def record(head: dict[str, str], block: bytes, compress: bool) -> bytes:
    """One record, as a gzip member of stated length where ``compress``."""
    clean = {k: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v) for k, v in head.items() if v is not None}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    plain = text.encode() + block + b"\r\n\r\n"
    if not compress:
        return plain
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(plain) + z.flush()
    length = 10 + 2 + 12 + len(packed) + 8
    extra = struct.pack("<2sHII", b"sl", 8, length, len(plain)) if max(length, len(plain)) < 1 << 32 else b""
    top = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\0") + b"\0\0\0\0\0\xff" + (struct.pack("<H", len(extra)) + extra if extra else b"")
    return top + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload)."""

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.compress, self.overwrite = options["path"], options.get("compression", "gzip") == "gzip", overwrite

    def write(self, iterator):
        fs, inner = _fs(self.path)
        fs.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
        n = 0
        with fs.open_output_stream(f"{inner}/{name}", compression=None) as out:
            out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", self.compress))
            for batch in iterator:
                for r in batch.to_pylist():
                    revisit = r["record_type"] == "revisit"
                    head = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": r["payload_digest"], "X-Payload-Length": str(r["payload_length"]), "Content-Type": "application/http; msgtype=response"}
                    if revisit:
                        head |= {"WARC-Refers-To": r["refers_to"], "WARC-Profile": PROFILE}
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_length']}\r\n\r\n".encode()
                    out.write(record(head, http if revisit else http + (r["payload"] or b""), self.compress))
                    n += 1
        return Written(name, n)

    def commit(self, messages) -> None:
        """Adds this write's manifest; an overwriting write then removes those there were, with their files."""
        fs, inner = _fs(self.path)
        fs.create_dir(inner, recursive=True)
        old = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if x.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{inner}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m and m.rows)).encode())
        for path in old:
            with fs.open_input_file(path) as f:
                names = json.loads(f.read())
            fs.delete_file(path)
            for name in names:
                fs.delete_file(f"{inner}/{name}")

    def abort(self, messages) -> None:
        fs, inner = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{inner}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payloads: bool = True, partition_bytes: int = 32 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payloads).lower()).option("maxpartitionbytes", partition_bytes).load(path)


def _base32(batches):
    """Appends the bare base32 SHA-1 of the payload."""
    for batch in batches:
        digest = [base64.b32encode(hashlib.sha1(x or b"").digest()).decode() for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.string())], [*batch.schema.names, "digest"])


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records to write: of equal payloads of at least ``least_bytes`` the largest id is a response, others revisit it.

    Payloads are compared by SHA-256 and length. A digest that holds a third of all pages is salted. Null html is an
    empty payload; null urls leave the field out. Null ids count as smallest; rows that repeat the largest id with the
    same payload are responses too. Two pages of one id and other payloads are two records of one record id.
    """
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_length", F.octet_length("payload").cast("bigint")).withColumn("_key", F.concat(F.sha2("payload", 256), F.lit(":"), F.col("payload_length")))
    base = base.withColumn("_minus", -F.coalesce("page_id", F.lit(-(2**63) + 1)))
    rows = salted_representatives(base, "_key", "_minus")
    first = (F.col("_minus") == F.col("rep")) | (F.col("payload_length") < least_bytes)
    named = "page_id bigint, target_uri string, payload binary, payload_length bigint, record_type string, _refers bigint"
    rows = rows.select("page_id", "target_uri", "payload", "payload_length", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, -F.col("rep")).alias("_refers"))
    rows = rows.mapInArrow(_base32, named + ", digest string")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(urn("page_id").alias("record_id"), "record_type", "target_uri", F.when(F.col("_refers").isNotNull(), urn("_refers")).alias("refers_to"), F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), "payload_length", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("compression", compression).save(path)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (of responses).

    Responses are read with their payloads, and their length and digest are taken from these; for revisits only headers
    are parsed.
    """
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("bigint")
    full = read_warc(spark, path).where("warc_type = 'response'").select("record_id", "refers_to", "warc_type", "payload")
    full = full.withColumn("payload", F.coalesce("payload", F.lit(b""))).mapInArrow(_base32, "record_id string, refers_to string, warc_type string, payload binary, digest string")
    full = full.select("record_id", "warc_type", "refers_to", F.octet_length("payload").cast("bigint").alias("n"), "digest")
    again = read_warc(spark, path, payloads=False).where("warc_type = 'revisit'")
    again = again.select("record_id", "warc_type", "refers_to", F.col("payload_length").alias("n"), F.regexp_replace("payload_digest", "^sha1:", "").alias("digest"))
    return full.unionByName(again).select(number("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into a new folder of the shared place and reads the archives back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return archive_index(spark, path)
