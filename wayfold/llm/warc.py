"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, to archive files in the shared
folder. The index has two levels. Captures are sorted by their key, which starts with the
reversed host, and cut into compressed blocks of lines (file by file); a sparse directory
holds the first key of each block. A search is a binary search in the directory, one range
read of a block, a binary search among its lines, and a range read of the record in its
archive.

Tasks write files under names that no other attempt uses and return where each record or
block lies. Only what a committed task returned is ever read, so a task that is lost or run
twice leaves a file behind that nothing refers to. Files are reached through pyarrow's
file systems (local, HDFS, S3, GCS) by the address of the shared folder.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, short_batches

#: Lines of a block at least.
LINES = 3000
#: Blocks of an index at most (and one more for each file of it): what the directory can grow to.
BLOCKS = 65_536
#: Bytes of a first key that the directory keeps; a longer one leads to every block it may be in.
KEY_BYTES = 512
#: An archive file ends with the record that takes it beyond this.
ARCHIVE_BYTES = 1 << 30
#: Records within this distance in one file are fetched by one range read, up to ``READ_BYTES``.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
#: Records of one file this far apart may be fetched by different tasks.
SPREAD_BYTES = 1 << 22
#: About so many blocks, and bytes of archives, are read by a task.
TASK_BLOCKS, TASK_BYTES = 64, 1 << 26
DATE = "1970-01-01T00:00:00Z"
RECORD = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Store:
    """Files below one address, by pyarrow's file systems."""

    def __init__(self, address: str) -> None:
        from pyarrow.fs import FileSystem

        self.system, self.top = FileSystem.from_uri(address)

    def new(self, ending: str) -> tuple[str, pa.NativeFile]:
        """A file under a name of its own, open for writing."""
        self.system.create_dir(self.top, recursive=True)
        name = f"{uuid.uuid4().hex}.{ending}"
        return name, self.system.open_output_stream(f"{self.top}/{name}", compression=None)

    def read(self, name: str, at: int, length: int) -> bytes:
        """One range read."""
        with self.system.open_input_file(f"{self.top}/{name}") as source:
            return source.read_at(length, at)


def address(spark: SparkSession, folder: str) -> str:
    """The full address of a folder, as pyarrow takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from last to first, then path and query.

    Scheme, user, port, a leading ``www.`` and the fragment don't count, the host's case
    neither; white space and control characters are written as %20. A URL without a host
    is its own key; null has the empty key.
    """
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"[\x00-\x20]", "%20")
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?]*@)?(?:[wW]{3}\.)?([^/?:]+)(?::[0-9]*)?(.*)$"
    host = F.lower(F.regexp_extract(whole, pattern, 1))
    rest = F.regexp_extract(whole, pattern, 2)
    reverse = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(host == "", whole).otherwise(F.concat(reverse, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def ordinal(page_id: Column) -> Column:
    """Twenty digits in the order of ``page_id``, null last."""
    shifted = page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit("9" * 20))


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, original: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit (``original`` given) has no payload."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + (b"\r\n" if original is not None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    uri = "".join(c if c > " " else "%20" for c in url or "")
    fields = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{page_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest)]
    if original is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{original}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", compresslevel=2, mtime=0)


class Record(NamedTuple):
    """A record that was read: its fields, and the payload (empty for a revisit)."""

    fields: dict[str, str]
    payload: bytes


def parsed(member: bytes) -> Record:
    """The record of one gzip member; its declared lengths must hold."""
    whole = gzip.decompress(member)
    lines, _, rest = whole.partition(b"\r\n\r\n")
    version, *fields = lines.decode().split("\r\n")
    found = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in fields)
    size = int(found["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {found.get('WARC-Record-ID')}")
    return Record(found, rest[:size].partition(b"\r\n\r\n")[2])


def page_of(identifier: str | None) -> int | None:
    """The page_id within a record's id, if it has one."""
    text = (identifier or "").removeprefix(f"<{RECORD}").removesuffix(">")
    return None if text in ("", "None") else int(text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


PAGES = "page_id long, url string, key string, nth string, sha1 string, original long, html binary"
CAPTURES = "key string, nth string, file string, at long, length long"
DIRECTORY = "first binary, file string, at long, length long"
SEARCHES = "block int, search string"
FOUND = "search string, file string, at long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id``, ``url``, ``html``) to archives in
    ``folder`` and returns the captures: key, place in the order of ids, file, offset, length.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest
    ``page_id`` are responses and the others revisit them; smaller payloads are all
    responses. Null html is an empty payload. Rows that repeat the smallest id are responses
    each. Null ids come after all others and are never referred to: if a payload has only
    null ids, all its rows are responses. Further columns are ignored.
    """
    spark, to = pages.sparkSession, f"{address(pages.sparkSession, folder)}/archive"
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")).withColumn("sha1", F.sha1("html"))
    same = own.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = keep(same.where("n > 1").select("sha1", "first"), folder, "same")
    told = own.join(same, "sha1", "left").withColumn("original", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")))
    told = told.withColumn("html", F.when(F.col("original").isNull(), F.col("html"))).withColumns({"key": url_key(F.col("url")), "nth": ordinal(F.col("page_id"))})
    schema = _schema(CAPTURES)

    def run(batches):
        def captures():
            store, name, out = Store(to), "", None
            try:
                for page_id, url, key, nth, sha1, original, html in _rows(batches):
                    if out is None:
                        name, out = store.new("warc.gz")
                        at = 0
                    out.write(data := record(page_id, url, html, sha1, original))
                    yield key, nth, name, at, len(data)
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
            finally:
                if out is not None:
                    out.close()

        return _batches(captures(), schema)

    with short_batches(spark, 256):
        return keep(told.select(*(x.split()[0] for x in PAGES.split(", "))).mapInArrow(run, CAPTURES), folder, "captures")


class CaptureIndex(NamedTuple):
    """Blocks in files below ``folder``, and their directory (a broadcast: sorted first
    keys, and file, offset and length of each block)."""

    folder: str
    directory: Broadcast


def build_index(captures: DataFrame, folder: str, lines: int = LINES, blocks: int = BLOCKS) -> CaptureIndex:
    """Sorts ``captures`` into blocks of ``lines`` lines, or more where there would be over
    ``blocks`` blocks otherwise, so the directory has a bound. Order is by key, then id,
    file and offset, so the captures of one URL spread over as many blocks as they fill."""
    spark, to = captures.sparkSession, f"{address(captures.sparkSession, folder)}/index"
    each = max(lines, math.ceil(captures.count() / blocks))
    order = ["key", "nth", "file", "at"]
    schema = _schema(DIRECTORY)

    def run(batches):
        def directory():
            store, name, out, at, held = Store(to), "", None, 0, []

            def block():
                data = zlib.compress("\n".join(held).encode(), 6)
                out.write(data)
                return held[0].encode()[:KEY_BYTES], name, at, len(data)

            try:
                for key, nth, file, start, length in _rows(batches):
                    if out is None:
                        name, out = store.new("cdx.z")
                    held.append(f"{key} {nth} " + json.dumps({"filename": file, "offset": start, "length": length}))
                    if len(held) == each:
                        yield (found := block())
                        at, held = at + found[3], []
                if held:
                    yield block()
            finally:
                if out is not None:
                    out.close()

        return _batches(directory(), schema)

    made = keep(captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "length").mapInArrow(run, DIRECTORY), folder, "directory")
    # Cut keys may tie; files of one partition are written in order of their blocks.
    found = sorted((bytes(r["first"]), r["file"], r["at"], r["length"]) for r in made.toLocalIterator())
    return CaptureIndex(to, spark.sparkContext.broadcast(found))


def spark_tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def find(index: CaptureIndex, searches: DataFrame) -> DataFrame:
    """Captures whose line starts with a string of the column ``search``: a key and a
    space for all captures of a URL, with an :func:`ordinal` after it for one of them, or
    the start of a key for a site. Returns ``search``, ``file``, ``at``, ``length``; strings
    are searched once each, nulls never."""
    once = searches.where("search is not null").select(F.col("search").cast("string")).distinct()
    schema, told, to, directory = _schema(SEARCHES), _schema(FOUND), index.folder, index.directory

    def route(batches):
        def blocks():
            firsts = [x[0] for x in directory.value]
            for (search,) in _rows(batches):
                own = search.encode()[:KEY_BYTES]
                for k in range(max(0, bisect.bisect_left(firsts, own) - 1), bisect.bisect_right(firsts, own + b"\xff")):
                    yield k, search

        return _batches(blocks(), schema)

    def look(batches):
        def found():
            store, now, lines = Store(to), None, []
            for k, search in _rows(batches):
                if k != now:
                    _, file, at, length = directory.value[k]
                    now, lines = k, zlib.decompress(store.read(file, at, length)).split(b"\n")
                own = search.encode()
                for line in lines[bisect.bisect_left(lines, own) :]:
                    if not line.startswith(own):
                        break
                    place = json.loads(line[line.index(b" {") :])
                    yield search, place["filename"], place["offset"], place["length"]

        return _batches(found(), told)

    # By a number of its own: what a task reads from blocks is far more than it gets by the shuffle.
    tasks = max(spark_tasks(searches.sparkSession), math.ceil(len(directory.value) / TASK_BLOCKS))
    return once.mapInArrow(route, SEARCHES).repartition(min(tasks, max(1, len(directory.value))), "block").sortWithinPartitions("block", "search").mapInArrow(look, FOUND)


def read_records(places: DataFrame, folder: str, tasks: int = 1) -> DataFrame:
    """The records at ``places`` (``file``, ``at``, ``length``) of the archives in
    ``folder``, by range reads that fetch neighbours together, in ``tasks`` tasks or as many
    as there are cores.

    A response has the length and the base32 SHA-1 of the payload that was read; it must
    be the one that the record declares. A revisit has its declared digest and a null
    length, see :func:`resolved`."""
    to, schema = f"{address(places.sparkSession, folder)}/archive", _schema(RECORDS)

    def run(batches):
        store = Store(to)

        def members():
            group: list[tuple[str, int, int]] = []

            def fetched():
                file, start, _ = group[0]
                data = store.read(file, start, group[-1][1] + group[-1][2] - start)
                return [data[at - start : at - start + length] for _, at, length in group]

            for file, at, length in _rows(batches):
                if group and (file != group[0][0] or at - group[-1][1] - group[-1][2] > GAP_BYTES or at + length - group[0][1] > READ_BYTES):
                    yield from fetched()
                    group = []
                group.append((file, at, length))
            if group:
                yield from fetched()

        def records():
            for member in members():
                fields, payload = parsed(member)
                declared, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != declared:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
                yield page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page_of(fields.get("WARC-Refers-To")), len(payload) if kind == "response" else None, declared

        return _batches(records(), schema)

    near = F.floor(F.col("at") / SPREAD_BYTES)
    return places.select("file", "at", "length").repartition(max(tasks, spark_tasks(places.sparkSession)), "file", near).sortWithinPartitions("file", "at").mapInArrow(run, RECORDS)


def resolved(records: DataFrame, folder: str) -> DataFrame:
    """``records`` with the payload length of each revisit, from the response it refers to."""
    responses = records.where("record_type = 'response'")
    known = responses.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full"))
    known = keep(known.withColumnRenamed("page_id", "refers_to"), folder, "known")
    revisits = records.where("record_type = 'revisit'").join(known, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits.withColumn("payload_bytes", F.col("full")).drop("full"))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` to archives, indexes them, finds each page by its key and id in the
    index and reads its record back: ``page_id``, ``url``, ``record_type``, ``refers_to``,
    ``payload_bytes``, ``payload_digest`` of every row (see :func:`write_archives` for
    nulls and repeated rows). An empty table gives an empty result."""
    folder = shared_folder(pages.sparkSession)
    captures = write_archives(pages, folder, least)
    index = build_index(captures, folder)
    search = F.concat(url_key(F.col("url").cast("string")), F.lit(" "), ordinal(F.col("page_id").cast("long")), F.lit(" "))
    places = find(index, pages.select(search.alias("search")))
    tasks = math.ceil((captures.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES)
    return resolved(keep(read_records(places, folder, tasks), folder, "records"), folder)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record type, payload digest and length of every page, from the archives."""
    found = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(hexadecimal: str) -> str:
    """SQL for the base32 of 40 hex digits: five of them are twenty bits, so four letters."""
    value = "cast('0x' || substr({0}, {1}, 5) as bigint)"
    letters = (f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({value.format(hexadecimal, 5 * k + 1)}) >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0))
    return " || ".join(letters)


ORACLE_SQL = f"""
with own as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), told as (
  select *, min(page_id) over (partition by hex) as first_id from own
)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {_base32("hex")} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from told
"""
