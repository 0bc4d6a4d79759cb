"""WARC output: records compressed one by one with a Zstandard dictionary that the file itself carries.

A file (.warc.zst) begins with a skippable frame that holds the dictionary, made from records of that
file; each WARC 1.1 record follows as a frame of its own. Pages with the payload of another page become
revisit records without payload.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gleaner.llm.common import cut, join_hot, new_folder, table
from gleaner.llm.token_files import open_store

DICTIONARY_FRAME = 0x184D2A5D  # skippable frame that holds a dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACE_OF_IDS = uuid.UUID("6f1d5c6e-3d5b-4a0f-9c55-0d2f5f6f7a11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page_id}' if page_id is not None else f'none:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header and names the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload; raises ValueError where lengths or the digest disagree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != int(inner["Content-Length"]) or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError("payload doesn't match its length or digest")
    return fields, inner, payload


def train_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary from `records`; empty where there is too little to learn from."""
    if len(records) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


class WarcWriter:
    """Holds records until `sample_bytes` of them are there, trains the dictionary on these, then streams."""

    def __init__(self, sink, dictionary_size: int, sample_bytes: int, level: int):
        self.sink, self.dictionary_size, self.sample_bytes, self.level = sink, dictionary_size, sample_bytes, level
        self.held: list[bytes] = []
        self.held_bytes, self.codec = 0, None

    def _start(self) -> None:
        dictionary = train_dictionary(self.held, self.dictionary_size)
        if dictionary:
            self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        self.codec = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        for record in self.held:
            self.sink.write(self.codec.compress(record))
        self.held = []

    def add(self, record: bytes) -> None:
        if self.codec:
            self.sink.write(self.codec.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.sample_bytes:
            self._start()

    def close(self) -> None:
        if not self.codec:
            self._start()
        self.sink.close()


def read_records(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file, one at a time; needs no more than a chunk and a record in memory."""
    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    codec = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, out = codec.decompressobj(), []
    while True:
        data = data or source.read(chunk)
        if not data:
            if out:
                raise ValueError("the last record is cut off")
            return
        out.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(out)
            data, frame, out = frame.unused_data, codec.decompressobj(), []


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html and `refers_to`: the largest page_id with an equal payload of at least `min_bytes` bytes.

    Null for that page itself, for smaller or single payloads, and for null ids. Only digests are
    grouped and joined, those of a page that is everywhere salted; the pages move once, by page_id.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    large = pages.filter(F.octet_length("html") >= min_bytes).filter(F.col("page_id").isNotNull()).select("page_id", F.sha1(F.col("html").cast("binary")).alias("_digest"))
    groups = large.groupBy("_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least"), F.count("*").alias("n"))
    groups = cut(groups.filter(F.col("refers_to") > F.col("_least")).drop("_least"))
    repeats = join_hot(large, groups.drop("n"), "_digest", groups).filter(F.col("page_id") < F.col("refers_to"))
    repeats = repeats.select(F.col("page_id").alias("_page"), F.col("_digest"), "refers_to").distinct()
    keyed = pages.withColumn("_sha1", F.sha1(F.col("html").cast("binary")))
    return keyed.join(repeats, (keyed["page_id"] == repeats["_page"]) & (keyed["_sha1"] == repeats["_digest"]), "left").select("page_id", "url", "html", "_sha1", "refers_to")


#: A task goes on to a new archive when one has so many bytes of records, before compression.
ARCHIVE_BYTES = 1 << 30


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 1000, dictionary_size: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as .warc.zst files below `folder`; returns (file, n_records).

    Null html is an empty payload; null ids get record ids from the digest and are always responses; a null url leaves
    the target out. Rows that repeat a page_id each get a record. Other columns are ignored.
    An empty table gives no files. A file's dictionary comes from its first `sample_bytes` of records;
    rows are dealt by a hash, so these are a fair sample. A task begins a new file at `archive_bytes`, and renames files when they are whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        writer, passing, roll, n, size = None, "", 0, 0, 0

        def done() -> pa.RecordBatch:
            writer.close()
            name = f"part-{part:08d}-{roll:05d}.warc.zst"
            store.move(passing, posixpath.join(place, name))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if writer is None:
                    passing = posixpath.join(place, f"_{part:08d}-{uuid.uuid4().hex}")
                    writer = WarcWriter(store.open_output_stream(passing, compression=None), dictionary_size, sample_bytes, level)
                record = build_record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
                writer.add(record)
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    yield done()
                    writer, roll, n, size = None, roll + 1, 0, 0
        if writer:
            yield done()

    return with_revisits(pages, min_bytes).mapInArrow(write, "file string, n_records bigint")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record of `files`: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are of the full payload: for revisits as their HTTP and WARC headers state them.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def row(record: bytes) -> tuple:
        fields, http, _ = parse_record(record)
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        number = lambda k: int(fields[k]) if k in fields else None
        return number("X-Page-ID"), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, fields["WARC-Type"], number("X-Refers-To-Page")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(posixpath.join(place, name), compression=None) as source:
                    rows = []
                    for record in read_records(source):
                        rows.append(row(record))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives (to `folder`, else a new one in the shared folder) and read them back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_warc(cut(write_warc(pages, folder, **options)), folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`warc_round_trip` of all pages."""
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.keeper IS NULL OR g.keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keeper <> d.page_id THEN g.keeper END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
