"""WARC archives with a Zstandard dictionary, every record compressed on its own.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then follow
the records, one Zstandard frame each, compressed with it.  So a file can be read without any
other, and a record can be read alone from its offset.  The dictionary is trained on the driver
on a bounded sample of the records that are archived (``SAMPLE_RECORDS`` rows of the least id
hash, ``SAMPLE_BYTES`` at most each); every record is archived whatever the sample.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one of the largest page
id is a response, the others are revisits that refer to it.  Payloads meet by digest: a grouped
maximum, joined back.

A task writes files named after its attempt into the shared folder and returns their manifest,
which is written as a table; only files of the manifest are read.  A lost executor repeats its
tasks under other names and leaves nothing half written in sight.

Defined cases: a null payload is an empty one; a null id is the least, keeps its record and is
null again when read; equal rows give equal records, but for the name of a record without id, which is drawn; a null URL leaves the header out; line
breaks in a URL are percent-encoded; an empty table gives no files and no rows; other columns are
not archived.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import shared_dir, written

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 112 << 10
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 64 << 10
REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, size: int, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit has HTTP headers only."""
    name = lambda k: f"<urn:page:{'none:' + uuid.uuid4().hex if k is None else k}>"
    block = _HTTP % size + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode(), f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_of(name: str) -> int | None:
    """Page id of a record name."""
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number.startswith("none:") else int(number)


def frames(file, dictionary_out: list | None = None) -> Iterator[bytes]:
    """Decompressed records of an open archive file, one after the other."""
    start = file.read(8)
    rest, reader = start, zstandard.ZstdDecompressor()
    if len(start) == 8:
        magic, size = struct.unpack("<II", start)
        if magic == DICTIONARY_FRAME:
            data = file.read(size)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            rest = b""
            if dictionary_out is not None:
                dictionary_out.append(data)
    while True:
        if not rest:
            rest = file.read(1 << 20)
            if not rest:
                return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = file.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; of very few, their own bytes serve; of none, it is empty."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def payload_rows(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, size) of each row."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")
    )


def mark_revisits(rows: DataFrame) -> DataFrame:
    """``payload_rows`` with ``refers_to``: the page that a revisit refers to, else null."""
    several = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(several.select(F.col("digest").alias("d"), "holder"), F.col("digest") == F.col("d"), "left")
    return joined.select("id", "url", "payload", "digest", "size", F.when(~F.col("holder").eqNullSafe(F.col("id")), F.col("holder")).alias("refers_to"))


def sample_dictionary(rows: DataFrame) -> bytes:
    """A dictionary trained on at most ``SAMPLE_RECORDS`` records of the rows.

    Ids and digests alone are ordered; the chosen few are then picked up by one more scan.
    """
    wanted = rows.where(F.col("size").between(1, SAMPLE_BYTES))
    picked = wanted.select("id", "digest").orderBy(F.xxhash64("id"), "id", "digest").limit(SAMPLE_RECORDS).distinct()
    picked = picked.select(F.col("id").alias("i"), F.col("digest").alias("g"))
    chosen = wanted.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), "left_semi")
    sample = chosen.limit(SAMPLE_RECORDS).collect()
    sample.sort(key=lambda r: (r["digest"], r["id"] is not None, r["id"] or 0))
    return train_dictionary([record(r["id"], r["url"], bytes(r["payload"]), r["digest"], r["size"], None) for r in sample])


def write_archives(records: DataFrame, folder: str, trained: bytes) -> DataFrame:
    """Archive the rows of ``mark_revisits`` into ``folder``; the manifest (path, n_records, n_bytes)."""
    dictionary = records.sparkSession.sparkContext.broadcast(trained)  # DICTIONARY_BYTES at most

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        data = dictionary.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_content_size=True)
        done, file, path, count, size = [], None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    path, count, size = f"{base}/{name}", 0, 0
                    file = system.open_output_stream(path, compression=None)  # the records are compressed already
                    if data:
                        file.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
                frame = packer.compress(record(row["id"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"]))
                file.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= FILE_BYTES:
                    file.close()
                    done.append((name, count, size))
                    file = None
        if file is not None:
            file.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([
            pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
        ], ["path", "n_records", "n_bytes"])

    return written(records.mapInArrow(write, "path string, n_records long, n_bytes long"))


_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [part.split(" ")[0] for part in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    import hashlib

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = pyarrow.fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with system.open_input_stream(inner, compression=None) as file:
                for data in frames(file):
                    headers, block = parse(data)
                    _, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    length, kind = int(headers["X-Payload-Length"]), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                    to = headers.get("WARC-Refers-To")
                    rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, to and page_of(to), digest, length, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the files of a manifest; a revisit's payload is null, its digest and length are those of the full payload."""
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_read, _READ)  # a task per archive


def archive(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``df`` as WARC files (into a new shared folder by default) and read them back."""
    rows = payload_rows(df, id_col, url_col, payload_col)
    return read_archives(write_archives(mark_revisits(rows), folder or shared_dir(df.sparkSession), sample_dictionary(rows)))
