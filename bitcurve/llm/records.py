"""Token-ID output: length-delimited binary records and their offset index.

A file is a sequence of records, each framed as

    length of the payload, 8 bytes | masked CRC-32 of these 8 bytes, 4 | payload | masked CRC-32 of the payload, 4

(little-endian throughout). The payload is 1 byte (1: the document has an id), 1 byte (bytes per token id),
the document's id in 8 bytes, and the token ids. The masks are rotations plus a constant, as usual for such
frames, so that a checksum of data which holds checksums stays useful.

Documents are range-partitioned and sorted by id, so the files in order hold the documents in ascending
id order. Every task attempt writes a file of its own name; the index, a table that Spark commits, names the
files of the attempts that counted, and readers go by it. So repeated, speculative and lost attempts do no
harm. Files are written through pyarrow's file systems (local or mounted paths, hdfs, s3, gs ...).

Defined results: a null or empty text is a record of the end id alone; null ids come first; rows of one id
are ordered by text, equal rows each have their record; other columns are ignored; an empty table gives an
empty index."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitcurve.llm.encode import encoded, encoder
from bitcurve.llm.session import ship
from bitcurve.session import scratch

INDEX = "doc_id long, file string, part long, row long, offset long, bytes long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
BUFFER = 4 << 20


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBq", doc_id is not None, width, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, width, doc_id = struct.unpack_from("<BBq", payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=10)


def read_frame(stream) -> bytes | None:
    """The next payload, checked; None at the end."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != head[8:]:
        raise ValueError("damaged record length")
    (size,) = struct.unpack("<Q", head[:8])
    body = stream.read(size + 4)
    if len(body) != size + 4 or masked(body[:size]) != body[size:]:
        raise ValueError("damaged record")
    return body[:size]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text of ``docs``, write the record files into ``folder`` (a shared one) and return the
    offset index: a row per document with its file, its place in it and its token count."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches):
        from pyspark import TaskContext

        part, rows, offset, out = TaskContext.get().partitionId(), 0, 0, None
        own = encoder(tokenizer)
        end = np.asarray([end_id], own.kind).tobytes()
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system, base = file_system(folder)
                    system.create_dir(base, recursive=True)
                    name = f"part-{part:07d}-{uuid.uuid4().hex}.records"
                    out = system.open_output_stream(f"{base}/{name}", buffer_size=BUFFER)
                ids, sizes, counts = batch.column(0).to_pylist(), [], []
                for doc_id, body in zip(ids, encoded(batch.column(1), tokenizer)):
                    record = frame(payload_of(doc_id, body + end, own.width))
                    out.write(record)
                    sizes.append(len(record))
                    counts.append((len(record) - 26) // own.width)
                n, size = len(ids), np.asarray(sizes, np.int64)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([name] * n, pa.string()),
                    pa.array(np.full(n, part, np.int64)),
                    pa.array(np.arange(rows, rows + n, dtype=np.int64)),
                    pa.array(offset + np.cumsum(size) - size),
                    pa.array(size),
                    pa.array(counts, pa.int64()),
                ]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)
                rows, offset = rows + n, offset + int(size.sum())
        finally:
            if out is not None:
                out.close()

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The text's hash as a second key spreads the rows of one id (or of none) over several files.
    keyed = plain.withColumn("_tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    path = scratch(spark, "token-index")
    ordered.select("doc_id", "text").mapInArrow(write, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def files_of(index: DataFrame) -> DataFrame:
    """One row per file: its place in the order and the number of ids in the files before it. The window
    runs over the files, not over documents."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the files front to back, checking every frame: doc_id, ``start`` (ids of all documents before
    it), n_tokens and the CRC-32 of its ids as unsigned 32-bit integers. One task per file."""
    ship(index.sparkSession)
    files = files_of(index)
    n = max(1, index.select("file").distinct().count())

    def read(batches):
        system, base = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with system.open_input_stream(f"{base}/{name}", buffer_size=BUFFER) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield as_batch(rows)
                            rows = []
                if rows:
                    yield as_batch(rows)

    return files.repartitionByRange(n, "part").select("file", "before").mapInArrow(read, READ)


def as_batch(rows) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def read_shuffled(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """All records in a pseudo-random order fixed by ``seed``, read by their offsets: (doc_id, ids)."""
    ship(index.sparkSession)

    def read(batches):
        system, base = file_system(folder)
        name, stream = None, None
        for batch in batches:
            out = []
            for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, system.open_input_file(f"{base}/{file}")
                stream.seek(offset)
                doc_id, ids = unpack(read_frame(stream))
                out.append((doc_id, ids.tolist()))
                if len(out) == 256:
                    yield pairs(out)
                    out = []
            if out:
                yield pairs(out)

    order = F.xxhash64(F.lit(seed), F.col("file"), F.col("offset"))
    shuffled = index.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order")
    return shuffled.select("file", "offset").mapInArrow(read, "doc_id long, ids array<int>")


def pairs(rows) -> pa.RecordBatch:
    ids = pa.array([r[1] for r in rows], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids], ["doc_id", "ids"])


def record_digests(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents and read them back."""
    folder = scratch(spark, "token-records")
    return read_records(write_records(docs, folder, tokenizer), folder)
