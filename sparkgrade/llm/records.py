"""Token ids in length-delimited binary records, with an index of offsets beside each file.

A record: length (u64), masked checksum of the length (u32), payload, masked checksum of the
payload (u32), all little-endian. The checksum is CRC-32, rotated right by 15 bits plus a
constant, so that a checksum stored within data isn't its own check. A payload: 1 byte of
flags (bit 0: the id is null; bit 1: ids take 4 bytes, else 2), the id (i64), the token ids.
part-N.rec holds records in ascending doc_id order; part-N.idx has 24 bytes for each:
offset (u64), payload bytes (u64), token count (u64), so that readers can go to any record.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, slices, vocabulary
from .common import shared_path, table

#: Constant of the checksum mask (fixed value, as in other record formats of this kind).
MASK = 0xA282EAD8
END_ID = 0
#: Bytes of input for a file, about; a file is read by one task.
FILE_BYTES = 64 << 20
_ID, _INDEX = "<Bq", "<QQQ"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at an offset and the next offset; ValueError if a checksum is wrong."""
    view = memoryview(data)
    length, check = struct.unpack_from("<QI", view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise ValueError(f"wrong checksum of a length at {at}")
    payload = view[at + 12 : at + 12 + length]
    if len(payload) < length or masked(payload) != struct.unpack_from("<I", view, at + 12 + length)[0]:
        raise ValueError(f"wrong checksum of a record at {at}")
    return payload, at + 16 + length


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack(_ID, (doc_id is None) | 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(_ID, payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload[struct.calcsize(_ID) :], dtype="<u4" if flags & 2 else "<u2").astype("<u4")


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, files: int | None = None) -> list[tuple[int, int, int]]:
    """Encodes every whole text, appends end_id and writes the files; returns (file, records, token ids) of each.

    Rows go to files by ranges of doc_id, a hash of the text and the row's place in the input
    (so that one id of many rows, or one row many times, is still split), and are sorted in each. A task writes under a name of its own and renames
    at the end: a second attempt replaces the first with the same bytes. The result has a row
    for each file. Null text: the end id alone. Null ids come first.
    """
    spark = docs.sparkSession
    if files is None:
        size = int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # not known: the plan doesn't read files
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        bpe = vocabulary(path)
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own = f"{root}/.{uuid.uuid4().hex}"
        end = np.array([end_id], dtype="<u4")
        records = ids_of_all = at = 0
        with store.open_output_stream(f"{own}.rec", buffer_size=1 << 20) as out, store.open_output_stream(f"{own}.idx", buffer_size=1 << 16) as index:
            for batch in batches:
                for some in slices(batch):
                    for doc_id, own_ids in zip(some.column(0).to_pylist(), bpe.encode_added(some.column(1)), strict=True):
                        ids = np.concatenate([own_ids, end])
                        record = frame(pack(doc_id, ids))
                        out.write(record)
                        index.write(struct.pack(_INDEX, at, len(record) - 16, len(ids)))
                        at, records, ids_of_all = at + len(record), records + 1, ids_of_all + len(ids)
        for kind in ("idx", "rec"):
            store.move(f"{own}.{kind}", f"{root}/part-{part:08d}.{kind}")
        yield pa.RecordBatch.from_pydict({"file": [part], "records": [records], "ids": [ids_of_all]})

    ranged = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "xxhash64(text) AS h", "monotonically_increasing_id() AS place").repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text")
    return sorted(tuple(r) for r in ranged.select("doc_id", "text").mapInArrow(run, "file bigint, records bigint, ids bigint").collect())


def read_records(spark: SparkSession, folder: str, written: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files; a missing or damaged file or record raises."""
    from pyarrow import fs

    base, total, count = {}, 0, {}
    for part, records, ids in written:
        base[part], count[part] = total, records
        total += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = int(name.rpartition("part-")[2][:8])
                data, at, start = memoryview(content.as_buffer()), 0, base[part]
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    for key, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        rows[key].append(value)
                    start += len(ids)
                if len(rows["start"]) != count[part]:
                    raise ValueError(f"{name} has {len(rows['start'])} records, not {count[part]}")
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not written:
        return spark.createDataFrame([], schema)
    store, root = fs.FileSystem.from_uri(folder)
    there = {f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.is_file}
    if lost := [name for name in (f"part-{part:08d}.rec" for part in base) if name not in there]:
        raise ValueError(f"{folder} lacks {lost}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rec").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def read_at(folder: str, part: int, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Single records of a file by their numbers, in any order: what a shuffled reader does with the index."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    out = []
    with store.open_input_file(f"{root}/part-{part:08d}.idx") as index, store.open_input_file(f"{root}/part-{part:08d}.rec") as data:
        for n in numbers:
            at, size, _ = struct.unpack(_INDEX, index.read_at(24, n * 24))
            out.append(unpack(unframe(data.read_at(size + 16, at), 0)[0]))
    return out


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files of all documents, and reads them back. Null, empty and repeated rows each have a record."""
    folder = shared_path(spark, "records")
    return read_records(spark, folder, write_records(table(spark, sf_dir, "documents"), folder, default_path()))
