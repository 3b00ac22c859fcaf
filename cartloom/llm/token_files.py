"""Token-id files: each document's ids compressed alone with one shared zstandard dictionary.

File format (little-endian), a folder of shard files in ascending order of doc_id:

    8 bytes   magic "CLTOKS02"
    32 bytes  SHA-256 of the dictionary (all zeros: no dictionary)
    4 bytes   width of a serialized id in bytes: 2 or 4
    frames    one zstandard frame for each document
    index     a row of 5 longs for each document: doc_id, has_id (0: doc_id is null), position of the
              frame, its length, number of ids
    8 bytes   position of the index
    8 bytes   number of documents
    8 bytes   number of ids of all documents
    8 bytes   magic again

The index makes one document readable by two short reads. The dictionary lies beside the shards as
"<sha256>.dict". The shards are all that a reader needs: their order is that of their names, and each
tells its number of ids.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.common import column, file_system, text_blocks, written
from cartloom.llm.tokens import encoder
from cartloom.operators.running import running_sums

MAGIC = b"CLTOKS02"
BLOCK_CHARS = 6_000_000
#: Range partitions; a task of each writes as many files as it takes.
MOST_SHARDS = 20_000
ROW = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("at", "<i8"), ("size", "<i8"), ("n", "<i8")])


def train_dictionary(serialized: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, serialized).as_bytes()
    except zstandard.ZstdError:
        return b""


def _data(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


class ShardWriter:
    """Writes one shard file; it gets its final name only when it is whole."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        self.fs, path = file_system(folder)
        self.final, self.temporary = f"{path}/{name}", f"{path}/.{name}.{hashlib.md5(struct.pack('<d', np.random.random())).hexdigest()}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC + _digest(dictionary) + struct.pack("<i", width))
        self.at, self.rows, self.n = 44, [], 0

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), n))
        self.at += len(frame)
        self.n += n

    def close(self) -> None:
        self.out.write(np.array(self.rows, ROW).tobytes() + struct.pack("<qqq", self.at, len(self.rows), self.n) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)


@dataclass
class Shard:
    """An open shard file: its index alone is read, documents on demand."""

    file: pa.NativeFile
    dictionary: bytes

    def __post_init__(self) -> None:
        head, tail = self.file.read_at(44, 0), self.file.read_at(32, self.file.size() - 32)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        if head[8:40] != _digest(self.dictionary):
            raise ValueError("the token file was written with another dictionary")
        self.width = struct.unpack("<i", head[40:44])[0]
        self.at, self.docs, self.n = struct.unpack("<qqq", tail[:24])
        self.back = zstandard.ZstdDecompressor(dict_data=_data(self.dictionary))

    def index(self, first: int = 0, docs: int | None = None) -> np.ndarray:
        docs = self.docs - first if docs is None else min(docs, self.docs - first)
        return np.frombuffer(self.file.read_at(docs * ROW.itemsize, self.at + first * ROW.itemsize), ROW)

    def read(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents, given as rows of the index that follow each other in the file."""
        if len(rows):
            base = int(rows[0]["at"])
            blob = self.file.read_at(int(rows[-1]["at"] + rows[-1]["size"]) - base, base)
            for r in rows:
                yield np.frombuffer(self.back.decompress(blob[r["at"] - base : r["at"] - base + r["size"]]), f"<u{self.width}")


@contextmanager
def open_shard(path: str, dictionary: bytes) -> Iterator[Shard]:
    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        yield Shard(f, dictionary)


def read_document(folder: str, shard: str, doc_id: int, dictionary: bytes) -> list[np.ndarray]:
    """The ids of a document, read alone: the end of the file, its index, then the document's frames."""
    with open_shard(f"{folder}/{shard}", dictionary) as f:
        index = f.index()
        found = index[(index["doc_id"] == doc_id) & (index["has_id"] == 1)]
        return [x for r in found for x in f.read(np.array([r]))]


def _writing(tokenizer: str, folder: str, end_id: int, width: int, dictionary: bytes, level: int, shard_bytes: int) -> Callable:
    """Sorted documents are encoded block by block, compressed and written; a partition is a shard of one or more files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_data(dictionary), write_content_size=True)
        shard, part, writer, done = TaskContext.get().partitionId(), 0, None, []

        def end() -> None:
            writer.close()
            done.append((shard, part, len(writer.rows), writer.n, writer.at))

        with encoder(tokenizer, True) as chunks:
            for held, block in text_blocks(batches, BLOCK_CHARS):
                ids, lengths = chunks.encode(block)
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids need a width of 4 bytes")
                small = ids.astype(f"<u{width}")
                tail = np.array([end_id], f"<u{width}").tobytes()
                docs = column(held, "doc_id").to_pylist()
                for doc, e, n in zip(docs, np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                    if writer and writer.at >= shard_bytes:
                        end()
                        writer, part = None, part + 1
                    writer = writer or ShardWriter(folder, f"shard-{shard:08d}-{part:06d}.tok", dictionary, width)
                    writer.add(doc, squeeze.compress(small[e - n : e].tobytes() + tail), n + 1)
        if writer:
            end()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], ["shard", "part", "docs", "n", "bytes"])

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, width: int = 2, level: int = 3,
    sample_docs: int = 512, sample_ids: int = 65_536, dictionary_bytes: int = 65_536, shard_docs: int = 8_192, shard_bytes: int = 64 << 20,
) -> tuple[bytes, DataFrame]:
    """Encode every whole text of docs (doc_id, text) and write it to folder in ascending order of doc_id.

    Returns the dictionary and a report (shard, part, docs, n, bytes), a row for each file; a reader
    needs no report. A null text is empty, an empty text has the end id only; null doc_ids come first;
    rows of equal doc_id follow each other in an order of their texts. No documents give no file.
    Further columns are not read.

    The dictionary is trained on sample_docs documents, those with the least hash of doc_id, the first
    sample_ids ids of each: a dictionary changes how small the files are, not what they hold. Texts
    are range-partitioned by doc_id and a hash of the text, so a doc_id with very many rows takes
    several shards; a shard has about shard_docs documents (more, if there were over MOST_SHARDS
    shards), and a file of it ends at shard_bytes. A task holds a block of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer, True) as chunks:
            for _, block in text_blocks(batches, BLOCK_CHARS):
                ids, lengths = chunks.encode(block)
                each = [x[:sample_ids].astype(f"<u{width}").tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary())], ["ids"])

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").limit(sample_docs)
    dictionary = train_dictionary([bytes(r.ids) for r in sample.mapInArrow(serialize, "ids binary").collect()], dictionary_bytes)
    shards = min(MOST_SHARDS, max(1, -(-docs.count() // shard_docs)))
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    fs, path = file_system(folder)
    fs.create_dir(path)
    write = _writing(tokenizer, folder, end_id, width, dictionary, level, shard_bytes)
    report = written(ordered.select("doc_id", "text").mapInArrow(write, "shard int, part int, docs long, n long, bytes long"), "token-report")
    with fs.open_output_stream(f"{path}/{_digest(dictionary).hex()}.dict") as f:
        f.write(dictionary)
    return dictionary, report


def read_token_files(spark: SparkSession, folder: str, dictionary: bytes, ids: bool = True, docs: int = 2_000) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_crc32, bytes and, if asked for, ids.

    start counts the ids of all documents before, summed over the files' own ends; the crc is that of
    the ids as 32-bit integers. A task reads ranges of about so many documents by the files' indexes.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for path in batch.column("path").to_pylist():
                with open_shard(path, dictionary) as f:
                    got.append((f.docs, f.n))
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([x[i] for x in got], pa.int64()) for i in range(2))], ["path", "docs", "n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, first in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "first")), strict=True):
                with open_shard(path, dictionary) as f:
                    index = f.index(0, first + docs)
                    start, index = base + int(index["n"][:first].sum()), index[first:]
                    rows = []
                    for r, x in zip(index, f.read(index), strict=True):
                        wide = x.astype("<u4")
                        rows.append((int(r["doc_id"]) if r["has_id"] else None, start, len(x), zlib.crc32(wide.tobytes()), int(r["size"]), wide.tolist() if ids else None))
                        start += len(x)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * ids
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "bytes", *["ids"] * ids]
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long, bytes long" + ", ids array<long>" * ids
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path")
    sizes = written(files.mapInArrow(ends, "path string, docs long, n long"), "token-ends")
    placed = running_sums(sizes, [F.regexp_extract("path", r"([^/]+)$", 1)], {"base": F.col("n")})
    ranges = placed.select("path", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(docs).cast("long"))).alias("first"))
    return ranges.repartition(n, "path", "first").mapInArrow(decode, kinds)
