"""Objects of many parts: tasks write parts in order, a commit publishes them, and parts one after another are the object.

`ordered_pieces` takes rows (key, data) sorted by range and writes an object per key. `packed_vectors` takes rows with a
vector and writes one object of packed vectors, whose header is written in the commit, once all rows are counted. A
manifest names what a commit published; nothing else is ever read, so a lost task or a failed job leaves no half object.
Objects that are small and many can share files (`shared`): the listing says where in its file each part begins.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files
from .packed import MAGIC, VERSION

#: Bytes at which a part is closed and the next one begun; rows that a reading task takes of a part.
PART_BYTES, PART_ROWS = 32 << 20, 65_536
MANIFEST = "_manifest.json"
LISTING = pa.schema([("key", pa.string()), ("task", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string()), ("begin", pa.int64())])
#: The listing as Spark reads it.
LISTING_DDL = "key string, task long, part long, file string, bytes long, records long, sha256 string, begin long"
#: Parts that a task lists before it writes a group of them out; bytes of a block when parts are read, and of lines in a batch.
LISTED, READ_BLOCK = 10_000, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: a listing file of its parts, and sums for one object of vectors."""

    task: int
    listing: str | None
    records: int = 0
    dim: int | None = None


class _Parts:
    """The parts that a task writes, one after another; each in a file of its own, or (shared) many in one."""

    def __init__(self, folder: str, task: int, most: int, shared: bool = False):
        self.folder, self.task, self.most, self.shared, self.mark = folder, task, most, shared, uuid.uuid4().hex[:12]
        self.listed, self.count, self.sink, self.table = [], 0, io.BytesIO(), None
        self.key, self.out, self.open = None, None, False

    def add(self, key: str, data: bytes, records: int) -> None:
        if self.open and (key != self.key or self.begin + self.size + len(data) > self.most and self.begin + self.size):
            self.end()
        if self.out is not None and not self.open and self.begin + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name, self.begin = f"part-{self.task:06d}-{self.count:06d}-{self.mark}", 0
            where, path = files.at(f"{self.folder}/{self.name}")
            self.out = where.open_output_stream(path)
        if not self.open:
            self.open, self.key, self.size, self.records, self.digest = True, key, 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += records

    def end(self) -> None:
        """Lists the part; the next one goes on in its file or begins another."""
        if self.open:
            self.listed.append((self.key, self.task, self.count, self.name, self.size, self.records, self.digest.hexdigest(), self.begin))
            self.open, self.count, self.begin = False, self.count + 1, self.begin + self.size
            if len(self.listed) >= LISTED:
                self.note()
        if not self.shared:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def note(self) -> None:
        """Puts what is listed in the table of the listing, which is compressed."""
        if self.listed:
            self.table = self.table or pq.ParquetWriter(self.sink, LISTING)
            self.table.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.listed, strict=True), LISTING.types, strict=True)], schema=LISTING))
            self.listed = []

    def listing(self) -> str | None:
        self.end()
        self.close()
        self.note()
        if self.table is None:
            return None
        self.table.close()
        name = f"listing-{self.task:06d}-{self.mark}.parquet"
        files.put(f"{self.folder}/{name}", self.sink.getvalue())
        return name


class PiecesWriter(DataSourceArrowWriter):
    """Parts per key; the driver gets a file name per task, whatever number of keys there are."""

    def __init__(self, path: str, overwrite: bool, most: int, shared: bool = False):
        self.path, self.overwrite, self.most, self.shared, self.run = path, overwrite, most, shared, f"run-{uuid.uuid4().hex}"
        where, at = files.at(f"{path}/{self.run}")
        if not overwrite and files.get(f"{path}/{MANIFEST}") is not None:
            raise FileExistsError(f"{path} holds an object; overwrite it or take another path")
        where.create_dir(at, recursive=True)

    def parts(self) -> _Parts:
        return _Parts(f"{self.path}/{self.run}", TaskContext.get().partitionId(), self.most, self.shared)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        parts, n = self.parts(), 0
        for batch in iterator:
            for key, data in zip(batch.column("key"), batch.column("data"), strict=True):
                parts.add(key.as_py(), data.as_py() or b"", 1)
                n += 1
        return Written(parts.task, parts.listing(), n)

    def publish(self, messages: list[Written | None], **more) -> None:
        """Readers see the new parts from here on; those of the manifest before are deleted."""
        before = files.get(f"{self.path}/{MANIFEST}")
        listed = sorted((m.task, m.listing) for m in messages if m is not None and m.listing)
        files.put(f"{self.path}/{MANIFEST}", json.dumps({"run": self.run, "listings": [name for _, name in listed], **more}).encode())
        if before is not None:
            files.drop(f"{self.path}/{json.loads(before)['run']}")

    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files.drop(f"{self.path}/{self.run}")


def header(dim: int, count: int) -> bytes:
    return MAGIC + struct.pack("<III", VERSION, dim, count)


class VectorsWriter(PiecesWriter):
    """One object of packed vectors: every task checks its rows' dimension, the commit checks that tasks agree and writes the header."""

    def __init__(self, path: str, overwrite: bool, most: int, column: str):
        super().__init__(path, overwrite, most)
        self.column = column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        parts, n, dim = self.parts(), 0, None
        for batch in iterator:
            vectors = batch.column(self.column)
            if not len(vectors):
                continue
            sizes = set(np.diff(np.asarray(vectors.offsets)).tolist())
            if vectors.null_count or vectors.flatten().null_count or len(sizes | ({dim} if dim is not None else set())) > 1 or 0 in sizes:
                raise ValueError(f"task {parts.task}: rows differ in dimension, or are null or empty: {sorted(sizes)}, {dim} before")
            dim = sizes.pop()
            body = np.asarray(vectors.flatten(), "<f4")
            rows = max(1, self.most // (4 * dim))
            for at in range(0, len(vectors), rows):
                some = body[at * dim : (at + rows) * dim]
                parts.add("", some.tobytes(), len(some) // dim)
            n += len(vectors)
        return Written(parts.task, parts.listing(), n, dim)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None and m.records]
        dims, count = {m.dim for m in told}, sum(m.records for m in told)
        if len(dims) != 1 or count >= 1 << 32:
            self.abort(messages)
            raise ValueError(f"no object of {count} rows of dimensions {sorted(dims)}")
        dim = dims.pop()
        files.put(f"{self.path}/{self.run}/part-header", header(dim, count))
        self.publish(messages, dim=dim, count=count)


@dataclass
class Rows(InputPartition):
    """Some rows of a part, and the number of the first of them in the object."""

    file: str
    dim: int
    skip: int
    rows: int
    first: int


class VectorsReader(DataSourceReader):
    """Rows of fixed size, so a part is read by as many tasks as it has runs of PART_ROWS rows."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Rows]:
        told = manifest(self.path)
        out, first = [], 0
        for row in (r for name in told["listings"] for r in pq.read_table(io.BytesIO(files.get(f"{self.path}/{told['run']}/{name}"))).to_pylist()):
            for skip in range(0, row["records"], PART_ROWS):
                n = min(PART_ROWS, row["records"] - skip)
                out.append(Rows(f"{self.path}/{told['run']}/{row['file']}", told["dim"], skip, n, first + skip))
            first += row["records"]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        where, path = files.at(partition.file)
        width = 4 * partition.dim
        with where.open_input_file(path) as source:
            data = source.read_at(partition.rows * width, partition.skip * width)
        if len(data) != partition.rows * width:
            raise ValueError(f"{partition.file} is cut short")
        body = np.frombuffer(data, "<f4")
        offsets = np.arange(partition.rows + 1, dtype=np.int32) * partition.dim
        places = pa.array(np.arange(partition.first, partition.first + partition.rows))
        yield pa.RecordBatch.from_arrays([places, pa.ListArray.from_arrays(pa.array(offsets), pa.array(body))], ["index", "vector"])


class OrderedPieces(DataSource):
    """Writes (key string, data binary); read what was written with `parts`."""

    @classmethod
    def name(cls) -> str:
        return "ordered_pieces"

    def schema(self) -> str:
        return "key string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> PiecesWriter:
        return PiecesWriter(self.options["path"], overwrite, int(self.options.get("partBytes", PART_BYTES)), self.options.get("shared", "false") == "true")


class PackedVectors(DataSource):
    """Writes the column named by option `column` (default vector), reads index and vector."""

    @classmethod
    def name(cls) -> str:
        return "packed_vectors"

    def schema(self) -> str:
        return "index long, vector array<float>"

    def writer(self, schema: StructType, overwrite: bool) -> VectorsWriter:
        return VectorsWriter(self.options["path"], overwrite, int(self.options.get("partBytes", PART_BYTES)), self.options.get("column", "vector"))

    def reader(self, schema: StructType) -> VectorsReader:
        return VectorsReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (OrderedPieces, PackedVectors):
        spark.dataSource.register(source)


def manifest(path: str) -> dict:
    found = files.get(f"{path}/{MANIFEST}")
    if found is None:
        raise FileNotFoundError(f"{path} holds no published object")
    return json.loads(found)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The published parts as listed when they were written: key, task, part (both in order), file, bytes, records, sha256."""
    told = manifest(path)
    if not told["listings"]:
        return spark.createDataFrame([], LISTING_DDL)
    return spark.read.schema(LISTING_DDL).parquet(*[f"{path}/{told['run']}/{name}" for name in told["listings"]])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """parts() with what stands in the files now: content, found_bytes and found_sha256, null where a file is gone; an empty part needs no file. Not for parts that share files."""
    at = f"{path}/{manifest(path)['run']}"
    there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at)
    there = there.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    found = parts(spark, path).join(there, "file", "left")
    nothing = {"content": F.lit(b""), "found_bytes": F.lit(0).cast("long"), "found_sha256": F.sha2(F.lit(b""), 256)}
    return found.withColumns({c: F.when(F.col("bytes") == 0, v).otherwise(F.col(c)) for c, v in nothing.items()})


def lines(spark: SparkSession, path: str) -> DataFrame:
    """key, line_no, line (binary), sound of every line of the objects; parts hold whole lines, and numbers go on from part to part.

    sound is false where a part is not what was written or does not end its last line; a part that is gone has no lines. A
    part is read twice in blocks, for its digest and for its lines, so a task holds a block and the longest line.
    """
    at = f"{path}/{manifest(path)['run']}"
    before = Window.partitionBy("key").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    listed = parts(spark, path).withColumn("base", F.coalesce(F.sum("records").over(before), F.lit(0)))  # one row per part
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, for by its few bytes the listing would go to one task
    dealt = listed.select("key", "file", "begin", "bytes", "records", "sha256", "base").repartition(n, "file")
    ends = F.max(F.col("begin") + F.col("bytes")).over(Window.partitionBy("file"))  # the last part of a file is what stands there to its end
    dealt = dealt.withColumn("last", F.col("begin") + F.col("bytes") == ends).sortWithinPartitions("file", "begin")
    return dealt.mapInArrow(lambda batches: _lines_of_parts(batches, at), LINES_DDL)


LINES = pa.schema([("key", pa.string()), ("line_no", pa.int64()), ("line", pa.binary()), ("sound", pa.bool_())])
LINES_DDL = "key string, line_no long, line binary, sound boolean"


def _blocks(source, begin: int, size: int) -> Iterator[bytes]:
    source.seek(begin)
    while size > 0 and (block := source.read(min(size, READ_BLOCK))):
        size -= len(block)
        yield block


def _lines_in(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces between line feeds, also the one behind the last."""
    held: list[bytes] = []
    for block in blocks:
        first, *more = block.split(b"\n")
        held.append(first)
        for piece in more:
            yield b"".join(held)
            held = [piece]
    yield b"".join(held)


def _lines_of_parts(batches: Iterator[pa.RecordBatch], at: str) -> Iterator[pa.RecordBatch]:
    name, source, there = None, None, 0
    out: list = []
    held = 0
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("key", "file", "begin", "bytes", "records", "sha256", "base", "last")], strict=True):
            key, file, begin, size, records, sha256, base, is_last = [v.as_py() for v in row]
            if file != name:
                if source is not None:
                    source.close()
                where, path = files.at(f"{at}/{file}")
                found = where.get_file_info(path)
                name, there = file, found.size if found.is_file else -1
                source = where.open_input_file(path) if found.is_file else None
            if source is None and size:
                continue
            size = max(0, there - begin) if is_last else size
            short = [source.read_at(size, begin)] if 0 < size <= READ_BLOCK else []
            blocks = lambda: iter(short) if size <= READ_BLOCK else _blocks(source, begin, size)  # noqa: B023, E731
            digest, last = hashlib.sha256(), b"\n"
            for block in blocks():
                digest.update(block)
                last = block[-1:] or last
            sound = digest.hexdigest() == sha256 and last == b"\n"
            for i, line in zip(range(records), _lines_in(blocks())):
                out.append((key, base + i, line, sound))
                held += len(line) + 64
                if held > READ_BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINES.types, strict=True)], schema=LINES)
                    out, held = [], 0
    if source is not None:
        source.close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINES.types, strict=True)], schema=LINES)


def whole_digest(spark: SparkSession, path: str) -> DataFrame:
    """bytes and sha256 of one object of vectors, header and parts one after another as they stand now: SHA-256 goes byte by byte, so one task streams them."""
    told = manifest(path)
    at, dim, count = f"{path}/{told['run']}", told["dim"], told["count"]
    listed = parts(spark, path).select("task", "part", "file").repartition(1).sortWithinPartitions("task", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size = hashlib.sha256(), 0
        names = ["part-header", *(f for b in batches for f in b.column("file").to_pylist())]
        for name in names:
            where, path = files.at(f"{at}/{name}")
            with where.open_input_stream(path) as source:
                while block := source.read(1 << 20):
                    digest.update(block)
                    size += len(block)
        yield pa.RecordBatch.from_pydict({"count": [count], "dim": [dim], "bytes": [size], "sha256": [digest.hexdigest()]})

    return listed.mapInArrow(run, "count long, dim long, bytes long, sha256 string")


def write_ordered(pieces: DataFrame, path: str, order: list[str], part_bytes: int = PART_BYTES, shared: bool = False) -> None:
    """Writes key and data of pieces, sorted by key and `order`: rows of a key that spans tasks go on from task to task. With `shared`, a file holds the parts of many keys, for objects much smaller than a block of the disk."""
    spark = pieces.sparkSession
    register(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order).select("key", "data")
    dealt.write.format("ordered_pieces").mode("append").option("partBytes", str(part_bytes)).option("shared", str(shared).lower()).save(path)


def write_vectors(rows: DataFrame, path: str, order: list[str], vector: str = "vector", part_bytes: int = PART_BYTES) -> None:
    """Writes the vectors of all rows, in order, as one object."""
    spark = rows.sparkSession
    register(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col(vector).alias("vector"))
    dealt.write.format("packed_vectors").mode("append").option("partBytes", str(part_bytes)).save(path)
