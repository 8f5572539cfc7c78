"""Token ids of documents in binary shards of Simple-8b blocks, written and read by tasks.

A dataset is a folder: `shards/*.s8b` and `manifest`, a Parquet table of (part, shard, name, start, n_ids, n_docs). A shard:

    magic | words of all blocks | sizes: uint32 pairs (words, exceptions) by block | ends: uint64 by document |
    ids: int64 by document | known: uint8 by document (0: its id is null) | footer: uint64 n_ids, n_blocks, n_docs, block | magic

All numbers are little-endian. A document's ids are those from the end before it to its own end; blocks go on over
documents, so any id is found from its place alone. Only shards that the manifest names count: a task that is tried
again, or twice at a time, writes files of other names, and Spark commits one attempt's rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.llm import words
from lodestore.llm.packing import token_ids
from lodestore.llm.text import slices
from lodestore.staging import qualified, shared_dir, stage, unstage

END = 2
MAGIC = b"s8bwords"
#: A shard ends with the first document that brings it to so many ids; a task's part has about so many; ids coded at once.
SHARD_IDS, PART_IDS, CODED = 1 << 24, 1 << 27, 1 << 20
#: The longest sequence whose ids come to one row of read_tokens() is a document; span() gives rows of so many.
SPAN_IDS = 1 << 20


def _tokenised(path: str, end: int):
    """Of batches (doc_id, text) those of (doc_id, n_tokens, ids): little-endian numbers of two or four bytes."""

    def run(batches):
        for part in slices(batches):
            held = [np.append(i, np.uint32(end)) for i in token_ids(part.column(1).to_pylist(), path)]
            packed = [i.astype("<u2" if i.max() < 1 << 16 else "<u4").tobytes() for i in held]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in held], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


class _Shard:
    """One open file: ids are coded as soon as there are enough, and only sizes and ends are kept until the end."""

    def __init__(self, where: fs.FileSystem, path: str):
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.out.write(MAGIC)
        self.sizes, self.ends, self.docs, self.waiting, self.n_waiting, self.n_ids = [], [], [], [], 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.docs.append(doc)
        if self.n_waiting >= CODED:
            self._code(self.n_waiting // words.BLOCK * words.BLOCK)

    def _code(self, upto: int) -> None:
        held = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint64)
        for a in range(0, upto, CODED):
            coded, sizes = words.encode(held[a : min(a + CODED, upto)])
            self.out.write(coded.astype("<u8").tobytes())
            self.sizes.append(sizes)
        self.waiting = [held[upto:].copy()]
        self.n_waiting = len(self.waiting[0])

    def close(self) -> None:
        self._code(self.n_waiting)
        sizes = np.concatenate([np.empty((0, 2), np.uint32), *self.sizes])
        self.out.write(sizes.astype("<u4").tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array([self.n_ids, len(sizes), len(self.docs), words.BLOCK], "<u8").tobytes() + MAGIC)
        self.out.close()


def _writer(folder: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]):
        where, root = fs.FileSystem.from_uri(folder + "/shards")
        part, rows, open_, name = TaskContext.get().partitionId(), [], None, ""
        for batch in batches:
            for doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, f"<u{raw.size // n}") if n else np.empty(0, np.uint16)
                if open_ is None:
                    name = f"{part:06d}-{len(rows):05d}-{uuid.uuid4().hex}.s8b"
                    open_ = _Shard(where, f"{root}/{name}")
                open_.add(doc, ids)
                if open_.n_ids >= shard_ids:
                    open_.close()
                    rows.append((part, len(rows), name, open_.n_ids, len(open_.docs)))
                    open_ = None
        if open_ is not None:
            open_.close()
            rows.append((part, len(rows), name, open_.n_ids, len(open_.docs)))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(["part", "shard", "name", "n_ids", "n_docs"], r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    return run


def _write(rows: DataFrame, parts: int, prepared, folder: str | None, shard_ids: int) -> str:
    """Deal rows (doc_id, and what `prepared` reads) by ranges, sort them in tasks, write what `prepared` makes of them, and the manifest."""
    spark = rows.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    value = rows.columns[-1]
    order = [F.col("doc_id").asc_nulls_first(), "__hash", "__row"]
    dealt = rows.withColumn("__hash", F.xxhash64(value)).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    write = _writer(folder, shard_ids)
    made = stage(dealt.select(rows.columns).mapInArrow(lambda batches: write(prepared(batches)), "part int, shard int, name string, n_ids long, n_docs long"), "shards")
    starts, at = [], 0
    for r in sorted(made.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts.append((r.part, at))
        at += r.n
    first = spark.createDataFrame(starts, "part int, first long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = made.join(first, "part").withColumn("start", F.col("first") + before)
    manifest.select("part", "shard", "name", "start", "n_ids", "n_docs").write.parquet(f"{folder}/manifest")
    unstage(made)
    return folder


def write_ids(rows: DataFrame, folder: str | None = None, shard_ids: int = SHARD_IDS) -> str:
    """Write (doc_id, n_tokens, ids) in ascending order of doc_id, null first; gives the folder (a new one in the shared folder by default).

    ids holds n_tokens unsigned numbers of 2, 4 or 8 bytes each. Rows of one id stand by a hash of their ids. The rows are
    dealt by ranges of (doc_id, hash, row), so that one id with very many rows is split, and sorted in tasks: one shuffle.
    A first id of a part comes from the number of ids of each part before it: one row a part on the driver.
    """
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    return _write(rows.select("doc_id", "n_tokens", "ids"), -(-total // PART_IDS), lambda batches: batches, folder, shard_ids)


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end: int = END, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise whole texts and write their ids, each document's with the end id behind; gives the folder.

    Texts are dealt and sorted as in write_ids() and tokenised once, by the tasks that write them. A null or empty text
    is its end id alone. Rows with a null or repeated id are documents of their own. A text that spells a special token
    out gets its id. Other columns aren't read. A table without rows makes a folder without shards.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _write(rows, -(-total // (4 * PART_IDS)), _tokenised(path, end), folder, shard_ids)


class _Reader:
    """A shard's sizes, ends and document ids; its blocks are read when asked for."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.file = where.open_input_file(path)
        size = self.file.size()
        foot = self._at(size - 40, 40)
        if foot[32:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"not a whole shard: {path}")
        self.n_ids, blocks, docs, self.block = (int(v) for v in np.frombuffer(foot[:32], "<u8"))
        tail = size - 40 - docs * 17 - blocks * 8
        self.sizes = np.frombuffer(self._at(tail, blocks * 8), "<u4").reshape(-1, 2)
        self.ends = np.frombuffer(self._at(tail + blocks * 8, docs * 8), "<u8").astype(np.int64)
        self.ids = np.frombuffer(self._at(tail + blocks * 8 + docs * 8, docs * 8), "<i8")
        self.known = np.frombuffer(self._at(tail + blocks * 8 + docs * 16, docs), np.uint8).astype(bool)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes.sum(1, dtype=np.int64))]) * 8 + len(MAGIC)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop, from their blocks alone."""
        a, b = start // self.block, -(-stop // self.block)
        coded = np.frombuffer(self._at(int(self.offset[a]), int(self.offset[b] - self.offset[a])), "<u8")
        return words.decode(coded, self.sizes[a:b])[start - a * self.block : stop - a * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray, bool]]:
        """(document, its first id's place, ids, whether they end it): whole blocks are decoded once, about CODED ids at a time."""
        doc, step = 0, CODED // self.block * self.block
        starts = np.concatenate([[0], self.ends[:-1]])
        for a in range(0, max(self.n_ids, 1), step):
            b = min(a + step, self.n_ids)
            held = self.between(a, b) if b > a else np.empty(0, np.uint64)
            while doc < len(self.ends):
                x, y = max(int(starts[doc]), a), min(int(self.ends[doc]), b)
                ends = self.ends[doc] <= b
                yield doc, int(starts[doc]), held[x - a : y - a], bool(ends)
                if not ends:
                    break
                doc += 1


def _reading(folder: str, each, schema: pa.Schema):
    """For each shard of the manifest's rows, the record batches that `each` makes of its reader and first place."""

    def run(batches):
        where, root = fs.FileSystem.from_uri(folder + "/shards")
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Reader(where, f"{root}/{row['name']}")
                rows, held = [], 0
                for out, weight in each(reader, row):
                    rows.append(out)
                    held += weight
                    if held >= CODED:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _dealt(shards: DataFrame) -> DataFrame:
    """Shards are dealt out one by one, so that tasks read alike."""
    return shards.repartition(shards.sparkSession.sparkContext.defaultParallelism * 4)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back block by block.

    start counts the ids of all documents before it, ids_crc32 is the unsigned CRC-32 of its ids as little-endian
    unsigned 32-bit numbers. A long document's checksum goes on from one stretch of blocks to the next.
    """

    def each(reader, row):
        check, n = 0, 0
        for doc, start, ids, ends in reader.documents():
            check, n = zlib.crc32(ids.astype("<u4").tobytes(), check), n + len(ids)
            if ends:
                yield (int(reader.ids[doc]) if reader.known[doc] else None, row["start"] + start, n, check), 64
                check, n = 0, 0

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _dealt(manifest(spark, folder)).mapInArrow(_reading(qualified(spark, folder), each, schema), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document."""

    def each(reader, row):
        parts: list[np.ndarray] = []
        for doc, start, ids, ends in reader.documents():
            parts.append(ids)
            if ends:
                whole = np.concatenate(parts).view(np.int64)
                yield (int(reader.ids[doc]) if reader.known[doc] else None, row["start"] + start, whole), len(whole) + 8
                parts = []

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return _dealt(manifest(spark, folder)).mapInArrow(_reading(qualified(spark, folder), each, schema), "doc_id long, start long, ids array<long>")


def span(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """(start, ids array<long>): the ids of places start to stop of the whole dataset, in rows of up to SPAN_IDS; only their shards and blocks are read."""

    def each(reader, row):
        a, b = max(start - row["start"], 0), min(stop - row["start"], reader.n_ids)
        for x in range(a, b, SPAN_IDS):
            ids = reader.between(x, min(x + SPAN_IDS, b)).view(np.int64)
            yield (row["start"] + x, ids), len(ids)

    schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    shards = manifest(spark, folder).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return _dealt(shards).mapInArrow(_reading(qualified(spark, folder), each, schema), "start long, ids array<long>")


def op11_words(spark, sf_dir: str) -> DataFrame:
    folder = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)
