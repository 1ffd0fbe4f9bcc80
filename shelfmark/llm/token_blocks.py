"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of many documents one after the other, cut into blocks of ``block`` ids. A
block subtracts its minimum and packs the rest at the smallest width that holds ``percentile`` of
its values; values beyond that width keep their low bits in place and put the high bits, with
their positions, on an exception list. The file ends in an index of block starts and a table of
documents, so a reader can seek any block or document.

Layout, little-endian: magic ``SMFB``; blocks; index; footer.

- block: u32 minimum, u16 values, u8 width, u8 unused, u16 exceptions, u16 unused; packed bits
  padded to bytes; u16 positions of exceptions; u32 high parts of exceptions.
- index: u64 start of each block, i64 id of each document, u64 ids of each document.
- footer: u64 start of the index, u64 blocks, u64 documents, u64 ids, magic.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, new_folder, saved, shuffle_partitions, table, whole_text
from .words import library_encoder

MAGIC = b"SMFB"
BLOCK = 4096
PERCENTILE = 90.0
END_ID = 2
HEAD, FOOT = struct.Struct("<IHBBHH"), struct.Struct("<QQQQ4s")


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65535 unsigned 32-bit values."""
    values = np.asarray(values, np.int64)
    low = int(values.min())
    rest = (values - low).astype(np.uint32)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    beyond = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = (rest[beyond] >> np.uint32(width)).astype("<u4")
    return HEAD.pack(low, len(values), width, 0, len(beyond), 0) + packed + beyond.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    low, n, width, _, exceptions, _ = HEAD.unpack_from(data)
    at = HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    values = np.zeros(n, np.int64)
    for k in range(width):
        values |= bits[:, k].astype(np.int64) << k
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    high = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    values[places] |= high.astype(np.int64) << width
    return values + low


def write_blocks(out, documents: Iterable[tuple[int, np.ndarray]], block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[int, int]:
    """Write documents to an open binary file; the numbers of documents and ids."""
    out.write(MAGIC)
    at, starts, doc_ids, sizes, held, n_held = len(MAGIC), [], [], [], [], 0

    def flush(all_of_it: bool) -> None:
        nonlocal at, held, n_held
        values = np.concatenate(held) if held else np.zeros(0, np.int64)
        cut = len(values) if all_of_it else len(values) - len(values) % block
        for k in range(0, cut, block):
            data = pack_block(values[k : min(k + block, cut)], percentile)
            starts.append(at)
            out.write(data)
            at += len(data)
        held, n_held = [values[cut:]], len(values) - cut

    for doc_id, ids in documents:
        doc_ids.append(doc_id)
        sizes.append(len(ids))
        held.append(ids)
        n_held += len(ids)
        if n_held >= 64 * block:
            flush(False)
    flush(True)
    out.write(np.array(starts, "<u8").tobytes() + np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<u8").tobytes())
    out.write(FOOT.pack(at, len(starts), len(doc_ids), sum(sizes), MAGIC))
    return len(doc_ids), sum(sizes)


class BlockFile:
    """Reader of one file; holds the index and one block at a time."""

    def __init__(self, file):
        self.file = file
        file.seek(-FOOT.size, io.SEEK_END)
        end = file.tell()
        index, blocks, docs, self.n_ids, magic = FOOT.unpack(file.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token block file")
        file.seek(index)
        data = file.read(end - index)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", docs, 8 * blocks)
        self.sizes = np.frombuffer(data, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        self.file.seek(int(self.starts[k]))
        return unpack_block(self.file.read(int(self.starts[k + 1] - self.starts[k])))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Documents in file order."""
        held, k = np.zeros(0, np.int64), 0
        for doc_id, size in zip(self.doc_ids.tolist(), self.sizes.tolist(), strict=True):
            parts, n = [held], len(held)
            while n < size:
                parts.append(self.block(k))
                n += len(parts[-1])
                k += 1
            values = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, values[:size]
            held = values[size:]


def _opened(path: str):
    """The file system of a URI and the path in it (local, HDFS and object stores)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _write_shard(batches: Iterator[pd.DataFrame], folder: str, tokenizer: str, end_id: int, block: int, percentile: float) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    task = TaskContext.get()
    encoder = library_encoder(tokenizer)
    first: list[int] = []

    def documents() -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for doc_id, ids in zip(batch.doc_id.tolist(), encoder.encode(batch.text.tolist()), strict=True):
                first[:] = first or [doc_id]
                yield doc_id, np.append(ids, end_id)

    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    name = f"{base}/shard-{task.partitionId():06d}.smfb"
    part = f"{name}.{task.taskAttemptId()}"
    with system.open_output_stream(part) as out:
        n_docs, n_ids = write_blocks(out, documents(), block, percentile)
    if n_docs:
        system.move(part, name)  # a repeated attempt writes the same bytes
        yield pd.DataFrame({"shard": [task.partitionId()], "first_doc_id": first, "file": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [n_docs], "n_ids": [n_ids]})
    else:
        system.delete_file(part)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write their ids, in ascending doc_id order, as one file a
    range of doc_ids. Rows without a doc_id sort first and are written as doc_id -1.

    Returns the files: shard, first_doc_id, file, n_docs, n_ids. Texts are shuffled once, by ranges
    of doc_id; equal doc_ids keep each their row, ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    write = partial(_write_shard, folder=folder, tokenizer=tokenizer, end_id=end_id, block=block, percentile=percentile)
    return saved(in_batches(ordered, write, "shard int, first_doc_id long, file string, n_docs long, n_ids long"), "token-files")


def _read_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, base in zip(batch.file, batch.base, strict=True):
            system, path = _opened(file)
            with system.open_input_file(path) as source:
                reader, at, out = BlockFile(source), int(base), []
                for doc_id, ids in reader.documents():
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) >= 2000:
                        yield _frame(out)
                        out = []
                yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The start of a file comes from a running sum over the files' rows (one row a file).
    """
    from pyspark.sql import Window

    spark = files.sparkSession
    before = Window.orderBy("first_doc_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = based.select("file", "base").repartition(shuffle_partitions(spark), "file")
    return spread.mapInPandas(_read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token block files and read back.

    Null and empty texts hold only the end id; a null doc_id is written as -1; equal doc_ids keep each
    their row, by text; an empty table gives no files and no rows; other columns are not read.
    """
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-blocks"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(files)
