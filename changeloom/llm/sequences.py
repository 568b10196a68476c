"""Token ids as Arrow files: rows of equal-length sequences and masks that are read without copying.

A file is in Arrow's IPC file form, the stream of batches closed by a footer that tells where each one lies. A row is one
sequence of LENGTH ids (a fixed-size list) with its mask (1: an id, 0: padding at the end of a file; a fixed-size list too, kept once for
all full sequences as a dictionary's value) and the documents that begin in it. All batches of a file but the last have BATCH rows, so sequence i is row i % BATCH of batch i // BATCH, and its ids
are a view of the file's memory. Files end between documents. Spark's own committer writes them, to any store it can write:
the text writer puts a "line end" after each file's only value, and that line end is the closing mark of the format.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.llm import kernel, packing
from changeloom.llm.shared import cut, fresh, partitions

LENGTH, BATCH, FILE_TOKENS = 2048, 256, 1 << 22
MAGIC = b"ARROW1"  # fixed value: what closes an Arrow file


def _fixed(values: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


def _view(lists: pa.FixedSizeListArray, i: int) -> np.ndarray:
    n, k = lists.type.list_size, lists.offset + i
    return lists.values.slice(k * n, n).to_numpy(zero_copy_only=True)


def arrow_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array, length: int = LENGTH, batch: int = BATCH, place: tuple[int, int] = (0, 0)) -> pa.Buffer:
    """One file of the documents whose ids follow each other in `ids`. place: the range of documents and the number in it, for the order of files."""
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, ids.dtype)
    full[: len(ids)] = ids
    masks = (np.arange(2 * length) < length + len(ids) - max(rows - 1, 0) * length).astype(np.uint8)  # of full sequences, and of the last one
    which = np.zeros(rows, np.int8)
    which[-1:] = 1
    start = np.cumsum(lengths) - lengths
    row = start // length
    upto = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    begins = pa.ListArray.from_arrays(pa.array(upto), pa.array((start - row * length).astype(np.int32)))
    names = pa.ListArray.from_arrays(pa.array(upto), doc_ids.cast(pa.int64()))
    table = {"ids": _fixed(full, length), "mask": pa.DictionaryArray.from_arrays(pa.array(which), _fixed(masks, length)), "doc_id": names, "begin": begins}
    schema = pa.schema([(k, v.type) for k, v in table.items()], metadata={"range": str(place[0]), "file": str(place[1])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as out:
        for i in range(0, rows, batch):
            out.write_batch(pa.record_batch([v.slice(i, batch) for v in table.values()], schema=schema))
    return sink.getvalue()


class Sequences:
    """Random access to one file's sequences, given a memory map, a buffer or bytes. Nothing is decoded or copied: arrays are views of the given memory."""

    def __init__(self, source: pa.NativeFile | pa.Buffer | bytes):
        self.file = pa.ipc.open_file(source)
        n = self.file.num_record_batches
        self.batch = self.file.get_batch(0).num_rows if n else 0
        self.rows = (n - 1) * self.batch + self.file.get_batch(n - 1).num_rows if n else 0
        meta = self.file.schema.metadata
        self.place = int(meta[b"range"]), int(meta[b"file"])

    def __len__(self) -> int:
        return self.rows

    def _column(self, i: int, name: str) -> pa.Array:
        if not 0 <= i < self.rows:
            raise IndexError(i)
        return self.file.get_batch(i // self.batch).column(name)

    def ids(self, i: int) -> np.ndarray:
        return _view(self._column(i, "ids"), i % self.batch)

    def mask(self, i: int) -> np.ndarray:
        column = self._column(i, "mask")
        return _view(column.dictionary, column.indices[i % self.batch].as_py())

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids) of each document, batch by batch; a document that lies in several batches is put together."""
        name, begin, parts, at = None, -1, [], 0
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids, mask, names, places = (batch.column(c) for c in ("ids", "mask", "doc_id", "begin"))
            n = ids.type.list_size
            held = mask.dictionary.flatten().to_numpy().reshape(-1, n).sum(1)[mask.indices.to_numpy()].sum()
            flat = ids.flatten().to_numpy()[: int(held)]
            per = np.diff(names.offsets.to_numpy())
            first = np.repeat(np.arange(len(per)), per) * n + places.flatten().to_numpy()
            ends = [0, *first.tolist(), len(flat)]
            for k, (d, s, e) in enumerate(zip([name, *names.flatten().to_pylist()], ends, ends[1:], strict=False)):
                if k:
                    if begin >= 0:
                        yield name, begin, np.concatenate(parts)
                    name, begin, parts = d, at + s, []
                parts.append(flat[s:e])
            at += len(flat)
        if begin >= 0:
            yield name, begin, np.concatenate(parts)


def write_sequences(docs: DataFrame, path: str, tokenizer_path: str, final: int = 2, length: int = LENGTH, file_tokens: int = FILE_TOKENS, plain_special: bool = False) -> None:
    """Write the ids of all documents (doc_id, text), each closed by `final`, as files under path, in ascending doc_id order.

    Documents are dealt by ranges of doc_id and sorted in them; null doc_ids come first, rows that repeat a doc_id follow each other by
    a hash of their texts, then by their texts. A null text is empty, so `final` alone; other columns are ignored; an empty table
    gives no files. A file ends with the document that reaches file_tokens, so one document is never in two files, and the last
    sequence of a file is padded under its mask. Strings of special tokens are those tokens, as the library has it, or ordinary text with plain_special.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_files = TaskContext.get().partitionId(), 0
        tok = packing.tokenizer(tokenizer_path, plain_special)
        ids, lens, names, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal n_files, held
            whole = arrow_file(np.concatenate(ids), np.concatenate(lens), pa.concat_arrays(names), length, place=(part, n_files))
            for x in (ids, lens, names):
                x.clear()
            n_files, held = n_files + 1, 0
            value = memoryview(whole)
            assert value[-len(MAGIC) :] == MAGIC
            return pa.record_batch([pa.array([value[: -len(MAGIC)]], pa.binary())], names=["value"])

        for b in batches:
            for i, j, data, off in kernel.slices(b.column(1)):
                flat, size = tok.encode(data, off, final)
                ends, k = np.cumsum(size), 0
                while k < len(size):  # whole documents until the file is full
                    done = int(ends[k - 1]) if k else 0
                    m = min(int(np.searchsorted(ends, done + file_tokens - held)) + 1, len(size))
                    ids.append(flat[done : ends[m - 1]])
                    lens.append(size[k:m])
                    names.append(b.column(0).slice(i + k, m - k))
                    held += int(ends[m - 1]) - done
                    k = m
                    if held >= file_tokens:
                        yield close()
        if held:
            yield close()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = d.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of unsigned little-endian 32-bit ids) of each document in the files under path; ids where asked for.

    Each file is read once, by one task. `start` adds what earlier ranges and files hold: a row a range goes to the driver, as many as
    the job that wrote them had partitions. No files: no rows.
    """
    ddl = "range long, file long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ddl.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for content in b.column(0):
                if not len(content.as_buffer()):
                    continue  # what Spark leaves of an empty partition
                one, rows = Sequences(content.as_buffer()), []
                for d, s, ids in one.documents():
                    rows.append((*one.place, d, s, len(ids), zlib.crc32(ids.astype("<u4")), *[ids.astype(np.int32)] * with_ids))
                    if len(rows) >= 5000:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    found = cut(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl), "sequences")
    size = found.groupBy("range", "file").agg(F.sum("n_tokens").alias("n"))
    per = sorted(size.groupBy("range").agg(F.sum("n")).collect())
    upto = np.cumsum([0, *(n for _, n in per)]).tolist()
    base = spark.createDataFrame([(r, b) for (r, _), b in zip(per, upto, strict=False)], "range long, base long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = size.join(F.broadcast(base), "range").select("range", "file", (F.col("base") + before).alias("upto"))
    return found.join(files, ["range", "file"]).select("doc_id", (F.col("start") + F.col("upto")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, final: int = 2) -> DataFrame:
    """Write documents as files into the shared folder and read them back."""
    path = fresh(docs.sparkSession, "arrow")
    write_sequences(docs, path, tokenizer_path, final)
    return read_documents(docs.sparkSession, path)
