"""Token corpora as Arrow files of fixed-size lists.

A shard is one Arrow IPC file. Every row is a sequence of ``length`` ids and a mask of the same
length, both fixed-size lists, and every batch but the last has the same number of rows (the file's
metadata says how many), so row ``i`` lies at a computable place of the mapped file and is read
without copying. Shards hold consecutive doc_id ranges; the ids of their documents follow one
another, and only a shard's last sequence is padded (mask false). A second file per shard lists its
documents. Files appear under their final name only when complete, with the same bytes whichever
attempt wrote them.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import partitions, shared_folder
from .tokens import tokenizer_at

#: The schema's metadata key for the rows of a batch.
ROWS = b"rows_per_batch"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(id_type: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", id_type, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system any worker can open, and the path inside it (file, hdfs, s3, gs, ...)."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Shard:
    """Writes one shard in batches of exactly ``rows`` sequences (the last may have fewer), and its list of documents."""

    def __init__(self, store, root: str, name: str, id_type: np.dtype, length: int, rows: int):
        self.store, self.root, self.name, self.hidden = store, root, name, posixpath.join(root, f".{name}-{uuid.uuid4().hex}")
        self.length, self.type, self.rows = length, id_type, rows
        self.schema = sequence_schema(pa.from_numpy_dtype(id_type), length).with_metadata({ROWS: str(rows)})
        store.create_dir(root, recursive=True)
        self.sinks = [store.open_output_stream(f"{self.hidden}.{x}") for x in ("arrow", "docs")]
        self.writer, self.lister = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], DOCS)
        self.parts, self.held = [], 0
        self.index: list[tuple] = []
        self.docs, self.ids = 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.index.append((doc, self.ids, len(ids)))
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        if len(self.index) >= 1 << 16:
            self._list()
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.rows * self.length:
            self._write(False)

    def _list(self) -> None:
        if self.index:
            self.lister.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=DOCS))
        self.index = []

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, self.type)
        full = self.rows * self.length
        n = len(ids) if last else len(ids) // full * full
        for lo in range(0, n, full):
            now = ids[lo : min(n, lo + full)]
            mask = np.ones(-(-len(now) // self.length) * self.length, bool)
            mask[len(now) :] = False
            now = np.concatenate([now, np.zeros(len(mask) - len(now), self.type)])
            ids_list, mask_list = (pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((now, mask)))
            self.writer.write_batch(pa.RecordBatch.from_arrays([ids_list, mask_list], schema=self.schema))
        self.parts, self.held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        self._write(True)
        self._list()
        for x in (self.writer, self.lister, *self.sinks):
            x.close()
        for kind in ("arrow", "docs"):
            self.store.move(f"{self.hidden}.{kind}", posixpath.join(self.root, f"{self.name}.{kind}"))

    def drop(self) -> None:
        """Remove what a failed attempt has written."""
        for sink in self.sinks:
            sink.close()
        for kind in ("arrow", "docs"):
            if self.store.get_file_info(f"{self.hidden}.{kind}").type != fs.FileType.NotFound:
                self.store.delete_file(f"{self.hidden}.{kind}")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, length: int = 2048, rows: int = 256, shards: int | None = None, text: str = "text") -> list[tuple[str, int, int]]:
    """Write ``docs`` in ascending doc_id order under ``folder``: (shard, documents, ids) of each shard, in order.

    A batch holds ``rows`` sequences of ``length`` ids. A null text is empty; each document ends with ``end_id``. Rows of one doc_id stand together,
    ordered by text; a null doc_id sorts first. The list that comes back has a row a shard.
    """
    shards = shards or partitions(docs.sparkSession)

    def run(batches):
        words = tokenizer_at(tokenizer)
        end = np.array([end_id], words.type)
        store, root = open_folder(folder)
        shard = None
        try:
            for batch in batches:
                texts = (x.as_py() for x in batch.column(1))
                for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(texts), strict=True):
                    if shard is None:
                        shard = _Shard(store, root, f"shard-{TaskContext.get().partitionId():06d}", words.type, length, rows)
                    shard.add(doc, np.concatenate([ids, end]))
            if shard is not None:
                shard.close()
        except BaseException:
            if shard is not None:
                shard.drop()
            raise
        if shard is not None:
            yield pa.RecordBatch.from_pydict({"shard": [shard.name], "docs": [shard.docs], "ids": [shard.ids]})

    ordered = docs.select("doc_id", text).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", text)
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "shard string, docs long, ids long").collect())


class TokenFile:
    """Random access to one shard; a local file is mapped, so sequences and masks are views of it."""

    def __init__(self, folder: str, shard: str):
        store, root = open_folder(folder)
        path = posixpath.join(root, f"{shard}.arrow")
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        with store.open_input_file(posixpath.join(root, f"{shard}.docs")) as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.batches: dict[int, pa.RecordBatch] = {}
        self.rows = int(self.reader.schema.metadata[ROWS])

    def batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.reader.get_batch(k)}
        return self.batches[k]

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.rows + self.batch(n - 1).num_rows if n else 0

    def _place(self, i: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= i < len(self):
            raise IndexError(f"sequence {i} of {len(self)}")
        return self.batch(i // self.rows), i % self.rows * self.length

    def sequence(self, i: int) -> np.ndarray:
        batch, at = self._place(i)
        return batch.column(0).values.to_numpy()[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        batch, at = self._place(i)
        return batch.column(1).values.slice(at, self.length).to_numpy(zero_copy_only=False)

    def crc32s(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers; one pass over the shard."""
        starts = self.docs.column("start").to_numpy()
        ends = starts + self.docs.column("n_tokens").to_numpy()
        out = np.zeros(len(starts), np.int64)
        crc, doc, at = 0, 0, 0
        for k in range(self.reader.num_record_batches):
            ids = self.batch(k).column(0).values.to_numpy().astype("<u4")
            while doc < len(starts):
                a, b = max(starts[doc], at) - at, min(ends[doc], at + len(ids)) - at
                crc = zlib.crc32(ids[a:b], crc)
                if ends[doc] > at + len(ids):
                    break
                out[doc], crc, doc = crc, 0, doc + 1
                if doc < len(starts) and starts[doc] >= at + len(ids):
                    break
            at += len(ids)
        return out


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start in the whole corpus, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    base, rows = 0, []
    for name, _, ids in shards:
        rows.append((name, base))
        base += ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(folder, row["shard"])
                start = pa.array(file.docs.column("start").to_numpy() + row["base"])
                yield pa.RecordBatch.from_arrays([file.docs.column("doc_id").combine_chunks(), start, file.docs.column("n_tokens").combine_chunks(), pa.array(file.crc32s())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "shard string, base long").repartition(len(rows))
    return listed.mapInArrow(run, schema)


def op5_token_file(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to token files and report, from the files, each document's place, length and crc32.

    Null and empty texts are their end id alone. A null doc_id sorts first; repeated doc_ids stand
    together, ordered by text, a row each. No documents give no file and no row. Columns other than
    doc_id and text are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    shards = write_tokens(docs, tokenizer, folder)
    return read_tokens(spark, folder, shards).select("doc_id", "start", "n_tokens", "ids_crc32")
