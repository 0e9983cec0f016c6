"""Token ids in Arrow stream files of equal-length sequences (operator 2).

All documents' ids, in ascending order of doc_id, form one long row of ids; each part of it goes to one
pair of files in the shared folder:

- ids-<part>.arrow: record batches with ``ids fixed_size_list<uint16 or uint32>[length]`` (the narrower
  where the vocabulary fits) and ``mask fixed_size_list<bool>[length]`` (true for an id, false for the
  padding that fills a part's last sequence). A batch's buffers are plain arrays of batch x length
  values, so a memory-mapped reader takes any sequence, or any run of ids, without copying or decoding.
- docs-<part>.arrow: ``doc_id, start, n_tokens`` of each document; ``start`` counts from the part's first id.

Defined cases: a null text counts as empty; an empty text has the end id alone; rows that repeat a
doc_id keep an entry each, ordered by a hash of the text; a null doc_id comes first; an empty table gives no files
and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from concord.llm import common, tokens

SEQUENCE_LENGTH = 2048
SEQUENCES_A_BATCH = 64


def _local(uri: str):
    """(file system, path) of a URI or plain path; HDFS and object stores go through the same calls."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _sequence_schema(length: int, narrow: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class PartWriter:
    """Writes one part's ids and documents as they come; memory holds one batch of sequences."""

    def __init__(self, folder: str, name: str, length: int, per_batch: int, narrow: bool) -> None:
        self.schema, self.narrow = _sequence_schema(length, narrow), narrow
        self.fs, base = _local(folder)
        self.fs.create_dir(base, recursive=True)
        self.ids_path, self.docs_path = f"{folder}/ids-{name}.arrow", f"{folder}/docs-{name}.arrow"
        self.length, self.per_batch = length, per_batch
        self.ids_file, self.docs_file = (self.fs.open_output_stream(f"{base}/{kind}-{name}.arrow") for kind in ("ids", "docs"))
        self.ids_out = pa.ipc.new_stream(self.ids_file, self.schema)
        self.docs_out = pa.ipc.new_stream(self.docs_file, DOCS_SCHEMA)
        self.kept, self.n_ids, self.n_docs = bytearray(), 0, 0

    def _write(self, data: bytes | bytearray, n_ids: int) -> None:
        import numpy as np

        flat = np.frombuffer(bytes(data), dtype="<u4").astype("<u2" if self.narrow else "<u4", copy=False)
        mask = np.zeros(len(flat), dtype=bool)
        mask[:n_ids] = True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.ids_out.write_batch(pa.record_batch(arrays, schema=self.schema))

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        starts, sizes = [], [len(e) // 4 for e in encoded]
        for e, n in zip(encoded, sizes, strict=True):
            starts.append(self.n_ids)
            self.n_ids += n
            self.kept += e
        self.docs_out.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS_SCHEMA))
        self.n_docs += len(doc_ids)
        step = 4 * self.length * self.per_batch
        full = len(self.kept) // step * step
        for i in range(0, full, step):
            self._write(self.kept[i : i + step], step // 4)
        del self.kept[:full]

    def close(self) -> None:
        if self.kept:
            row = 4 * self.length
            n = len(self.kept) // 4
            self._write(self.kept + bytes(-len(self.kept) % row), n)
        for out in (self.ids_out, self.docs_out, self.ids_file, self.docs_file):
            out.close()


class PartReader:
    """Random access to a part: ids(start, n) views the mapped buffers."""

    def __init__(self, ids_path: str, docs_path: str) -> None:
        import numpy as np

        fs, base = _local(ids_path)
        ids = pa.ipc.open_stream(pa.memory_map(base) if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file(base)).read_all()
        fs, base = _local(docs_path)
        self.docs = pa.ipc.open_stream(fs.open_input_file(base)).read_all()
        self.length = ids.schema.field("ids").type.list_size
        self.chunks = [c.flatten().to_numpy(zero_copy_only=True) for c in ids.column("ids").chunks]
        self.masks = [c.flatten() for c in ids.column("mask").chunks]
        self.ends = np.cumsum([len(c) for c in self.chunks])

    def sequence(self, k: int):
        """(ids, mask) of the k-th sequence of the part, both views."""
        import numpy as np

        i = int(np.searchsorted(self.ends, k * self.length, side="right"))
        at = k * self.length - (int(self.ends[i - 1]) if i else 0)
        return self.chunks[i][at : at + self.length], self.masks[i].slice(at, self.length)

    def ids(self, start: int, n: int) -> Iterator:
        """The pieces of a run of ids, each a view of one batch."""
        import numpy as np

        i = int(np.searchsorted(self.ends, start, side="right"))
        while n > 0:
            at = start - (int(self.ends[i - 1]) if i else 0)
            piece = self.chunks[i][at : at + n]
            yield piece
            start, n, i = start + len(piece), n - len(piece), i + 1


def write_ids(docs: DataFrame, end_id: int, tokenizer_path: str | None = None, length: int = SEQUENCE_LENGTH, folder: str | None = None) -> list[Row]:
    """Encode and write all documents; returns one row for each part, in order: ids_path, docs_path, n_docs, n_ids, base.

    The list is as long as the range partitioning has parts. A task that runs again writes files of
    another name; only those of the attempt that counted are in the list.
    """
    spark = docs.sparkSession
    folder = folder or common.fresh_path(spark, "ids")
    path = tokenizer_path or tokens.default_path()
    end = end_id.to_bytes(4, "little")
    per_batch = SEQUENCES_A_BATCH

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encoder, writer = tokens.encoder(path), None
        narrow = max(end_id, encoder.tokenizer.get_vocab_size() - 1) < 1 << 16
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    part = TaskContext.get().partitionId()
                    writer = PartWriter(folder, f"{part:06d}-{uuid.uuid4().hex}", length, per_batch, narrow)
                encoded = encoder.encode(batch.column("text").to_pylist())
                writer.add(batch.column("doc_id").to_pylist(), [e + end for e in encoded])
        encoder.forget()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_path": [writer.ids_path], "docs_path": [writer.docs_path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(F.col("text")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = whole.repartitionByRange(common.partitions_for(whole), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with common.bounded_batches(spark):
        rows = ordered.mapInArrow(encode, "part int, ids_path string, docs_path string, n_docs long, n_ids long").collect()
    parts, base = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        parts.append(Row(ids_path=r.ids_path, docs_path=r.docs_path, n_docs=r.n_docs, n_ids=r.n_ids, base=base))
        base += r.n_ids
    return parts


def read_documents(spark, parts: list[Row]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    listed = [(p.ids_path, p.docs_path, p.base) for p in parts]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("part").to_pylist():
                ids_path, docs_path, base = listed[k]
                reader = PartReader(ids_path, docs_path)
                for docs in reader.docs.to_batches():
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for piece in reader.ids(start, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array([s + base for s in docs.column("start").to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(listed), 1, len(listed)).select(F.col("id").alias("part")).mapInArrow(read, schema)


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_ids(common.documents(spark, sf_dir), end_id=1))
