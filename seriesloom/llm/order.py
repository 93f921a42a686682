"""Token sequences written to disk in the order of training.

Documents are tokenised, joined end to end within each task and cut into sequences of one
length.  A keyed Feistel permutation, walked until it stays below the number of sequences,
gives every sequence its global slot without a sort or a table.  A shard is a range of slots
in one file of fixed stride, so reading in training order is sequential, and any slot is one
seek.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize, scratch_path, shuffle_width
from seriesloom.llm.tokens import END_OF_TEXT, encoder
from seriesloom.llm.words import mix

ROUNDS = 6
#: Sequences of a shard.
SHARD_ROWS = 4096


def slots(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slot of each index below ``count``: a permutation of ``range(count)`` chosen by ``key``."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    low, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> width, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walking] = (left << width) | right
        walking = walking[out[walking] >= count]
    return out.astype(np.int64)


class _Stream:
    """Documents end to end, cut into sequences; knows which part of which document is where."""

    def __init__(self, length: int):
        self.length, self.ids, self.parts, self.held = length, [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple]]]:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.length - self.held)
            self.ids.append(ids[at : at + take])
            self.parts.append((doc, at, take))
            self.held += take
            at += take
            if self.held == self.length:
                yield self.close()

    def close(self) -> tuple[np.ndarray, list[tuple]]:
        out = np.concatenate(self.ids), self.parts
        self.ids, self.parts, self.held = [], [], 0
        return out


def _counts(docs: DataFrame, tokenizer: str, length: int) -> dict[int, int]:
    """Sequences of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = encoder(tokenizer), 0
        for batch in batches:
            n += sum(len(encode.ids(t.as_py() or "")) + 1 for t in batch.column("text"))
        if n:
            yield pa.record_batch([[TaskContext.get().partitionId()], pa.array([-(-n // length)], pa.int64())], ["task", "n"])

    return {r.task: r.n for r in docs.mapInArrow(run, "task bigint, n bigint").collect()}


_PARTS = "array<struct<doc_id:bigint,start:bigint,length:bigint>>"


def sequences(docs: DataFrame, tokenizer: str, length: int, key: int) -> DataFrame:
    """``slot, sequence, length, parts, ids`` of ``docs(doc_id, text)``; ``ids`` are compressed.

    The last sequence of a task may be shorter.  Tokens are counted in a first pass, because
    slots need the number of all sequences; both passes scan the same splits, and a task whose
    counts differ fails.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = _counts(docs, tokenizer, length)
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task], total = total, total + counts[task]
    sent = docs.sparkSession.sparkContext.broadcast((starts, counts, total))  # two numbers a task
    part = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, counts, total = sent.value
        task, encode, stream, press = TaskContext.get().partitionId(), encoder(tokenizer), _Stream(length), zstandard.ZstdCompressor(level=1)
        kind, made, out = width_of(tokenizer), 0, []

        def batch_of() -> pa.RecordBatch:
            nonlocal made, out
            index = starts[task] + np.arange(made, made + len(out))
            columns = [
                pa.array(slots(index, total, key)), pa.array(index), pa.array([len(ids) for ids, _ in out], pa.int64()),
                pa.array([[dict(zip(("doc_id", "start", "length"), p)) for p in parts] for _, parts in out], part),
                pa.array([press.compress(ids.astype(kind).tobytes()) for ids, _ in out], pa.binary()),
            ]
            made, out = made + len(out), []
            return pa.RecordBatch.from_arrays(columns, ["slot", "sequence", "length", "parts", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                out += stream.add(doc, encode.ended(text.as_py() or "", END_OF_TEXT))
                if len(out) >= 1024:
                    yield batch_of()
        if stream.held:
            out.append(stream.close())
        if out:
            yield batch_of()
        if made != counts.get(task, 0):
            raise RuntimeError(f"task {task} made {made} sequences, not {counts.get(task, 0)}")

    return docs.mapInArrow(run, f"slot bigint, sequence bigint, length bigint, parts {_PARTS}, ids binary")


def width_of(tokenizer: str) -> str:
    """Little-endian unsigned type of an id: two bytes where the vocabulary allows."""
    return "<u2" if encoder(tokenizer).exact.get_vocab_size() <= 1 << 16 else "<u4"


def write_shards(rows: DataFrame, folder: str, tokenizer: str, length: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write ``sequences`` below ``folder``; returns the index ``slot, shard, row, length, parts, path``, stored.

    A shard holds slots ``shard * shard_rows`` and on, ``length`` ids each, short sequences filled
    with zeros.  Attempts write under names of their own; the index names those that succeeded.
    """
    stride = length * np.dtype(width_of(tokenizer)).itemsize
    dealt = rows.withColumn("shard", F.expr(f"slot div {shard_rows}")).repartition(shuffle_width(rows), "shard").sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        shard = out = name = None
        for batch in batches:
            paths = []
            for at, ids in zip(batch.column("shard").to_pylist(), batch.column("ids")):
                if at != shard:
                    if out:
                        out.close()
                    shard, name = at, f"shard-{at:010d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{base}/{name}")
                out.write(unpack.decompress(ids.as_py()).ljust(stride, b"\0"))
                paths.append(f"{folder}/{name}")
            row = pa.array(batch.column("slot").to_numpy() % shard_rows)
            columns = [batch.column("slot"), batch.column("shard"), row, batch.column("length"), batch.column("parts"), pa.array(paths)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "row", "length", "parts", "path"])
        if out:
            out.close()

    return materialize(dealt.select("slot", "shard", "length", "parts", "ids").mapInArrow(run, f"slot bigint, shard bigint, row bigint, length bigint, parts {_PARTS}, path string"))


def read_shards(index: DataFrame, tokenizer: str, length: int, first: int = 0) -> DataFrame:
    """``slot, shard, row, length, parts, ids`` (little-endian 32-bit) from slot ``first`` on; a shard is read front to back."""
    kind = np.dtype(width_of(tokenizer))
    stride = length * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, ids = batch.slice(at, 1024), []
                for name, row, n in zip(*(part.column(c).to_pylist() for c in ("path", "row", "length"))):
                    if name != path:
                        store, base = fs.FileSystem.from_uri(name)
                        path, file = name, store.open_input_file(base)
                    if file.tell() != row * stride:
                        file.seek(row * stride)
                    data = file.read(stride)
                    ids.append(np.frombuffer(data, dtype=kind)[:n].astype("<u4").tobytes())
                kept = [part.column(c) for c in ("slot", "shard", "row", "length", "parts")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], ["slot", "shard", "row", "length", "parts", "ids"])

    dealt = index.filter(F.col("slot") >= first).repartition(shuffle_width(index), "path").sortWithinPartitions("path", "row")
    return dealt.mapInArrow(run, f"slot bigint, shard bigint, row bigint, length bigint, parts {_PARTS}, ids binary")


def materialise(docs: DataFrame, tokenizer: str, length: int = 1024, key: int = 20240229, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write ``docs(doc_id, text)`` in training order into the shared folder; returns the index of the shards.

    Null and empty texts are documents of their end alone, repeated rows are written each, a null
    doc_id stays null, no documents give no shards; other columns are ignored.
    """
    folder = scratch_path(docs.sparkSession, "shards")
    return write_shards(sequences(docs, tokenizer, length, key), folder, tokenizer, length, shard_rows)

