"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents in order of their length form runs of equal length, and so do the gaps of the
sequences in order of their size; there are at most as many of either as a sequence has
tokens, however many documents there are.  A round takes the longest documents left, sweeps
the gaps for the successor of that length, and matches documents and gaps by rank: the n-th
document of a run gets the n-th gap.  Matched gaps shrink, what finds no gap opens sequences,
and the next round follows.  Rounds move runs only; every document finds its place by its
rank, which tasks count on their own and a sum over tasks completes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize
from seriesloom.llm.tokens import END_OF_TEXT, encoder

#: Pieces that leave a task together.
BATCH_PIECES = 20_000


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``most``."""
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)] if n else []


def document_pieces(docs: DataFrame, tokenizer: str, most: int, keep_ids: bool = False, end: int = END_OF_TEXT) -> DataFrame:
    """Tokenise ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32[, ids], _task, _rank``.

    ``_rank`` counts the pieces of equal length within the task ``_task``.  A null text is
    empty and gives one piece, its end.
    """
    kept = ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, dtype=np.int64)
        held: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_rank"] + ["ids"] * keep_ids
            types = [pa.int64(), pa.int32()] + [pa.int64()] * 4 + [pa.binary()] * keep_ids
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names.insert(6, "_task")
            arrays.insert(6, pa.array(np.full(len(rows), task, dtype=np.int32)))
            return pa.RecordBatch.from_arrays(arrays, names).select(order)

        order = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["_task", "_rank"]
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode.ended(text.as_py() or "", end)
                raw = memoryview(ids.tobytes())
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    data = raw[4 * start : 4 * (start + length)]
                    held.append((doc, piece, start, length, zlib.crc32(data), int(seen[length])) + ((bytes(data),) if keep_ids else ()))
                    seen[length] += 1
                    size += len(data) if keep_ids else 0
                    if len(held) >= BATCH_PIECES or size >= 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    schema = f"doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint{kept}, _task int, _rank bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Match runs of lengths with runs of gaps: ``(length, first rank, count, first sequence, offset)``.

    ``counts`` says how many documents have each length; both are at most ``capacity``.
    """
    gaps: dict[int, deque] = {}  # size -> runs (first sequence, count)
    sizes: list[int] = []  # of gaps, ascending
    out, opened = [], 0

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = deque()
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor sweep
            if at == len(sizes):
                new = -(-left // (capacity // length))
                leave(capacity, opened, new)
                opened += new
                continue
            size = sizes[at]
            first, count = gaps[size].popleft()
            take = min(count, left)  # conflicts: the lower rank takes the gap
            if take < count:
                gaps[size].appendleft((first + take, count - take))
            elif not gaps[size]:
                del gaps[size], sizes[at]
            out.append((length, rank, take, first, capacity - size))
            leave(size - length, first, take)
            rank, left = rank + take, left - take
    return out


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id, offset`` to stored ``pieces(length, _task, _rank, ...)``; drops the last two.

    At most ``capacity`` counts reach the driver.
    """
    per_task = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = np.array(best_fit(counts, capacity), dtype=np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = pieces.sparkSession.sparkContext.broadcast(runs)
    names = [c for c in pieces.columns if c not in ("_task", "_rank")]
    schema = ", ".join([f"`{c}` {t}" for c, t in pieces.dtypes if c in names] + ["sequence_id bigint", "`offset` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            rank = rank + batch.column("_before").to_numpy(zero_copy_only=False)
            found = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(runs) else runs
            sequence = pa.array(found[:, 3] + rank - found[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [sequence, pa.array(found[:, 4])], [*names, "sequence_id", "offset"]
            )

    return pieces.join(starts, ["_task", "length"]).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Documents longer than ``capacity`` are cut, their first piece may be shorter; others stay
    whole.  Null and empty texts are documents of their end alone; repeated rows and ids are
    packed each; a null doc_id stays null; other columns are ignored; no documents give no rows.
    """
    return place(materialize(document_pieces(docs, tokenizer, capacity, keep_ids)), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths`` of sequences packed with their ids; a sequence holds few pieces by its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("lengths"),
    )
