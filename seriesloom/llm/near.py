"""Documents whose word shingle sets are nearly equal: size-banded tiles with bitmap bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.jaccard import Bands, Filed, clusters, in_tiles, tile_components
from seriesloom.llm.store import fresh, join_checked, materialize, shuffle_width
from seriesloom.llm.words import Words, column_bytes, mix, shingle_sets, steps

#: Rows of sets that a task sends on at a time.
STEP_ROWS = 256
#: Stands for a row by its id and text; rows that agree in both are alike.
_ROW = "xxhash64(doc_id, text)"


def _summary(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return b"".join(int(np.sum(mix(found ^ np.uint64(c)), dtype=np.uint64)).to_bytes(8, "little") for c in (0x1234567, 0xABCDEF89ABCDEF))


#: Counters of shingles by their low bits, the slices they are summed in, and how many deviations above the mean is heavy.
COUNTERS, SLICES, HEAVY = 1 << 20, 64, 6.0


def heavy_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Marks of the low bits of shingles that all documents hold far more often than the mean.

    Tasks send their counters compressed and in slices; ``COUNTERS`` sums reach the driver,
    however many documents there are.
    """
    each = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets):
                grams, valid = Words(data, offsets[a : b + 1]).grams(words)
                held.append((grams[valid] & np.uint64(COUNTERS - 1)).astype(np.int64))
                size += len(held[-1])
                if size >= COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        press = zstandard.ZstdCompressor(level=1)
        parts = [press.compress(total[k * each : (k + 1) * each].tobytes()) for k in range(SLICES)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for at, data in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                some = np.frombuffer(unpack.decompress(data.as_py()), dtype=np.int64)
                sums[at] = sums[at] + some if at in sums else some
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition(min(SLICES, shuffle_width(docs)), "slice").mapInArrow(add, schema)
    total = np.zeros(COUNTERS, dtype=np.int64)
    for r in sums.collect():
        total[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(r["counts"], dtype=np.int64)
    return total > total.mean() + HEAVY * np.sqrt(total.mean()) + HEAVY


def set_table(docs: DataFrame, words: int, num: int, den: int, keyed: bool = True) -> DataFrame:
    """``node, doc_id, row_key, n, summary`` and, if ``keyed``, ``keys`` per row of ``docs``.

    ``node`` is 64 bits of ``summary``, so equal sets are one node wherever they stand.  A task files the keys
    with the first row of a set; a set without shingles has none.  Keys take more room than the texts, so they
    are not stored: rows are made once to be stored and once with keys that go straight to where they meet.
    """
    schema = "node bigint, doc_id bigint, row_key bigint, n bigint, summary binary, keys array<bigint>"

    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, words)) if keyed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, filed = Bands(num, den), Filed()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets):
                n, summaries, keys, at = [], [], [np.zeros(0, np.int64)], [0]
                for found in shingle_sets(Words(data, offsets[a : b + 1]), words):
                    n.append(len(found))
                    summaries.append(_summary(found))
                    if keyed and filed.first(summaries[-1]):
                        keys.append(bands.keys(found, heavy.value).view(np.int64))
                        at.append(at[-1] + len(keys[-1]))
                    else:
                        at.append(at[-1])
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys)))
                part = batch.slice(a, b - a)
                nodes = np.array([int.from_bytes(x[:8], "little", signed=True) for x in summaries], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes), part.column("doc_id"), part.column("row_key"),
                        pa.array(n, pa.int64()), pa.array(summaries, pa.binary()), listed,
                    ],
                    ["node", "doc_id", "row_key", "n", "summary", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.expr(_ROW).alias("row_key")).mapInArrow(run, schema)
    return rows if keyed else rows.drop("keys")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Shingles of the rows ``wanted(cluster, tile, side, node, row_key, n)`` for every tile, found again in ``docs`` by id and text.

    A repeated row is found once for each time it stands there.
    """
    names = ["cluster", "tile", "side", "node", "n"]
    goes = materialize(wanted.groupBy("row_key").agg(F.collect_list(F.struct(*names)).alias("goes")))
    met = join_checked(docs.select(F.expr(_ROW).alias("row_key"), "text"), goes, "row_key", values=F.size("goes")).select("text", "goes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets):
                goes = batch.column("goes").slice(a, b - a)
                found = [s.tobytes() for s in shingle_sets(Words(data, offsets[a : b + 1]), words)]
                each = goes.flatten()
                shingles = np.repeat(np.arange(b - a), pc.list_value_length(goes).to_numpy()).tolist()
                columns = [pc.struct_field(each, name) for name in names]
                for at in range(0, len(each), STEP_ROWS):  # a set that goes to many tiles stands in many rows
                    some = pa.array([found[k] for k in shingles[at : at + STEP_ROWS]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, STEP_ROWS) for c in columns], some], [*names, "shingles"])

    tile = "struct<b1:int,s1:int,b2:int,s2:int>"
    return met.mapInArrow(run, f"cluster bigint, tile {tile}, side int, node bigint, n bigint, shingles binary")


def _components(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(row table, classes): equal sets ``summary, n`` with their ``first`` doc_id, ``rows`` and ``component``, both stored."""
    table = materialize(set_table(docs, words, num, den, keyed=False))
    classes = materialize(
        table.filter("n > 0").groupBy("summary", "n").agg(
            F.min("node").alias("node"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")
        )
    )
    # Keys go straight to where they meet; a join that picks one row a set would deal them out once more.
    cluster = clusters(set_table(docs, words, num, den).filter(F.size("keys") > 0).select("node", "keys"))
    wanted = materialize(classes.select("node", "row_key", "n").join(cluster, "node"))
    found = tile_components(_sets_of(docs, in_tiles(wanted, num, den), words), num, den)
    classes = classes.drop("row_key")
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return table, materialize(named)


def near_documents(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text)``.

    Rows link where ``den * |intersection| >= num * |union|`` of their distinct ``words``-word
    shingles (fewer words make one shingle); ``component_id`` is the smallest doc_id reachable.
    Null, empty and blank texts have no shingles and link with nothing: their component is their
    own id.  Rows with a null doc_id take part in links and get a component, null only where no
    linked row has an id.  Rows that share an id are rows of their own.  Other columns are ignored.
    """
    table, named = _components(docs, words, num, den)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("summary", F.col("n").alias("n_shingles"), "component_id")
    rows = table.select("doc_id", F.col("n").alias("n_shingles"), "summary").join(named, ["summary", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of every group of near-equal texts, that of the smallest doc_id, and all columns.

    A null doc_id comes last; of rows with the same id and text one stays.  Rows without
    shingles stay.
    """
    table, named = _components(docs, words, num, den)
    groups = named.groupBy("component").agg(F.sum("rows").alias("_n")).filter("_n > 1")
    crowded = materialize(named.join(groups, "component").select("summary", "n", "component"))
    rows = materialize(table.select("doc_id", "row_key", "summary", "n").join(crowded, ["summary", "n"]).select("component", "doc_id", "row_key"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = rows.groupBy("component").agg(F.min(order)["row_key"].alias("_keep"))
    fates = rows.join(first, "component").groupBy("row_key").agg(F.min((F.col("row_key") == F.col("_keep")).cast("int")).alias("_stays"))
    row, key, stays = fresh(docs, "_row", "_key", "_stays")
    known = docs.withColumn(row, F.expr(_ROW))
    met = join_checked(known, materialize(fates.toDF(key, stays)), F.col(row) == F.col(key), "left")
    kept = met.filter(F.col(stays) == 1).dropDuplicates([row])
    return met.filter(F.col(stays).isNull()).unionByName(kept).select(*docs.columns)
