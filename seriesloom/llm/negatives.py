"""Hard negatives by an inverted multi-index over integer vectors.

The space is cut into two halves, each with a codebook of its own; a pair of codes is a cell, and
every vector is filed in the cell of its nearest codes.  The score of an anchor with a vector is the
sum of two half scores, and a half score is at most that of the code plus the length of the anchor's
half times the code's radius.  A heap over the two sorted half lists (multi-sequence) visits cells
by the sum of these bounds.  An anchor is through as soon as the next cell's bound is below what
its windows still ask for, which certifies its lists: the result is exact, whatever the codebooks.

Anchors go in rounds: in each they take the next cells, eight times as many rows as in the round
before, and are joined with the tiles of these cells.  Rows of equal label and vector are one class
and equal anchors one query, so that copies are scored once; of a class only as many ids as a list
can hold are kept, the smallest ones.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize, shuffle_width

#: Classes that codebooks are fitted on, rounds of fitting, and codes of a half at most.
SAMPLE, FITS, MAX_CODES = 4096, 8, 256
#: Classes of a cell on average, and of a tile at most on average.
CELL_ROWS, TILE_ROWS = 1024, 4096
#: Rows an anchor visits in its first round, and how many times more in each further one.
FIRST_ROWS, MORE = 8192, 8
#: Anchors scored in one step.
STEP = 128
_LAST = (1 << 63) - 1  # stands for a null id, which comes after all others
_EXACT = 1 << 53


class Book(NamedTuple):
    """Index of the vectors of one length."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: dict[tuple[int, int], tuple[int, float, float]]  # rows and radii of a cell


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of rows of vectors, as doubles."""
    cut = x.shape[-1] // 2
    return x[..., :cut].astype(float), x[..., cut:].astype(float)


def fit(x: np.ndarray, codes: int) -> np.ndarray:
    """``codes`` centres of the rows of ``x`` by Lloyd's rounds; fewer where rows are fewer."""
    centres = np.unique(x, axis=0)
    if len(centres) > codes:
        centres = centres[np.linspace(0, len(centres) - 1, codes).astype(int)]
        for _ in range(FITS):
            own = nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def visit(book: Book, vector: np.ndarray) -> Iterator[tuple[float, tuple[int, int]]]:
    """(bound, cell) of all cells by falling bound on the score with ``vector``: the multi-sequence heap."""
    bounds, orders = [], []
    for half, codes, radii in zip(halves(vector), book.codes, book.radii):
        # Bounds are raised by more than the sums can be off.
        each = codes @ half + np.sqrt(half @ half) * radii
        bounds.append(each + 1e-9 * (np.abs(codes) @ np.abs(half) + np.sqrt(half @ half) * radii) + 1e-6)
        orders.append(np.argsort(-bounds[-1], kind="stable"))
    (u, v), (p, q) = bounds, orders
    heap, seen = [(-(u[p[0]] + v[q[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(p) and b < len(q) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(u[p[a]] + v[q[b]]), a, b))
        if (cell := (int(p[i]), int(q[j]))) in book.cells:
            yield -bound, cell


def lowest(book: Book, vector: np.ndarray, cell: tuple[int, int]) -> float:
    """Below every score of ``vector`` with the rows of ``cell``."""
    total = 0.0
    for half, codes, code, radius in zip(halves(vector), book.codes, cell, book.cells[cell][1:]):
        reach = np.sqrt(half @ half) * radius
        total += codes[code] @ half - reach - 1e-9 * (np.abs(codes[code]) @ np.abs(half) + reach) - 1e-6
    return total


class Windows(NamedTuple):
    """Scores wanted of rows: all of the same label, or of other labels in ``low`` to ``high`` percent of given ones."""

    top: int
    same: bool
    low: int = 0
    high: int = 0

    def of(self, scores: list[int]) -> dict[int, tuple[float, float]]:
        if self.same:
            return {0: (-math.inf, math.inf)}
        found = {w: (-(-self.low * w // 100), self.high * w // 100) for w in scores}
        return {w: (a, b) for w, (a, b) in found.items() if a <= b}


def integer_rows(rows: DataFrame, scale: int) -> DataFrame:
    """``key, vec_id, label, size, vec`` of usable ``rows(vec_id, label, embedding)``, stored; equal keys have equal label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, whole = (batch.column(c) for c in ("vec_id", "label", "embedding"))
            at, values = whole.offsets.to_numpy(), whole.values.cast(pa.float64())
            odd = values.is_null().to_numpy(zero_copy_only=False)
            values = np.floor(values.to_numpy(zero_copy_only=False) * scale)
            odd = np.concatenate([[0], np.cumsum(odd | ~np.isfinite(values))])
            usable = whole.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            keep, keys, sizes, vecs = [], [], [], []
            for i, label in enumerate(labels.to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                # Beyond this, sums of products leave 64 bits.
                most = min((1 << 31) - 1, math.isqrt((1 << 62) // max(1, b - a)))
                if usable[i] and odd[a] == odd[b] and (a == b or np.abs(values[a:b]).max() <= most):
                    vec = values[a:b].astype("<i4").tobytes()
                    keep.append(i)
                    keys.append(hashlib.md5(int(label).to_bytes(8, "little", signed=True) + vec).digest())
                    sizes.append(b - a)
                    vecs.append(vec)
            kept = pa.array(keep, pa.int64())
            columns = [pa.array(keys, pa.binary()), ids.take(kept), labels.take(kept), pa.array(sizes, pa.int32()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "vec_id", "label", "size", "vec"])

    typed = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    return materialize(typed.mapInArrow(run, "key binary, vec_id bigint, label bigint, size int, vec binary"))


def classes_of(rows: DataFrame, ids: int) -> DataFrame:
    """``key, label, size, vec, ids`` of distinct labels and vectors, with the smallest ``ids`` ids; stored."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("vec_id", F.lit(_LAST))))
    few = rows.withColumn("_at", place).filter(F.col("_at") <= ids)
    return materialize(
        few.groupBy("key").agg(
            F.any_value("label").alias("label"), F.any_value("size").alias("size"), F.any_value("vec").alias("vec"),
            F.sort_array(F.collect_list(F.coalesce("vec_id", F.lit(_LAST)))).alias("ids"),
        )
    )


def codebooks(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks per length of vectors, fitted on ``SAMPLE`` classes; lengths beyond them have one code."""
    total = classes.count()
    sample = classes.select("size", "vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    out = {}
    for size, some in itertools.groupby(sorted(sample, key=lambda r: r["size"]), key=lambda r: r["size"]):
        some = np.array([np.frombuffer(r["vec"], dtype="<i4") for r in some])
        rows = total * len(some) / max(1, len(sample))
        codes = min(MAX_CODES, max(1, math.ceil(math.sqrt(rows / CELL_ROWS))))
        out[size] = tuple(fit(half, codes) for half in halves(some))
    return out


def filed(classes: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``classes`` with ``c1, c2`` and the distances ``r1, r2`` from these codes."""
    sent = classes.sparkSession.sparkContext.broadcast(books)  # MAX_CODES vectors a half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vecs = batch.column("size").to_numpy(), batch.column("vec")
            found = np.zeros((2, batch.num_rows), dtype=np.int32), np.zeros((2, batch.num_rows))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.array([np.frombuffer(vecs[int(i)].as_py(), dtype="<i4") for i in rows])
                for k, (half, codes) in enumerate(zip(halves(x), sent.value.get(size) or [np.zeros((1, h.shape[1])) for h in halves(x)])):
                    own = nearest(half, codes)
                    found[0][k, rows], found[1][k, rows] = own, np.sqrt(((half - codes[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (*found[0], *found[1]))], [*batch.schema.names, "c1", "c2", "r1", "r2"]
            )

    fields = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return classes.mapInArrow(run, f"{fields}, c1 int, c2 int, r1 double, r2 double")


def build_index(classes: DataFrame) -> tuple[DataFrame, dict[int, Book]]:
    """(classes with their cell and ``block``, stored; the index): the index holds at most ``MAX_CODES**2`` cells a length."""
    books = codebooks(classes)
    rows = materialize(filed(classes, books))
    cells = materialize(rows.groupBy("size", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")))
    index: dict[int, Book] = {}
    for size, some in itertools.groupby(sorted(cells.collect()), key=lambda r: r["size"]):
        held = {(r["c1"], r["c2"]): (r["n"], r["r1"], r["r2"]) for r in some}
        codes = books.get(size) or (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))
        radii = tuple(np.array([max((v[1 + k] for c, v in held.items() if c[k] == code), default=-math.inf) for code in range(len(codes[k]))]) for k in (0, 1))
        used = tuple(np.where(np.isfinite(r), r, 0.0) for r in radii)
        index[size] = Book(codes, used, held)
    blocks = cells.select("size", "c1", "c2", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    placed = rows.join(F.broadcast(blocks), ["size", "c1", "c2"]).withColumn("block", block)
    return placed.select("key", "label", "size", "vec", "ids", "c1", "c2", "block"), index


_CELLS = "array<struct<c1:int,c2:int,block:int>>"
_KTH = "array<struct<w:bigint,score:bigint>>"


def _planned(queries: DataFrame, index, windows: Windows, most: int) -> DataFrame:
    """``queries`` with the tiles of their next cells, up to about ``most`` rows; those that are through drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.struct([("c1", pa.int32()), ("c2", pa.int32()), ("block", pa.int32())])
        for batch in batches:
            keep, tiles, pops = [], [], []
            sizes, vecs, scores, kth, visited = (batch.column(c).to_pylist() for c in ("size", "vec", "scores", "kth", "visited"))
            for i, size in enumerate(sizes):
                asked, best = windows.of(scores[i]), {r["w"]: r["score"] for r in kth[i]}
                book = index.value[size]
                vector = np.frombuffer(vecs[i], dtype="<i4")
                least = min((max(a, best.get(w, a)) for w, (a, _) in asked.items()), default=math.inf)
                highest = max((b for _, b in asked.values()), default=-math.inf)
                found, rows, at = [], 0, visited[i]
                for bound, c in itertools.islice(visit(book, vector), at, None):
                    if bound < least or rows >= most:
                        break
                    at += 1
                    if highest == math.inf or lowest(book, vector, c) <= highest:
                        rows += book.cells[c][0]
                        found += [dict(c1=c[0], c2=c[1], block=k) for k in range(-(-book.cells[c][0] // TILE_ROWS))]
                if at > visited[i]:
                    keep.append(i)
                    tiles.append(found)
                    pops.append(at)
            part = batch.take(pa.array(keep, pa.int64()))
            kept = [part.column(c) for c in ("key", "label", "size", "vec", "scores", "kth")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(pops, pa.int64()), pa.array(tiles, pa.list_(cell))], ["key", "label", "size", "vec", "scores", "kth", "visited", "tiles"]
            )

    schema = f"key binary, label bigint, size int, vec binary, scores array<bigint>, kth {_KTH}, visited bigint, tiles {_CELLS}"
    return materialize(queries.mapInArrow(run, schema))


def _scored(rows: DataFrame, plan: DataFrame, windows: Windows) -> DataFrame:
    """``key, w, score, other, ids``: of every tile a query visits, the classes that can stand in its lists."""
    tile = ["size", "c1", "c2", "block"]
    probes = plan.withColumn("_t", F.explode("tiles")).select(
        "size", "_t.c1", "_t.c2", "_t.block", F.lit(1).alias("kind"), "key", "label", "vec", "scores", "kth", F.lit(None).cast("array<bigint>").alias("ids")
    )
    wanted = probes.select(*tile).distinct()  # at most the tiles of the index
    held = rows.join(wanted, tile, "left_semi").select(
        *tile, F.lit(0).alias("kind"), "key", "label", "vec", F.lit(None).cast("array<bigint>").alias("scores"), F.lit(None).cast(_KTH).alias("kth"), "ids"
    )
    both = held.unionByName(probes).repartition(shuffle_width(rows), *tile).sortWithinPartitions(*tile, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, labels, ids, vecs, matrix = None, [], [], [], [], None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            names = list(zip(*(batch.column(c).to_pylist() for c in tile)))
            kinds = batch.column("kind").to_pylist()
            at = 0
            while at < len(names):
                if names[at] != here:
                    here, keys, labels, ids, vecs, matrix = names[at], [], [], [], [], None
                to = at
                while to < len(names) and to - at < STEP and names[to] == here and kinds[to] == kinds[at]:
                    to += 1
                part = batch.slice(at, to - at)
                some = [np.frombuffer(v.as_py(), dtype="<i4") for v in part.column("vec")]
                if kinds[at] == 0:
                    keys += part.column("key").to_pylist()
                    labels += part.column("label").to_pylist()
                    ids += part.column("ids").to_pylist()
                    vecs += some
                else:
                    if matrix is None:
                        matrix = np.array(vecs).reshape(len(vecs), here[0]), np.array(labels), np.array([x[0] for x in ids])
                    _lists(part, np.array(some).reshape(len(some), here[0]), matrix, keys, ids, windows, out)
                at = to
            kinds_out = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_out)], ["key", "w", "score", "other", "ids"])

    return both.mapInArrow(run, "key binary, w bigint, score bigint, other binary, ids array<bigint>")


def _lists(part: pa.RecordBatch, anchors: np.ndarray, held: tuple[np.ndarray, ...], keys: list, ids: list, windows: Windows, out: tuple) -> None:
    """Append (key, w, score, other, ids) of the best classes of a tile for each anchor of ``part`` and window."""
    matrix, labels, first = held
    top = int(np.abs(anchors).max(initial=0)) * int(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
    kind = float if top < _EXACT else np.int64  # both exact
    scores = (anchors.astype(kind) @ matrix.astype(kind).T).astype(np.int64)
    for i, (key, label, wanted, kth) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "label", "scores", "kth")))):
        fits = np.flatnonzero((labels == label) == windows.same)
        best = {r["w"]: r["score"] for r in kth}
        for w, (low, high) in windows.of(wanted).items():
            mine = scores[i, fits]
            rows = fits[(mine >= max(low, best.get(w, low))) & (mine <= high)]
            if len(rows) > windows.top:
                least = np.partition(scores[i, rows], -windows.top)[-windows.top]
                rows = rows[scores[i, rows] >= least]
            for k in rows[np.lexsort((first[rows], -scores[i, rows]))][: windows.top].tolist():
                for column, value in zip(out, (key, w, int(scores[i, k]), keys[k], ids[k])):
                    column.append(value)


def search(queries: DataFrame, rows: DataFrame, index: dict[int, Book], windows: Windows) -> DataFrame:
    """``key, w, score, other, id``: the best ``windows.top`` rows of every query and window, stored.

    ``queries(key, label, size, vec, scores)`` are distinct; ``rows`` and ``index`` are those of
    ``build_index``.  Higher scores come first, then smaller ids; ``other`` is the row's class.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index)  # bounded cells, see build_index
    pending = queries.withColumns({"kth": F.array().cast(_KTH), "visited": F.lit(0).cast("bigint")})
    found, most = None, FIRST_ROWS
    by = Window.partitionBy("key", "w").orderBy(F.desc("score"), "id", "other")
    while True:
        plan = _planned(pending, sent, windows, most)
        if plan.isEmpty():
            break
        new = _scored(rows, plan, windows).select("key", "w", "score", "other", F.explode("ids").alias("id"))
        every = new if found is None else found.unionByName(new)
        found = materialize(every.withColumn("_at", F.row_number().over(by)).filter(F.col("_at") <= windows.top).drop("_at"))
        full = found.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == windows.top)
        kth = full.groupBy("key").agg(F.collect_list(F.struct("w", "score")).alias("kth"))
        pending = plan.drop("kth", "tiles").join(kth, "key", "left").withColumn("kth", F.coalesce("kth", F.array().cast(_KTH)))
        most *= MORE
    empty = "key binary, w bigint, score bigint, other binary, id bigint"
    return found if found is not None else queries.sparkSession.createDataFrame([], empty)


def hard_negatives(
    rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds of ``vec_id``.

    ``rows(vec_id, label, embedding)`` with a null label or vector, or a null or non-finite component,
    take no part; components are ``floor(scale * x)``, scores integer inner products.  An anchor's
    positives are its ``positives`` best other rows of its label; for each the ``negatives`` best
    rows of other labels whose score is between ``low`` and ``high`` percent of the positive's come
    back, best first, ties by smaller vec_id, a null id last.  Vectors of different length do not
    meet; empty vectors score 0.  Vectors with components so large that a score could leave 64 bits
    (over two to the 28th after scaling, at 64 components) take no part.  Rows that share a vec_id
    are rows of their own, a null vec_id is no anchor; anchors or positives without partners give no
    rows; other columns are ignored.
    """
    stored = integer_rows(rows, scale)
    anchors = stored.filter(anchor).select("key", F.col("vec_id").alias("anchor_id"))
    classes = classes_of(stored, max(positives + 1, negatives))
    filed_rows, index = build_index(classes)
    queries = classes.select("key", "label", "size", "vec").join(anchors.select("key").distinct(), "key", "left_semi")
    queries = queries.withColumn("scores", F.array().cast("array<bigint>"))
    near = search(queries, filed_rows, index, Windows(positives + 1, True))
    # One row more than wanted was taken: the anchor itself, if it is among them, goes.
    entry = F.struct((-F.col("score")).alias("under"), "id", (F.col("key") == F.col("other")).alias("own"))
    lists = near.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    met = anchors.join(lists, "key")
    itself = F.array_position(F.transform("l", lambda x: x["own"] & (x["id"] == F.col("anchor_id"))), True)
    others = F.slice(F.filter(F.col("l"), lambda x, i: (i + 1) != F.col("_itself")), 1, positives)
    met = met.withColumn("_itself", itself).withColumn("p", F.explode(others))
    chosen = materialize(met.select("key", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.under")).alias("positive_score")))
    scores = chosen.groupBy("key").agg(F.collect_set("positive_score").alias("scores"))
    asked = classes.select("key", "label", "size", "vec").join(scores, "key")
    far = search(asked, filed_rows, index, Windows(negatives, False, low, high))
    ranked = F.struct((-F.col("score")).alias("under"), "id")
    worst = far.groupBy("key", F.col("w").alias("positive_score")).agg(F.sort_array(F.collect_list(ranked)).alias("n"))
    out = chosen.join(worst, ["key", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("at", "n"))
    known = lambda c: F.when(c != _LAST, c)
    return out.select(
        "anchor_id", known(F.col("positive_id")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        known(F.col("n.id")).alias("negative_id"), "positive_score", (-F.col("n.under")).alias("negative_score"),
    )
